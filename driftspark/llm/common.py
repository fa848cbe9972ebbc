"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches; ``utf8`` views a batch as one byte array
with offsets, so that words, hashes and n-grams of many documents are found by
a few numpy calls instead of a Python loop per row.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK = f"/tmp/checkpoints/{uuid.uuid4().hex}"

#: Bytes that end a word: white space, or all that is neither a-z, 0-9 nor part of a non-ASCII character.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = False
NOT_ALNUM[0x80:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark runs on this machine alone."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (told or _FALLBACK).rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``store`` that no later step reads."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column, of: int):
    """crc32 of a column as text, modulo ``of``; a null counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % of


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 2 << 20):
    """Row ranges of about ``limit`` bytes each (a longer row stands alone), so that temporary arrays stay small."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS.get("p", ())) < n:
        for name, base in (("p", _P), ("inv", _P_INV)):
            a = np.full(max(n, 1 << 16), base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, end) of every word of already lower-cased texts, in order. ``breaks`` marks the bytes that are in no word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, inv = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inv[starts])
    return h, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, as ``spans`` finds them."""
    return spans(data, offsets, breaks)[:2]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values (len(h) - k + 1 of them); runs across rows are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= np.uint64(_P)
        out += h[j : j + n]
    return mix(out)


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the values of each of n rows begin (n + 1 values), given the sorted row of each value."""
    return np.searchsorted(rows, np.arange(n + 1))


def lower_ascii(column):
    """Lower-case A-Z alone, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of a membership filter: 2 MB in each task, whatever number of keys it stands for.
FILTER_BITS = 1 << 24


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the values (long, or arrays of them) in a column; each task sends one of fixed size, merged as they come."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            v = batch.column(0)
            v = v.flatten() if pa.types.is_list(v.type) else v
            bits[filter_at(v.to_numpy(zero_copy_only=False).view(np.uint64))] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in df.select(column).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def filter_at(values: np.ndarray) -> np.ndarray:
    """Places of 64-bit values in a bit_filter."""
    return (values % np.uint64(FILTER_BITS)).astype(np.int64)


def filter_has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether 64-bit values may be in a bit_filter, which stays packed."""
    at = filter_at(values)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def give_back() -> None:
    """Return freed memory to the system. Python processes outlive their task or training, and would hold it beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def giving_back(run):
    """An Arrow function that returns its freed memory to the system when it ends."""

    def outer(batches):
        yield from run(batches)
        give_back()

    return outer
