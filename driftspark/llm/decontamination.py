"""Benchmark decontamination by winnowing.

Of each run of SPAN consecutive words, the k-gram with the smallest hash is kept; equal runs keep
the same k-gram, so any span of SPAN words that a document shares with an item meets in the join of the
fingerprints. A hit is then extended word by word to both sides: with SPAN = K + W - 1, a run of SPAN words
around the k-gram reaches at most SPAN - K words to either side, and those words travel with the fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspark.llm.common import FILTER_BITS, LOWER, NOT_ALNUM, bounds, drop, filter_at, filter_has, giving_back, grams, slices, store, table, utf8, words

SPAN, K = 10, 5
REACH = SPAN - K

PRINTS = "uid long, n_words long, h array<long>, pos array<int>, len array<int>, context array<long>"


def winnow(h: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Positions of the k-grams kept: the rightmost smallest of each SPAN words of one row."""
    g = grams(h, K)
    width = SPAN - K + 1
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = g[j : j + n]
        take = other <= best
        best = np.where(take, other, best)
        at = np.where(take, np.arange(j, j + n), at)
    return np.unique(at[rows[:n] == rows[SPAN - 1 :]])


def _around(h: np.ndarray, rows: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The words from REACH before to REACH after each k-gram; 0 where the row has none."""
    i = at[:, None] + np.arange(-REACH, k + REACH)
    ok = (i >= 0) & (i < len(h))
    i = np.clip(i, 0, max(0, len(h) - 1))
    ok &= rows[i] == rows[at][:, None]
    return np.where(ok, h[i] | np.uint64(1), np.uint64(0)).view(np.int64)


def _prints(short: tuple[int, ...], items: bool, bits: Broadcast | None):
    """Arrow function: the fingerprints of each text. short: lengths of items of fewer than SPAN words; bits: a bitmap of the items' fingerprints."""

    def run(batches):
        seen = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets):
                off = offsets[lo : hi + 1] - offsets[lo]
                h, rows = words(LOWER[data[offsets[lo] : offsets[hi]]], off, NOT_ALNUM)
                n = hi - lo
                first = bounds(rows, n)
                count = np.diff(first)
                found = []
                if items:
                    at = winnow(h, rows, n)
                    found.append((at, grams(h, K)[at], np.full(len(at), K)))
                    for k in range(1, SPAN):
                        at = first[:-1][count == k]
                        found.append((at, grams(h, k)[at] if len(at) else np.zeros(0, np.uint64), np.full(len(at), -k)))
                else:
                    at = winnow(h, rows, n)
                    found.append((at, grams(h, K)[at], np.full(len(at), K)))
                    for k in short:
                        g = grams(h, k)
                        at = np.flatnonzero(rows[: len(g)] == rows[k - 1 :]) if len(g) else np.zeros(0, np.int64)
                        found.append((at, g[at], np.full(len(at), -k)))
                at, value, length = (np.concatenate(x) for x in zip(*found, strict=True))
                value = value ^ (np.abs(length) + 64 * (length < 0)).astype(np.uint64)
                if seen is not None:
                    ok = filter_has(seen, value)
                    at, value, length = at[ok], value[ok], length[ok]
                order = np.lexsort((at, rows[at]))
                at, value, length = at[order], value[order], length[order]
                cut = np.searchsorted(rows[at], np.arange(n + 1)).astype(np.int32)
                around = _around(h, rows, at, K) if len(at) else np.zeros((0, K + 2 * REACH), np.int64)
                wide = around.shape[1]
                lists = lambda v, t: pa.ListArray.from_arrays(pa.array(cut), pa.array(v, t))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid[lo:hi], pa.int64()),
                        pa.array(count, pa.int64()),
                        lists(value.view(np.int64), pa.int64()),
                        lists((at - first[rows[at]]).astype(np.int32), pa.int32()),
                        lists(length.astype(np.int32), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(cut * wide), pa.array(around.ravel(), pa.int64())),
                    ],
                    names=["uid", "n_words", "h", "pos", "len", "context"],
                )

    return run


def _filter_bits(prints: DataFrame) -> bytes:
    """A bitmap of the items' fingerprints: each task sends one of fixed size, and they are merged as they come."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            v = batch.column("h").combine_chunks() if isinstance(batch.column("h"), pa.ChunkedArray) else batch.column("h")
            v = v.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bits[filter_at(v)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in prints.select("h").mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def _exploded(prints: DataFrame, *keys: str) -> DataFrame:
    wide = K + 2 * REACH
    each = F.posexplode(F.arrays_zip("h", "pos", "len"))
    return prints.select(*keys, "context", each.alias("i", "p")).select(
        *keys, F.col("p.h").alias("h"), F.col("p.pos").alias("pos"), F.col("p.len").alias("len"), F.slice("context", F.col("i") * wide + 1, wide).alias("context")
    )


def _extend(batches):
    """Arrow function: document and item contexts of equal fingerprints -> spans of equal words that hold a whole window."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        wide = K + 2 * REACH
        a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, wide) for c in ("context", "item_context"))
        same = (a == b) & (a != 0)
        left = np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(axis=1)
        right = np.cumprod(same[:, REACH + K :], axis=1).sum(axis=1)
        length = batch.column("len").to_numpy()
        whole = length < 0
        core = same[:, REACH : REACH + K].all(axis=1)
        ok = whole | (core & (left + right + K >= SPAN))
        pos = batch.column("pos").to_numpy()
        start = np.where(whole, pos, pos - left)
        end = np.where(whole, pos - length, pos + K + right)
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid").filter(pa.array(ok)), batch.column("item_id").filter(pa.array(ok)), pa.array(start[ok].astype(np.int32)), pa.array(end[ok].astype(np.int32))],
            names=["uid", "item_id", "start", "end"],
        )


def shared_spans(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): documents(uid, n_words, row: a struct of docs' columns but text), spans(uid, item_id, start, end) in words.

    docs has a text column, benchmark item_id and text. Null and empty texts have no words and no spans. Each row of docs
    has a uid of its own, so repeated rows and null or repeated ids stay apart; items with equal ids count as one item.
    Items of fewer than SPAN words are one window. Long texts are read whole; the temporary arrays follow the longest text.
    """
    # what happens to a single text is a property of the row alone; the uid is fixed by the stored table
    items = benchmark.select("item_id", "text").withColumn("uid", F.monotonically_increasing_id())
    items = store(items, "items")
    item_prints = store(items.select("uid", "text").mapInArrow(_prints((), True, None), PRINTS), "item-prints")
    short = tuple(sorted(r[0] for r in item_prints.where(F.col("n_words").between(1, SPAN - 1)).select("n_words").distinct().collect()))
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(item_prints))
    keep = [c for c in docs.columns if c != "text"]
    packed = F.struct(*keep) if keep else F.struct(F.lit(0).alias("_"))
    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), packed.alias("row"))

    prints = _prints(short, False, bits)

    def run(batches):
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([batch.column("text"), pa.array(np.arange(batch.num_rows), pa.int64())], names=["text", "uid"])
            for out in prints(iter([numbered])):
                yield pa.RecordBatch.from_arrays([batch.column("row").take(out.column("uid")), *out.columns[1:]], names=["row", *out.schema.names[1:]])

    row_type = source.schema["row"].dataType.simpleString()
    found = source.mapInArrow(giving_back(run), f"row {row_type}, " + PRINTS.split(", ", 1)[1]).withColumn("uid", F.monotonically_increasing_id())
    found = store(found, "prints")
    item_side = _exploded(item_prints.where("size(h) > 0").join(items.select("uid", "item_id"), "uid"), "item_id").select(
        "item_id", "h", "len", F.col("context").alias("item_context")
    )
    doc_side = _exploded(found.where("size(h) > 0").select("uid", "h", "pos", "len", "context"), "uid")
    spans = doc_side.join(item_side.distinct(), ["h", "len"]).select("uid", "item_id", "pos", "len", "context", "item_context")
    item_type = item_side.schema["item_id"].dataType.simpleString()
    spans = spans.mapInArrow(_extend, f"uid long, item_id {item_type}, start int, end int").distinct()
    return found.select("uid", "n_words", "row"), spans


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: row (a struct of its columns but text), n_words, n_hit, n_items, items (sorted array of item ids as text), spans (merged, in words)."""
    documents, spans = shared_spans(docs, benchmark)
    spans = store(spans, "spans")
    order = Window.partitionBy("uid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        spans.select("uid", "start", "end")
        .distinct()
        .withColumn("new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
        .withColumn("island", F.sum("new").over(order))
        .groupBy("uid", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("uid")
        .agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    per_item = (
        spans.select("uid", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("uid")
        .agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    )
    zero = F.lit(0).cast("long")
    return (
        documents.join(islands, "uid", "left")
        .join(per_item, "uid", "left")
        .withColumns({"n_hit": F.coalesce("n_hit", zero), "n_items": F.coalesce("n_items", zero), "items": F.coalesce("items", F.array().cast("array<string>"))})
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Equal windows are found by their words alone; a document's words inside an occurrence are its hits.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, bw.item_id, dw.i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
