"""MinHash near-dedup with SetSketch registers.

Register i of a document is floor(1 - log_BASE(x_i)) of the smallest exponential value x_i over its shingles, cut to
0..LIMIT: registers of two parts of a set merge by maximum, and two sets agree in a register with a probability of at
least their Jaccard similarity J. Bands of ``rows`` registers propose candidates; a bucket compares its members
with its smallest one, and where members remain in different components, across components too, in blocks. The
counts of larger, smaller and equal registers give J by maximum likelihood; what that doesn't rule out is verified on the
full sets. Bands are as wide as the threshold allows with a probability of at most MISS to miss a link at it (``band_rows``):
at J = 0.85 24 bands of 5 miss 8e-7, at J = 0.8 30 bands of 4 miss 1e-7.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import LOWER, SPACE, bit_filter, bounds, drop, filter_has, giving_back, grams, mix, slices, store, table, utf8, words
from driftspark.llm.graph import components

REGISTERS, BASE, RATE, LIMIT = 120, 1.02, 20.0, 65534
#: Standard errors by which an estimate may fall short of the threshold and still be verified.
SLACK = 6.0
#: Probability with which no band may hold a pair right at the threshold.
MISS = 1e-6
#: Members of a bucket compared at once across components, and shingles that these may have together (a larger set stands alone).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Bytes of text whose words a task holds at once (a longer text stands alone).
SLICE = 1 << 19

_FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_rows(percent: int) -> int:
    """Registers in a band: the most that miss a pair of that similarity with a probability of at most MISS."""
    fits = [r for r in range(1, REGISTERS + 1) if REGISTERS % r == 0 and (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISS]
    if not fits:
        raise ValueError(f"{REGISTERS} registers can't find pairs of {percent} % with a probability of {1 - MISS}")
    return max(fits)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct k-word shingles of each text; of fewer words, the whole sequence as one."""
    h, rows = words(data, offsets, SPACE)
    n = len(offsets) - 1
    first = bounds(rows, n)
    count = np.diff(first)
    g = grams(h, k)
    ok = rows[: len(g)] == rows[k - 1 :] if len(g) else np.zeros(0, bool)
    parts, of = [g[ok]], [rows[: len(g)][ok]]
    for j in range(1, k):
        at = first[:-1][count == j]
        if len(at):
            parts.append(grams(h, j)[at])
            of.append(rows[at])
    g, of_row = np.concatenate(parts), np.concatenate(of)
    order = np.argsort(of_row, kind="stable")
    g, of_row = g[order], of_row[order]
    cut = bounds(of_row, n)
    for i in range(n):
        g[cut[i] : cut[i + 1]].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (of_row[1:] != of_row[:-1])
    return g[keep], bounds(of_row[keep], n)


def registers(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers of the sets that begin at starts (none empty)."""
    low = np.empty((len(starts), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        low[:, i] = np.minimum.reduceat(g * _FACTORS[i], starts)
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def digests(g: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """128 bits of each set, from a sum and an exclusive or over its members: one row of two values a set."""
    n = len(cut) - 1
    out = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        out[full, 0] = np.add.reduceat(mix(g), cut[full])
        out[full, 1] = np.bitwise_xor.reduceat(mix(g ^ np.uint64(0xD6E8FEB86659FD93)), cut[full])
    return out


def likelihood_jaccard(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The J that is likeliest for pairs of sets of known sizes, of whose registers so many are larger and smaller."""
    equal = REGISTERS - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1e-12, 1 - up - down))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(25):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        left = value(a) > value(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def _plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sketches whose sets may reach the threshold: by their sizes, their equal registers (J at least), their likeliest J."""
    t = percent / 100
    least = t - SLACK * np.sqrt(t * (1 - t) / REGISTERS)
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    at = at[(a[at] == b[at]).sum(axis=1) >= least * REGISTERS]
    if len(at):
        x, y = a[at], b[at]
        out[at] = likelihood_jaccard((x > y).sum(axis=1), (x < y).sum(axis=1), n_a[at].astype(float), n_b[at].astype(float)) >= least
    return out


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                off = offsets[lo : hi + 1] - offsets[lo]
                g, cut = shingle_sets(LOWER[data[offsets[lo] : offsets[hi]]], off, k)
                n = np.diff(cut)
                full = np.flatnonzero(n)
                sketch = np.zeros((hi - lo, REGISTERS), np.uint16)
                if len(full):
                    sketch[full] = registers(g, cut[full])
                digest = digests(g, cut)
                blob = lambda a: pa.Array.from_buffers(pa.binary(a.shape[1] * a.itemsize), len(a), [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(n.astype(np.int64)), blob(digest), blob(sketch)], names=["row", "n", "digest", "sketch"])

    return run


def _wanted_sets(k: int, bits):
    """Arrow function: the sets of texts whose digest may be asked for."""

    def run(batches):
        sent = set()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                off = offsets[lo : hi + 1] - offsets[lo]
                g, cut = shingle_sets(LOWER[data[offsets[lo] : offsets[hi]]], off, k)
                digest = digests(g, cut)
                for i in np.flatnonzero(filter_has(bits.value, digest[:, 0].copy()) & (np.diff(cut) > 0)):
                    if (name := digest[i].tobytes()) in sent:  # one of a task's copies is enough
                        continue
                    sent.add(name)
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([g[cut[i] : cut[i + 1]].tobytes()], pa.binary())], names=["digest", "set"])

    return run


def _joined(run_one, name: str):
    """Batches of about a thousand rows from those that a function yields."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in run_one(batches):
            held.append(b)
            size += b.nbytes
            if len(held) >= 1000 or size > 8 << 20:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    run.__name__ = name
    return run


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _filter_pairs(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ok = _plausible(*(_sketch_matrix(batch.column(c)) for c in ("sketch_a", "sketch_b")), *(batch.column(c).to_numpy() for c in ("n_a", "n_b")), percent)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "digest_a", "digest_b")], names=["a", "b", "digest_a", "digest_b"])

    return run


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
            keep = pa.array([_similar(x, y, percent) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def _across(percent: int, rows: int):
    """Pandas function over one block pair of a bucket: links that join different components, no more than join them.

    A pair is compared in its first shared band alone, by sketches and then on its full sets.
    """

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        band, same = int(key[1]), key[3] == key[4]
        left = df[df.side == 0].reset_index(drop=True)
        right = left if same else df[df.side == 1].reset_index(drop=True)
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            n_l, n_r = left.n.to_numpy(), right.n.to_numpy()
            small, large = np.minimum(n_l[:, None], n_r[None, :]), np.maximum(n_l[:, None], n_r[None, :])
            i, j = np.nonzero((left.comp.to_numpy()[:, None] != right.comp.to_numpy()[None, :]) & (100 * small >= percent * large))
            if same:
                i, j = i[i < j], j[i < j]
            sl, sr = (np.frombuffer(b"".join(x.sketch), np.uint16).reshape(len(x), REGISTERS) for x in (left, right))
            leader = {int(c): int(c) for c in np.concatenate([left.comp, right.comp])}

            def top(c):
                while leader[c] != c:
                    leader[c] = c = leader[leader[c]]
                return c

            for s in range(0, len(i), 20_000):
                p, q = i[s : s + 20_000], j[s : s + 20_000]
                equal = (sl[p] == sr[q]).reshape(len(p), REGISTERS // rows, rows).all(axis=2)
                ok = equal.argmax(axis=1) == band
                p, q = p[ok], q[ok]
                ok = _plausible(sl[p], sr[q], n_l[p], n_r[q], percent)
                for x, y in zip(p[ok], q[ok], strict=True):
                    c, d = top(int(left.comp[x])), top(int(right.comp[y]))
                    if c != d and _similar(left.set[x], right.set[y], percent):
                        leader[c] = d
                        links.append((int(left.rep[x]), int(right.rep[y])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _sets(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(digest, set) of the sets whose digests are asked for. A bitmap of fixed size keeps most others from the shuffle."""

    def heads(batches):
        for batch in batches:
            v = [np.frombuffer(x[:8], np.int64)[0] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64))], names=["head"])

    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(asked.select("digest").mapInArrow(heads, "head long"), "head"))
    sets = docs.select("text").mapInArrow(giving_back(_joined(_wanted_sets(k, bits), "wanted_sets")), "digest binary, set binary")
    return store(sets.join(asked.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("set").alias("set")), "sets")


def near_duplicates(docs: DataFrame, key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """row (a struct of the columns of docs but text), n_shingles, component_id (smallest key reachable by links), kept, first.

    Texts link when 100 * |A and B| >= percent * |A or B| over their sets of distinct k-word shingles (words are runs of
    other than ASCII white space, A-Z lower-cased; a text of fewer words is one shingle). Null and blank texts have empty
    sets, link with nothing and are kept. Equal texts link. Of repeated rows each has the same component; a null key is
    smallest only where a component has no other. ``first`` is true for one row of each component, one of those kept. An
    empty table gives an empty result.
    """
    rows = band_rows(percent)
    rest = [c for c in docs.columns if c != "text"]
    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*rest).alias("row"))
    row_type = source.schema["row"].dataType.simpleString()
    rowed = source.mapInArrow(giving_back(_sketches(k)), f"row {row_type}, n long, digest binary, sketch binary").withColumn("uid", F.monotonically_increasing_id())
    rowed = store(rowed, "sketches")
    sets = rowed.where("n > 0").groupBy("digest").agg(F.min(F.struct("uid", "n", "sketch")).alias("s"))
    reps = store(sets.select("digest", F.col("s.uid").alias("rep"), F.col("s.n").alias("n"), F.col("s.sketch").alias("sketch")), "reps")
    bands = F.array(*[F.xxhash64(F.substring("sketch", 2 * rows * i + 1, 2 * rows)) for i in range(REGISTERS // rows)])
    placed = reps.select("rep", F.posexplode(bands).alias("band", "bucket"))
    shared = placed.groupBy("band", "bucket").agg(F.count("*").alias("members"), F.min("rep").alias("first")).where("members > 1")
    buckets = store(placed.join(shared, ["band", "bucket"]), "buckets")
    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("digest").alias(f"digest_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    pairs = buckets.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "digest_a", "digest_b", "sketch_a", "sketch_b")
    pairs = store(pairs.mapInArrow(_filter_pairs(percent), "a long, b long, digest_a binary, digest_b binary"), "pairs")
    sets = _sets(docs, pairs.select(F.explode(F.array("digest_a", "digest_b")).alias("digest")), k)
    of = lambda s: sets.select(F.col("digest").alias(f"digest_{s}"), F.col("set").alias(f"set_{s}"))
    verified = pairs.join(of("a"), "digest_a").join(of("b"), "digest_b").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")
    links = store(verified, "links")
    drop(sets, pairs)
    found = components(links)

    # buckets whose members, the smallest apart, are still in different components: compare across these
    comp = buckets.where("rep <> first").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    open_buckets = comp.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "bucket")
    still = store(comp.join(open_buckets, ["band", "bucket"]).join(reps, "rep").select("band", "bucket", "rep", "comp", "n", "digest", "sketch"), "open")
    load = still.groupBy("band", "bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    still = store(still.join(load, ["band", "bucket"]).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")), "blocks")
    if still.limit(1).count():
        sets = _sets(docs, still, k)
        dealt = still.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
            {"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}
        )
        more = dealt.join(sets, "digest").groupBy("bucket", "band", "blocks", "lo", "hi").applyInPandas(_across(percent, rows), "a long, b long")
        links = store(links.unionByName(more), "links")
        drop(sets)
        found = components(links)
    # what is joined to the rows is stored first, so that a group of very many copies can be split among tasks
    root = reps.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    root = store(root, "roots")
    member = rowed.select("uid", F.col(f"row.{key}").alias("key"), "n", "digest").join(root, "digest", "left")
    member = store(member.select("uid", "key", "n", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("uid")).alias("root")), "members")
    drop(reps, buckets, still, links, root)
    smallest = store(member.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "uid")).alias("least")), "smallest")
    out = member.join(smallest, "root").select(
        "uid",
        F.col("n").alias("n_shingles"),
        F.col("least.key").alias("component_id"),
        F.col("key").eqNullSafe(F.col("least.key")).alias("kept"),
        (F.col("uid") == F.col("least.uid")).alias("first"),
    )
    return rowed.select("uid", "row").join(out, "uid").drop("uid")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)
    return found.select("row.doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x),
m AS (SELECT x, min(root) AS root FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, m.root = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id
"""
