"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors u, v with cosine >= T have squared distance <= 2 - 2T. After a fixed rotation the coordinates are split
into blocks; in at least one of them the squared distance is within the block's share (its width over all) of that
budget. Each block is a range join on all of its coordinates: two vectors within the budget differ by no more than its root
in any of them, so for each coordinate a vector's partners are a run of the vectors sorted by it. The runs are bitmaps, and
only pairs in the bitmaps of all coordinates of a block get a distance; the union of the blocks' candidates is verified by the
exact cosine in double precision, a pair in the first block that lets it pass.

The vectors of a label are dealt into chunks that meet pairwise, whatever the number of blocks: a vector travels once for each
CHUNK vectors of its label. What leaves a task is a number of links per vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import drop, store, table
from driftspark.llm.graph import components

COSINE = 0.93
BLOCKS = 8
#: Vectors of a label in a chunk, rows of a chunk whose bitmaps are held at once, and pairs verified at once.
CHUNK, ROWS, PAIRS = 2048, 256, 1 << 16


def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def edges_of(width: int) -> np.ndarray:
    """Where the blocks of vectors of that width begin and end."""
    return np.linspace(0, width, min(BLOCKS, width) + 1).astype(int)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _range_join(x: np.ndarray, y: np.ndarray, reach: float):
    """Yield (i, j) of all pairs of rows whose coordinates each differ by no more than ``reach``, in portions."""
    n, width = len(y), y.shape[1]
    words = (n + 63) // 64
    prefixes, low, high = [], [], []
    for k in range(width):
        order = np.argsort(y[:, k], kind="stable")
        bits = np.zeros((n + 1, words), np.uint64)  # row r: the r vectors that come first by this coordinate
        bits[np.arange(1, n + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
        np.bitwise_or.accumulate(bits, axis=0, out=bits)
        prefixes.append(bits)
        low.append(np.searchsorted(y[order, k], x[:, k] - reach, "left"))
        high.append(np.searchsorted(y[order, k], x[:, k] + reach, "right"))
    for s in range(0, len(x), ROWS):
        both = None
        for bits, lo, hi in zip(prefixes, low, high, strict=True):
            run = bits[hi[s : s + ROWS]] ^ bits[lo[s : s + ROWS]]
            both = run if both is None else both & run
        i, j = np.nonzero(np.unpackbits(both.view(np.uint8), axis=1, bitorder="little", count=n))
        yield i + s, j


def _compare(threshold: float):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        same = key[2] == key[3]
        left = df[df.side == 0].reset_index(drop=True)
        right = left if same else df[df.side == 1].reset_index(drop=True)
        empty = pd.DataFrame({"gid": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if left.empty or right.empty:
            return empty
        a, b = _unit(_matrix(left.vec)), _unit(_matrix(right.vec))
        width = a.shape[1]
        q, edge = rotation(width), edges_of(width)
        budget = (2 - 2 * threshold) * np.diff(edge) / width * (1 + 1e-9) + 1e-12
        ra, rb = a @ q, b @ q
        gid = np.concatenate([left.gid.to_numpy(), right.gid.to_numpy()])
        mult = np.concatenate([left["mult"].to_numpy(), right["mult"].to_numpy()])
        shift = 0 if same else len(left)
        count, parent = np.zeros(len(gid), np.int64), np.arange(len(gid))
        found = []
        for block in range(len(budget)):
            cut = slice(edge[block], edge[block + 1])
            for i, j in _range_join(ra[:, cut], rb[:, cut], np.sqrt(budget[block])):
                if same:
                    i, j = i[i < j], j[i < j]
                for s in range(0, len(i), PAIRS):
                    p, r = i[s : s + PAIRS], j[s : s + PAIRS]
                    near = ((ra[p, cut] - rb[r, cut]) ** 2).sum(axis=1) <= budget[block]
                    p, r = p[near], r[near]
                    parts = np.add.reduceat((ra[p] - rb[r]) ** 2, edge[:-1], axis=1)
                    first = (parts <= budget).argmax(axis=1) == block
                    p, r = p[first], r[first]
                    linked = (a[p] * b[r]).sum(axis=1) >= threshold
                    p, r = p[linked], r[linked] + shift
                    np.add.at(count, p, mult[r])
                    np.add.at(count, r, mult[p])
                    found.append(np.stack([p, r]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        while pairs.size:  # each vector takes the smallest number among its links until nothing changes
            low = parent.copy()
            np.minimum.at(low, pairs[0], parent[pairs[1]])
            np.minimum.at(low, pairs[1], parent[pairs[0]])
            low = low[low]
            if (low == parent).all():
                break
            parent = low
        some = np.flatnonzero(count)
        return pd.DataFrame({"gid": gid[some], "n": count[some], "root": gid[parent[some]]}) if len(some) else empty

    return run


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vectors(vec_id, embedding, label, ...) -> row (a struct of all columns but the embedding), n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their widths are equal and their cosine is >= threshold. A vector
    that is null, empty, zero, or holds a null or non-finite component links with nothing; neither does one without a
    label. Equal vectors of a label are compared once and counted with their number; repeated rows are vectors of their
    own. component_id is the smallest vec_id reachable, a null one only where a component has no other. The columns of vectors but
    the embedding come back inside ``row``, so none clashes. An empty table gives an empty result.
    """
    rest = [c for c in vectors.columns if c != "embedding"]
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & fine, F.lit(False))
    rows = vectors.select(F.struct(*rest).alias("row"), F.col("label").cast("string").alias("label"), F.when(valid, F.transform(e, lambda x: x + F.lit(0.0))).alias("vec"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("digest", F.unhex(F.sha2(F.concat_ws(",", F.col("vec").cast("array<string>")), 256)).substr(1, 16))
    rows = rows.withColumn("digest", F.when(F.col("vec").isNotNull(), F.col("digest")))
    # a group of equal vectors is named by a digest of its values, so that a very common vector's rows are joined by a short key
    rows = store(rows, "vectors")
    groups = rows.where("digest is not null").groupBy("label", "digest").agg(F.min(F.struct("uid", "vec")).alias("m"), F.count("*").alias("mult"))
    groups = store(groups.select("label", "digest", F.col("m.uid").alias("gid"), F.col("m.vec").alias("vec"), "mult"), "groups")
    sizes = groups.groupBy("label", F.size("vec").alias("width")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = groups.withColumn("width", F.size("vec")).join(sizes, ["label", "width"]).withColumn("own", F.pmod(F.xxhash64("gid"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), (F.col("own") > o).cast("int").alias("side")))
    dealt = placed.select("gid", "label", "width", "vec", "mult", F.explode(pairs).alias("p")).select("gid", "label", "width", "vec", "mult", "p.*")
    links = dealt.groupBy("label", "width", "i", "j").applyInPandas(_compare(threshold), "gid long, n long, root long")
    links = store(links, "links")
    total = links.groupBy("gid").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    per_group = groups.select("gid", "label", "digest", "mult").join(total, "gid", "left").join(found.withColumnRenamed("node", "gid"), "gid", "left")
    per_group = per_group.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "gid").alias("root"))
    # what is joined to the rows is stored first, so that a group of very many rows can be split among tasks
    per_group = store(per_group, "per-group")
    member = rows.join(per_group, ["label", "digest"], "left").select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "uid").alias("root"))
    member = store(member, "members")
    drop(rows, groups, links, per_group)
    smallest = store(member.groupBy("root").agg(F.min("row.vec_id").alias("component_id")), "smallest")
    out = member.join(smallest, "root").select("row", "n_links", "component_id")
    return out.withColumn("kept", F.col("row.vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("row.vec_id", "n_links", "component_id", "kept")


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r AS (SELECT vec_id AS x, vec_id AS root FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x),
m AS (SELECT x, min(root) AS root FROM r GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, m.root AS component_id, m.root = v.vec_id AS kept
FROM v JOIN m ON m.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
