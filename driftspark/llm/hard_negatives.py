"""Hard-negative mining by threshold joins in the manner of L2AP, on integer vectors.

A window asks for the first k rows, by descending score, among those whose score with an anchor lies between two bounds.
Anchors and rows are dealt into parts of bounded size, and each part of anchors meets each part of rows in a task. There the
dimensions are ordered by the rows' energy in them and cut into segments. The inverted index holds of each row
only the segments before the first at which the norm of the row's rest, times an anchor's, stays below the threshold: what
it leaves out can't reach the threshold alone. Partial scores are accumulated segment by segment over the index; a pair
ends as soon as its partial score and the norms of the rests exclude its window. What remains is scored exactly, in integers.

Thresholds: first each anchor meets one part of the rows, where its windows' thresholds are lowered until they fill (or
reach their lower bounds). The last score of a window that fills is a threshold that its final rows can't fall below; with
these the anchors then meet all parts, and the windows' first k over all parts are the result, which is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import drop, store, table

#: Components of a part's vectors, anchors that are compared at once, dimensions in a segment.
PART, SLICE, SEGMENT = 1 << 18, 128, 8
#: Components of this absolute value or more aren't scored: sums of their products may not fit 64 bits.
LARGEST = 1 << 24
#: Share of the best possible score where the lowering of a threshold begins, and the factor of each step.
START, STEP = 0.9, 0.6

_NONE = -(1 << 62)
_FOUND = "anchor_id long, slot int, vec_id long, score long"
_KEEPS_FLOAT = float(1 << 52)


class _Rows:
    """A part of the rows: vectors with the dimensions in the order of their energy, and the norms of their rests."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.v, self.ids, self.labels = vectors[:, self.order], ids, labels
        self.edges = [*range(0, vectors.shape[1], SEGMENT), vectors.shape[1]]
        self.rest = _rests(self.v, self.edges)
        self.f = self.v.astype(np.float64)


def _rests(v: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norm of each vector from each edge on, a hair too large rather than too small."""
    squares = np.zeros((len(v), v.shape[1] + 1))
    squares[:, :-1] = np.cumsum((v.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(squares[:, edges]) * (1 + 1e-9)


def _pairs(a: np.ndarray, a_labels: np.ndarray, a_ids: np.ndarray, rows: _Rows, least: np.ndarray, most: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with least <= score <= most (bounds of each anchor) and labels equal or, without ``same``, unequal."""
    a = a[:, rows.order]
    rest = _rests(a, rows.edges)
    exact = len(a) and float(np.abs(a).max(initial=0)) * float(np.abs(rows.v).max(initial=0)) * max(1, a.shape[1]) < _KEEPS_FLOAT
    af = a.astype(np.float64)
    steps = len(rows.edges) - 1
    # rows whose rest from an edge on can reach a threshold with some anchor are in the index up to there, at least
    floor = least.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(floor[:, None] > 0, np.where(rest > 0, floor[:, None] / rest, np.inf), -np.inf).min(axis=0, initial=np.inf)
    indexed = (rows.rest[:, :-1] >= need[:-1] * (1 - 1e-9)).sum(axis=1)
    postings = np.argsort(-indexed, kind="stable")
    out_a, out_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(a), SLICE):
        part = slice(lo, min(lo + SLICE, len(a)))
        columns = postings[: int((indexed > 0).sum())] if steps else postings
        alive = (a_labels[part, None] == rows.labels[columns]) == same
        alive &= a_ids[part, None] != rows.ids[columns]
        partial = np.zeros(alive.shape)
        for p in range(steps):
            if not alive.any():
                break
            n = int((indexed[columns] > p).sum())  # the postings of this segment are the first n columns
            cut = slice(rows.edges[p], rows.edges[p + 1])
            partial[:, :n] += af[part, cut] @ rows.f[columns[:n], cut].T
            # a row that the index has left keeps its rest from where it left
            at = np.minimum(p + 1, indexed[columns])
            slack = rest[part][:, at] * rows.rest[columns, at]
            slack += 1e-12 * rest[part, :1] * rows.rest[columns, 0]
            alive &= (partial + slack >= floor[part, None]) & (partial - slack <= most[part, None])
            kept = alive.any(axis=0)
            if kept.sum() < 0.7 * len(kept):
                columns, alive, partial = columns[kept], alive[:, kept], partial[:, kept]
        i, j = np.nonzero(alive)
        out_a.append(i + lo)
        out_r.append(columns[j])
    i, j = np.concatenate(out_a), np.concatenate(out_r)
    score = np.empty(len(i), np.int64)
    for lo in range(0, len(i), 1 << 16):
        at = slice(lo, lo + (1 << 16))
        score[at] = np.rint(np.einsum("ij,ij->i", af[i[at]], rows.f[j[at]])).astype(np.int64) if exact else np.einsum("ij,ij->i", a[i[at]], rows.v[j[at]])
    fits = (score >= least[i]) & (score <= most[i])
    return i[fits], j[fits], score[fits]


def _first(i: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Places, among pairs of anchors i, of the first k of each anchor by score and id that are ok."""
    at = np.flatnonzero(ok)
    at = at[np.lexsort((ids[at], -score[at], i[at]))]
    anchor = i[at]
    rank = np.arange(len(at)) - np.searchsorted(anchor, anchor)
    return at[rank < k]


def _search(df: pd.DataFrame, k: int, same: bool, lower: bool) -> pd.DataFrame:
    """The first k rows, of the part in df, for each window of the anchors in df. lower: begin high and lower until windows fill."""
    anchors, others = df[df.side == 1], df[df.side == 0]
    if anchors.empty or others.empty:
        return pd.DataFrame({"anchor_id": pd.Series(dtype="int64"), "slot": pd.Series(dtype="int32"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    matrix = lambda c: np.array([np.asarray(x, np.int64) for x in c], np.int64).reshape(len(c), -1)
    labels = pd.factorize(df.label)[0]
    rows = _Rows(matrix(others.vec), others.vec_id.to_numpy(), labels[(df.side == 0).to_numpy()])
    a, a_ids, a_labels = matrix(anchors.vec), anchors.vec_id.to_numpy(), labels[(df.side == 1).to_numpy()]
    m, slots = len(a), max(len(w) for w in anchors.low)
    low, high = np.full((m, slots), 1 << 62, np.int64), np.full((m, slots), _NONE, np.int64)
    for n, (lo, hi) in enumerate(zip(anchors.low, anchors.high, strict=True)):
        low[n, : len(lo)], high[n, : len(hi)] = lo, hi
    asked = low <= high
    out: list[pd.DataFrame] = []
    threshold, todo = low.copy(), asked.copy()
    if lower:
        best = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) * (rows.rest[:, 0].max() if a.shape[1] else 0.0)
        threshold = np.maximum(low, (START * np.minimum(high, best[:, None])).astype(np.int64))
    while todo.any():
        at = np.flatnonzero(todo.any(axis=1))
        least = np.where(todo, threshold, 1 << 62)[at].min(axis=1)
        most = np.where(todo, high, _NONE)[at].max(axis=1)
        i, j, score = _pairs(a[at], a_labels[at], a_ids[at], rows, least, most, same)
        ids = rows.ids[j]
        for slot in range(slots):
            ok = todo[at, slot][i] & (score >= threshold[at, slot][i]) & (score <= high[at, slot][i])
            pick = _first(i, score, ids, ok, k)
            full = np.bincount(i[pick], minlength=len(at)) >= k
            done = todo[at, slot] & (full | (threshold[at, slot] <= low[at, slot]))
            pick = pick[done[i[pick]]]
            out.append(pd.DataFrame({"anchor_id": a_ids[at][i[pick]], "slot": np.full(len(pick), slot, np.int32), "vec_id": ids[pick], "score": score[pick]}))
            todo[at[done], slot] = False
        lowered = (STEP * threshold).astype(np.int64)
        threshold = np.maximum(low, np.where(lowered > 64, lowered, _NONE))
    return pd.concat(out, ignore_index=True)


def _run(k: int, same: bool, lower: bool):
    return lambda df: _search(df, k, same, lower)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window over all parts; ranks are limited in the tasks before the shuffle too."""
    rank = F.expr("row_number() over (partition by anchor_id, slot order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _meet(rows: DataFrame, anchors: DataFrame, by: list[str], k: int, same: bool) -> DataFrame:
    """anchor_id, slot, vec_id, score, rank: the first k rows of each window of anchors(vec_id, label, width, vec, low, high).

    low and high are arrays with the bounds of an anchor's windows. ``by`` names the columns in which anchors and rows must agree.
    """
    part = lambda of: F.ceil(F.count("*") / F.greatest(F.lit(1), F.floor(F.lit(PART) / F.greatest(F.lit(1), of)))).cast("int")
    parts = rows.groupBy(*by).agg(part(F.first("width")).alias("row_parts")).join(anchors.groupBy(*by).agg(part(F.first("width")).alias("anchor_parts")), by)
    parts = store(parts, "negatives-parts")
    no_window = F.array().cast("array<bigint>")
    columns = ["width", "label", "vec_id", "vec", "low", "high", "side"]
    placed = rows.join(parts, by).withColumns({"row_part": F.pmod(F.xxhash64("vec_id"), F.col("row_parts")).cast("int"), "low": no_window, "high": no_window, "side": F.lit(0)})
    asking = anchors.join(parts, by).withColumns({"own": F.pmod(F.xxhash64("vec_id"), F.col("row_parts")).cast("int"), "anchor_part": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("anchor_parts")).cast("int"), "side": F.lit(1)})
    keys = [c for c in by if c not in columns]
    # one part of the rows, in which thresholds are lowered until windows fill
    own = placed.select(*columns, *keys, "row_part").unionByName(asking.select(*columns, *keys, F.col("own").alias("row_part")))
    seeds = store(own.groupBy(*by, "row_part").applyInPandas(_run(k, same, True), _FOUND), "negatives-seeds")
    floors = seeds.groupBy("anchor_id", "slot").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    floors = floors.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))
    # all parts, from the thresholds found
    raised = F.transform("low", lambda x, s: F.greatest(x, F.coalesce(F.element_at("floors", s), x)))
    asking = asking.join(floors.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left").withColumn("low", raised)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = placed.select(*columns, *keys, "row_part", every("anchor_parts").alias("anchor_part")).unionByName(asking.select(*columns, *keys, every("row_parts").alias("row_part"), "anchor_part"))
    found = store(met.groupBy(*by, "row_part", "anchor_part").applyInPandas(_run(k, same, False), _FOUND), "negatives-found")
    best = store(_best(found, k), "negatives-best")
    drop(parts, seeds, found)
    return best


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """vectors(vec_id: long, label, vec: array<bigint>, ...) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: condition of the rows that are anchors. An anchor's positives are its first rows of the same label by score (ties by vec_id);
    its negatives for each are the first rows of another label whose score is ``low`` to ``high`` percent of the positive's. Rows with a null
    vec_id, label, vector or component, or a component of LARGEST or more, take no part. Rows that repeat a vec_id count
    once, the smallest by label and vector. Vectors of different widths have no score with each other. An anchor without
    positives, a positive without negatives and an empty table give no rows. Columns of vectors other than these aren't read, so none clashes.
    """
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "vec", anchor.alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "anchor")).alias("m")).select("vec_id", "m.label", F.size("m.vec").alias("width"), "m.vec", "m.anchor")
    rows = store(rows, "negatives-rows")
    anchors = rows.where("anchor").drop("anchor")
    one = lambda x: F.array(F.lit(x).cast("bigint"))
    pos = _meet(rows.drop("anchor"), anchors.withColumns({"low": one(_NONE), "high": one(1 << 61)}), ["label", "width"], positives, True)
    windows = pos.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("w")).withColumnRenamed("anchor_id", "vec_id")
    # whole bounds: low * p <= 100 * n <= high * p has no n where p is negative
    lows = F.expr(f"transform(w, p -> IF(p.score < 0, 1L, ({low} * p.score + 99) div 100))")
    highs = F.expr(f"transform(w, p -> IF(p.score < 0, 0L, ({high} * p.score) div 100))")
    neg = _meet(rows.drop("anchor"), anchors.join(windows, "vec_id").withColumns({"low": lows, "high": highs}).drop("w"), ["width"], negatives, False)
    said = pos.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = neg.join(said, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; every row is searched. Labels and components are first changed as the contract says."""
    e = table(spark, sf_dir, "embeddings")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return mine(e.where(whole).select("vec_id", label.alias("label"), vec.alias("vec")), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 10
"""
