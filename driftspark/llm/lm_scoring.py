"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Each byte of the lower-cased text (0xFF ends a text and pads its start; UTF-8 has no such byte) is coded as eight
binary decisions. Decision node v in the context of the last d bytes has Krichevsky-Trofimov counts (a, b) for every
d = 0..DEPTH. Its weighted probability is P_w = 1/2 P_kt + 1/2 prod P_w(one byte longer), so a prediction mixes the
KT estimates of all depths along the context's path, each with weight P_kt / 2 P_w; a path ends at the longest context
that was seen, or at DEPTH.

As jobs: (1) count the (DEPTH+1)-grams of all texts, those of training texts apart, map-side first; (2) deal the
grams out by their ROOT most recent context bytes, so that whole subtrees meet, and work bottom-up in numpy; what
leaves a subtree is one row per node of depth ROOT - 1, of which there are at most 256**(ROOT-1) * 255 whatever the
input; (3) give each distinct gram its log-probability; (4) add these up per text: the most frequent grams (a fixed
number) are broadcast, the rest are joined. The table of grams grows with the corpus and never reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import LOWER, remainder, slices, store, table, utf8

DEPTH, ROOT = 5, 3
END = 0xFF
#: Most frequent grams and words that every task gets; the others are joined.
HOT_GRAMS, HOT_WORDS = 1 << 19, 1 << 17
_LN2, _LN10 = np.log(2.0), np.log(10.0)


# ---------------------------------------------------------------- grams


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets) of the grams of lower-cased texts, one per byte and one for the end.

    A key is the last byte of the context, the one before it, ..., and in its lowest byte the byte that follows.
    """
    n = len(offsets) - 1
    length = np.diff(offsets)
    pad = DEPTH + 1
    starts = offsets[:-1] + pad * np.arange(n)
    stream = np.full(len(data) + pad * n, END, np.uint8)
    stream[np.arange(len(data)) + np.repeat(pad * np.arange(n) + DEPTH, length)] = data
    keys = stream.astype(np.int64)
    for d in range(1, DEPTH + 1):
        keys[DEPTH:] |= stream[DEPTH - d : len(stream) - d].astype(np.int64) << (8 * (DEPTH - d + 1))
    # the first DEPTH values of each text are padding alone
    ok = np.ones(len(stream), bool)
    for d in range(DEPTH):
        ok[starts + d] = False
    return keys[ok], offsets + np.arange(n + 1)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first, axis=0) if len(first) else c


def _count(batches):
    """Arrow function: text, learn -> per task the grams with their counts in all and in training texts, and the words of the training texts."""
    from collections import Counter

    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0
    vocabulary: Counter = Counter()

    def emit():
        nonlocal keys, counts, held
        k, c = _merge(keys, counts)
        keys, counts, held = [], [], 0
        for i in range(0, len(k), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[j]), pa.nulls(len(k[j]), pa.binary()), pa.array(c[j, 0]), pa.array(c[j, 1])], names=["gram", "word", "n", "learned"])

    def emit_words():
        items = list(vocabulary.items())
        vocabulary.clear()
        for i in range(0, len(items), 100_000):
            part = items[i : i + 100_000]
            n = pa.array([c for _, c in part], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), n, n], names=["gram", "word", "n", "learned"])

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in slices(offsets):
            off = offsets[lo : hi + 1] - offsets[lo]
            part = LOWER[data[offsets[lo] : offsets[hi]]]
            k, ends = gram_keys(part, off)
            taught = np.repeat(learn[lo:hi], np.diff(ends))
            codes, distinct = pd.factorize(k)
            c = np.stack([np.bincount(codes, minlength=len(distinct)), np.bincount(codes[taught], minlength=len(distinct))], axis=1)
            keys.append(distinct)
            counts.append(c)
            held += len(distinct)
            whole = part.tobytes()
            for i in np.flatnonzero(learn[lo:hi]):
                vocabulary.update(whole[off[i] : off[i + 1]].split())
            if held > 2_000_000:
                keys, counts = ([x] for x in _merge(keys, counts))
                held = len(keys[0])
                if held > 1_500_000:
                    yield from emit()
            if len(vocabulary) > 400_000:
                yield from emit_words()
    if keys:
        yield from emit()
    yield from emit_words()


# ---------------------------------------------------------------- the tree

_LOG = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])  # log n!
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 4096) + 0.5))])  # log (1/2)(3/2)...(n-1/2)


def _stirling(z: np.ndarray) -> np.ndarray:
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def half(n):
        big = np.maximum(n, 4096) + 0.5
        return np.where(n <= 4096, _HALF[np.minimum(n, 4096)], _stirling(big) - 0.5 * np.log(np.pi))

    total = a + b
    fact = np.where(total <= 4096, _LOG[np.minimum(total, 4096)], _stirling(np.maximum(total, 4096) + 1.0))
    return half(a) + half(b) - fact


def _level(keys: np.ndarray, learned: np.ndarray, d: int):
    """Of sorted grams: the distinct (last d bytes, next byte) with their counts, and the place of each gram's."""
    short = ((keys >> (8 * (DEPTH - d + 1))) << 8) | (keys & 255)
    distinct, at = np.unique(short, return_inverse=True)
    return distinct, np.bincount(at, learned, len(distinct)).astype(np.int64), at


def subtree(keys: np.ndarray, learned: np.ndarray):
    """Nodes of depths ROOT..DEPTH over sorted distinct grams.

    Returns (levels, roots): levels[d][j] = (place of each gram's node, KT probability of a one, weight of the node's own
    estimate, seen) for bit j; roots[j] = (node of depth ROOT, zeros, ones, log P_w).
    """
    levels: dict[int, list] = {}
    below: list | None = None
    for d in range(DEPTH, ROOT - 1, -1):
        distinct, n, at = _level(keys, learned, d)
        context, byte = distinct >> 8, distinct & 255
        levels[d], own = [], []
        for j in range(8):
            node = (context << 8) | (1 << j) | (byte >> (8 - j))
            new = np.concatenate([[True], node[1:] != node[:-1]])
            first, place = np.flatnonzero(new), np.cumsum(new) - 1
            bit = (byte >> (7 - j)) & 1
            ones = np.add.reduceat(n * bit, first)
            zeros = np.add.reduceat(n, first) - ones
            kt = log_kt(zeros, ones)
            if below is None:
                weighted, weight = kt, np.ones(len(kt))
            else:
                child, value = below[j]
                parent = np.searchsorted(node[first], ((child >> 16) << 8) | (child & 255))
                split = np.bincount(parent, value, len(first))
                weighted = np.logaddexp(kt, split) - _LN2
                weight = np.exp(np.minimum(0.0, kt - _LN2 - weighted))
            seen = zeros + ones > 0
            levels[d].append((place[at], (ones + 0.5) / (zeros + ones + 1.0), weight, seen))
            own.append((node[first], np.where(seen, weighted, 0.0)))
            if d == ROOT:
                roots = levels.setdefault(-1, [])
                roots.append((node[first][seen], zeros[seen], ones[seen], weighted[seen]))
        below = own
    return levels, levels.pop(-1)


def _whole_subtrees(batches, columns: list[str]):
    """From batches sorted by gram, arrays that hold whole subtrees below the ROOT most recent bytes."""
    shift = 8 * (DEPTH + 1 - ROOT)
    kept: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        rows += batch.num_rows
        if rows >= 200_000:
            all_of = [np.concatenate(x) for x in zip(*kept, strict=True)]
            root = all_of[0] >> shift
            cut = int(np.searchsorted(root, root[-1]))
            if cut:
                yield [x[:cut] for x in all_of]
            kept, rows = [[x[cut:] for x in all_of]], len(root) - cut
    if rows:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _roots(batches):
    """Arrow function: sorted gram, learned -> nodes of depth ROOT - 1: zeros, ones and the log P_w of what lies below them."""
    for keys, learned in _whole_subtrees(batches, ["gram", "learned"]):
        _, roots = subtree(keys, learned)
        for node, zeros, ones, weighted in roots:
            parent = ((node >> 16) << 8) | (node & 255)
            distinct, at = np.unique(parent, return_inverse=True)
            sums = [np.bincount(at, x, len(distinct)) for x in (zeros, ones, weighted)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], names=["node", "zeros", "ones", "below"]
            )


class Top:
    """Nodes of depths 0..ROOT-1: the share of a prediction that they decide, and the share left to deeper contexts."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        order = np.argsort(node)
        node, zeros, ones, below = node[order], zeros[order], ones[order], below[order]
        self.levels: list[tuple] = []
        for d in range(ROOT - 1, -1, -1):
            kt = log_kt(zeros, ones)
            weighted = np.logaddexp(kt, below) - _LN2
            weight = np.exp(np.minimum(0.0, kt - _LN2 - weighted))
            self.levels.insert(0, (node, (ones + 0.5) / (zeros + ones + 1.0), weight))
            if d:
                parent = ((node >> 16) << 8) | (node & 255)
                node, at = np.unique(parent, return_inverse=True)
                zeros, ones, below = (np.bincount(at, x, len(node)) for x in (zeros, ones, weighted))
                zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)

    def mix(self, keys: np.ndarray, j: int, bit: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """Probability of the bit, given that of the deeper contexts (nan where none was seen)."""
        p = deep
        prefix = (1 << j) | ((keys & 255) >> (8 - j))
        for d in range(ROOT - 1, -1, -1):
            node, one, weight = self.levels[d]
            wanted = ((keys >> (8 * (DEPTH - d + 1))) << 8) | prefix
            if not len(node):
                p = np.where(np.isnan(p), 0.5, p)
                continue
            at = np.minimum(np.searchsorted(node, wanted), len(node) - 1)
            there = node[at] == wanted
            kt = np.where(bit == 1, one[at], 1 - one[at])
            mixed = np.where(np.isnan(p), kt, weight[at] * kt + (1 - weight[at]) * p)
            p = np.where(there, mixed, p)
        return np.where(np.isnan(p), 0.5, p)


def log_probabilities(keys: np.ndarray, learned: np.ndarray, top: Top) -> np.ndarray:
    """Natural log-probability of each gram's last byte in its context."""
    levels, _ = subtree(keys, learned)
    out = np.zeros(len(keys))
    for j in range(8):
        bit = (keys >> (7 - j)) & 1
        p = np.full(len(keys), np.nan)
        for d in range(DEPTH, ROOT - 1, -1):
            place, one, weight, seen = levels[d][j]
            kt = one[place]
            kt = np.where(bit == 1, kt, 1 - kt)
            w = weight[place]
            mixed = np.where(np.isnan(p), kt, w * kt + (1 - w) * p)
            p = np.where(seen[place], mixed, p)
        out += np.log(top.mix(keys, j, bit, p))
    return out


def _score_grams(shared):
    def run(batches):
        top = shared.value
        for keys, learned, n in _whole_subtrees(batches, ["gram", "learned", "n"]):
            value = log_probabilities(keys, learned, top) / _LN10
            for i in range(0, len(keys), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[j]), pa.array(n[j]), pa.array(value[j])], names=["gram", "n", "value"])

    return run


# ---------------------------------------------------------------- texts


def _sum_hot(shared):
    """Arrow function: text -> per text, sums over the broadcast grams and words, and the others with their numbers."""

    def run(batches):
        from collections import Counter

        grams, words = shared.value
        index, values = pd.Index(grams["gram"].to_numpy()), grams["value"].to_numpy()
        words = dict(zip(words["word"].to_pylist(), words["value"].to_pylist(), strict=True))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets):
                off = offsets[lo : hi + 1] - offsets[lo]
                part = LOWER[data[offsets[lo] : offsets[hi]]]
                n = hi - lo
                k, ends = gram_keys(part, off)
                codes, distinct = pd.factorize(k)
                place = index.get_indexer(distinct) if len(index) else np.full(len(distinct), -1)
                value = np.where(place >= 0, values[np.maximum(place, 0)], 0.0) if len(index) else np.zeros(len(distinct))
                hot = np.add.reduceat(value[codes], ends[:-1])
                rare = np.flatnonzero(place[codes] < 0)
                row = np.searchsorted(ends, rare, "right") - 1
                order = np.lexsort((k[rare], row))
                row, gram = row[order], k[rare][order]
                new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])) if len(gram) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(gram)))
                rare_cut = pa.array(np.searchsorted(row[new], np.arange(n + 1)).astype(np.int32))
                whole = part.tobytes()
                base, tokens, known = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                cold: list[list[dict]] = []
                get = words.get
                for i in range(n):
                    split = whole[off[i] : off[i + 1]].split()
                    found = [get(w) for w in split]
                    there = [x for x in found if x is not None]
                    tokens[i], known[i], base[i] = len(split), len(there), sum(there)
                    cold.append([{"word": w, "n": c} for w, c in Counter(w for w, x in zip(split, found, strict=True) if x is None).items()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(lo, n),
                        pa.array(tokens),
                        pa.array(known),
                        pa.array(base),
                        pa.array(hot),
                        pa.ListArray.from_arrays(rare_cut, pa.array(gram[new])),
                        pa.ListArray.from_arrays(rare_cut, pa.array(times)),
                        pa.array(cold, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
                    ],
                    names=["row", "words", "known", "base", "hot", "rare", "times", "cold"],
                )

    return run


def score(docs: DataFrame, learn) -> DataFrame:
    """Code length of every row of docs under a model of the rows where the condition ``learn`` holds.

    Returns row (a struct of the columns of docs but text), n_tokens, n_known, train_tokens, base_score, score (log10 of the
    text's probability), n_bytes and bits_per_byte (of the text and its end). Null texts count as empty; an empty text has
    the end alone. A null of ``learn`` counts as false. Without training rows every bit has probability 1/2 and the base
    score is 0. Repeated rows each count and each get a row. Memory: a batch's grams, one subtree of the ROOT most recent
    bytes, and the broadcast of HOT_GRAMS + HOT_WORDS entries.
    """
    spark = docs.sparkSession
    learning = F.coalesce(learn, F.lit(False))
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text"), learning.alias("learn")).mapInArrow(_count, "gram long, word binary, n long, learned long")
    # grams and words come from one reading of the texts and are added up in one shuffle
    counted = store(counted.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned")), "lm-counts")
    words = counted.where("word is not null").select("word", F.col("n").alias("c"))
    taught = docs.where(learning).count()
    seen = words.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    total, distinct = (seen.n or 0) + taught, seen.v + (taught > 0)
    log_denominator = float(np.log10(total + distinct + 1))
    # at most 256 ** (ROOT - 1) * 255 rows, far fewer in UTF-8 text
    root = F.shiftright("gram", 8 * (DEPTH + 1 - ROOT))
    dealt = counted.where("gram is not null").select("gram", "learned", "n").repartition(root).sortWithinPartitions("gram")
    top = dealt.mapInArrow(_roots, "node long, zeros long, ones long, below double").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    top = top.toArrow()
    model = spark.sparkContext.broadcast(Top(*(top.column(c).to_numpy() for c in ("node", "zeros", "ones", "below"))))
    valued = store(dealt.mapInArrow(_score_grams(model), "gram long, n long, value double"), "lm-values")

    def threshold(df: DataFrame, n: str, most: int) -> int:
        """The smallest count that at most ``most`` rows reach, from a histogram by powers of 2 to the quarter."""
        steps = df.groupBy(F.floor(F.log2(n) * 4).alias("step")).count().orderBy(F.desc("step")).collect()  # at most 256 rows
        below, reached = 1 << 62, 0
        for r in steps:
            reached += r["count"]
            if reached > most:
                break
            below = int(np.ceil(2 ** (r.step / 4) - 1e-9))
        return below

    hot_grams = valued.where(F.col("n") >= threshold(valued, "n", HOT_GRAMS)).select("gram", "value").toArrow()
    hot_words = words.where(F.col("c") >= threshold(words, "c", HOT_WORDS)).select("word", F.log10(F.col("c") + 1).alias("value")).toArrow()
    hot = spark.sparkContext.broadcast((hot_grams.combine_chunks(), hot_words.combine_chunks()))
    rest = [c for c in docs.columns if c != "text"]
    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.struct(*rest).alias("row")).alias("row"))
    kind = f"row {source.schema['row'].dataType.simpleString()}, words long, known long, base double, hot double, rare array<long>, times array<long>, cold array<struct<word:binary,n:long>>"
    texts = store(source.mapInArrow(_sum_hot(hot), kind).withColumn("uid", F.monotonically_increasing_id()), "lm-texts")
    rare = texts.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("gram"), "r.times")
    rare = rare.join(valued, "gram").groupBy("uid").agg(F.sum(F.col("times") * F.col("value")).alias("rare_score"))
    cold = texts.select("uid", F.explode("cold").alias("w")).select("uid", "w.word", F.col("w.n").alias("times"))
    cold = cold.join(words, "word").groupBy("uid").agg(F.sum("times").alias("cold_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("cold_base"))
    zero = F.lit(0)
    n_tokens = F.col("words") + 1
    base = F.col("base") + F.coalesce("cold_base", zero) + F.lit(float(np.log10(taught + 1))) - n_tokens * F.lit(log_denominator)
    result = F.col("hot") + F.coalesce("rare_score", zero)
    return (
        texts.drop("rare", "times", "cold")
        .join(rare, "uid", "left")
        .join(cold, "uid", "left")
        .select(
            F.col("row.row").alias("row"),
            n_tokens.alias("n_tokens"),
            (F.col("known") + F.coalesce("cold_known", zero) + F.lit(int(taught > 0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            result.alias("score"),
            F.col("row.bytes").alias("n_bytes"),
            (-result / F.lit(float(np.log10(2))) / (F.col("row.bytes") + 1)).alias("bits_per_byte"),
        )
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 7) == 2)
    scored = score(docs, ~F.col("held_out"))
    return scored.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
