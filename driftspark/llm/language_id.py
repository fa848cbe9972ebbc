"""Language identification by hierarchical discrimination.

The family is predicted first, by one-versus-rest linear SVMs; within it, one-versus-one linear SVMs vote between
closely related languages. The features are hashed byte 1- to 4-grams of the whole lower-cased text; a classifier's
margin is the mean weight of a text's grams, so scoring is a table look-up per byte and grows with the text alone.
Grams of the training texts are counted in tasks; the driver gets at most DIMS numbers for each of the sampled rows.
Whether a text has a letter is asked of the package ``regex``, which every executor needs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import LOWER, remainder, slices, table, utf8

#: Families of common languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ne ur",
    "sinitic": "zh yue wuu",
}
DIMS = 1 << 14
#: Bytes of a text whose grams are counted at once.
PIECE = 1 << 20
#: Training rows of each language; their whole texts are learned from, as whole texts are scored.
ROWS_PER_LANGUAGE = 400


def family(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if base in members.split()), f"only {lang}")


def gram_ids(data: np.ndarray) -> list[np.ndarray]:
    """Hashed ids of the 1-, 2-, 3- and 4-grams that end at each byte; a gram over a text's start is the caller's to mask."""
    out, h = [], np.zeros(len(data), np.uint32)
    for n in range(1, 5):
        shifted = np.zeros(len(data), np.uint32)
        shifted[n - 1 :] = data[: len(data) - n + 1]
        h = (h * np.uint32(0x01000193)) ^ (shifted + np.uint32(n))
        out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32))
    return out


def _features(text: bytes) -> np.ndarray:
    """Relative frequencies of a text's grams."""
    counts, length = np.zeros(DIMS, np.float64), len(text) + 2
    padded = b" " + text + b" "
    for at in range(0, length, PIECE):  # a piece begins 3 bytes early, for the grams that end in it
        before = min(3, at)
        data = LOWER[np.frombuffer(padded[at - before : at + PIECE], np.uint8)]
        for n, ids in enumerate(gram_ids(data)):
            counts += np.bincount(ids[max(before, n - at + before) :], minlength=DIMS)
    return (counts / length).astype(np.float32)


def svm(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, steps: int = 300, reg: float = 1e-4, seed: int = 7) -> np.ndarray:
    """A linear SVM (squared hinge, averaged mini-batch subgradients) between two sets of rows of x; the last weight is the bias."""
    rng = np.random.default_rng(seed)
    scale = np.float32(1.0 / max(1e-9, float(np.mean([x[i] @ x[i] for i in positive[:50]])) + 0.01))
    w, bias = np.zeros(x.shape[1], np.float32), np.float32(0)
    mean, mean_bias = np.zeros(x.shape[1], np.float32), 0.0
    y = np.repeat(np.array([1, -1], np.float32), 64)
    for t in range(steps):
        part = x[np.concatenate([rng.choice(positive, 64), rng.choice(negative, 64)])]
        pull = np.maximum(np.float32(0), 1 - y * (part @ w + bias)) * y / np.float32(len(y))
        rate = scale * np.float32(0.5 / (1 + t / 100))
        w += rate * (pull @ part - np.float32(reg) * w)
        bias += rate * np.float32(0.01) * pull.sum()
        mean += w
        mean_bias += float(bias)
    return np.append(mean / steps, np.float32(mean_bias / steps))


def fit(sample: list[tuple[np.ndarray, str]]) -> dict:
    """Classifiers from (features, lang) rows: family against the rest, and each pair of languages in a family."""
    langs = sorted({lang for _, lang in sample})
    families = sorted({family(lang) for lang in langs})
    x = np.stack([f for f, _ in sample]) if sample else np.zeros((0, DIMS), np.float32)
    of = np.array([lang for _, lang in sample])
    fam = np.array([family(lang) for lang in of])
    pairs = [(a, b) for f in families for a, b in combinations([z for z in langs if family(z) == f], 2)]
    weights = [svm(x, np.flatnonzero(fam == f), np.flatnonzero(fam != f)) for f in (families if len(families) > 1 else [])]
    weights += [svm(x, np.flatnonzero(of == a), np.flatnonzero(of == b)) for a, b in pairs]
    w = np.array(weights, np.float32).reshape(len(weights), DIMS + 1)
    return {"langs": langs, "families": families, "pairs": pairs, "weights": w[:, :-1].copy(), "bias": w[:, -1].copy()}


def margins(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Margins of all classifiers for each text: mean weight of its grams plus bias."""
    n, weights = len(offsets) - 1, model["weights"]
    # a blank before and after each text, as in training
    length = np.diff(offsets)
    starts = offsets[:-1] + 2 * np.arange(n)
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, length)] = LOWER[data]
    ids = gram_ids(padded)
    out = np.empty((n, len(weights)))
    for k, w in enumerate(weights):
        total = w[ids[0]]
        for m in range(1, 4):
            value = w[ids[m]]
            for j in range(m):  # grams that would begin before the text
                value[np.minimum(starts + j, len(value) - 1)] = 0
            total += value
        out[:, k] = np.add.reduceat(total.astype(np.float64), starts) / (length + 2)
    return out + model["bias"]


def decide(model: dict, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, confidence 0 to 1) from the margins."""
    langs, families, pairs = model["langs"], model["families"], model["pairs"]
    n, nf = len(m), len(families) if len(families) > 1 else 0
    squash = lambda z: 1 / (1 + np.exp(-4 * np.clip(z, -20, 20)))
    fam = m[:, :nf].argmax(axis=1) if nf else np.zeros(n, int)
    sure = squash(m[np.arange(n), fam]) if nf else np.ones(n)
    votes, strength = np.zeros((n, len(langs))), np.zeros((n, len(langs)))
    for j, (a, b) in enumerate(pairs):
        p = squash(m[:, nf + j])
        ia, ib = langs.index(a), langs.index(b)
        votes[:, ia] += p > 0.5
        votes[:, ib] += p <= 0.5
        strength[:, ia] += p
        strength[:, ib] += 1 - p
    inside = np.array([[family(z) == f for z in langs] for f in families])[fam]
    size = inside.sum(axis=1)
    best = np.where(inside, votes + strength / (1 + len(langs)), -1).argmax(axis=1)
    within = np.where(size > 1, strength[np.arange(n), best] / np.maximum(1, size - 1), 1.0)
    return best, sure * within


def _counted(batches):
    """Arrow function: the grams of each text, as the places and values that aren't 0."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = _features(batch.column("text")[i].as_py().encode())
            at = np.flatnonzero(x)
            packed = [pa.array([a.tobytes()], pa.binary()) for a in (at.astype(np.uint16), x[at])]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, 1), batch.column("o").slice(i, 1), *packed], names=["lang", "o", "at", "x"])


def sample_rows(docs: DataFrame, lang: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[np.ndarray, str]]:
    """A bounded training sample: (features of the whole text, language) for per_language texts of each language by a hash of the text.

    Rows without a language or text are left out; a text that repeats in a language counts once. Features are made in tasks.
    """
    rows = docs.where(f"{lang} is not null and length(text) > 0").select(F.col(lang).alias("lang"), "text", F.xxhash64("text", F.lit(11)).alias("o"))
    counts = rows.groupBy("lang").count()
    rate = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("count"))
    part = (F.pmod("o", F.lit(1 << 20)) / (1 << 20)) < rate
    drawn = rows.join(F.broadcast(counts), "lang").where(part).groupBy("lang").agg(F.collect_set("o").alias("os"))
    picked = drawn.select("lang", F.explode(F.slice(F.array_sort("os"), 1, per_language)).alias("o"))
    found = rows.join(F.broadcast(picked), ["lang", "o"]).mapInArrow(_counted, "lang string, o long, at binary, x binary").dropDuplicates(["lang", "o"])
    out = []
    for r in found.orderBy("lang", "o").toLocalIterator():
        x = np.zeros(DIMS, np.float32)
        x[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.x, np.float32)
        out.append((x, r.lang))
    return out


def _predict(shared):
    def run(batches):
        import regex

        model = shared.value
        letter = regex.compile(r"\p{L}")
        langs = pa.array(model["langs"], pa.string())
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            # a byte that is an ASCII letter settles it; other texts are searched for a letter of any script
            for lo, hi in slices(offsets):
                off = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                ascii_letter = np.concatenate([[0], np.cumsum(((part | 32) >= 97) & ((part | 32) <= 122))])
                lettered = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
                for i in np.flatnonzero(~lettered):
                    lettered[i] = bool(letter.search(part[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
                if model["langs"]:
                    best, score = decide(model, margins(model, part, off))
                else:
                    best, score, lettered = np.zeros(hi - lo, int), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                predicted = pa.array(np.where(lettered, best, -1)).cast(pa.int32())
                names = langs.take(pa.array(np.where(lettered, best, 0))) if model["langs"] else pa.nulls(hi - lo, pa.string())
                names = pa.compute.if_else(pa.compute.equal(predicted, -1), "und", names)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), names, pa.array(np.where(lettered, score, 0.0))], names=["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """row (a struct of the columns of docs but text), lang_pred and score (0 to 1) of each whole text.

    A text that is null, empty or without a letter is ``und`` with score 0, and so is every text if no language was
    learned. The model is a fixed number of weights per classifier, so broadcasting it doesn't grow with the data.
    """
    rest = [c for c in docs.columns if c != "text"]
    source = docs.select("text", F.struct(*rest).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(_predict(shared), f"row {source.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(sample_rows(docs.where("not held_out")))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")
