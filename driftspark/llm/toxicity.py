"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is an embedding of the word (hashed; zero until learned) beside the mean embedding of its character
trigrams, so unseen spellings still have one. Forward and backward GRUs read WINDOW words; attention pools their states;
a document's score is the highest of all its overlapping windows, calibrated on documents. The network is trained in
numpy on the driver from a bounded sample of labelled rows. Tasks read the whole text of each of these and choose the
windows that the driver learns from: those with the strongest words, and others drawn over the whole text; the calibration
takes every window of them. Scoring covers every window of every whole text, in tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import LOWER, NOT_ALNUM, bounds, drop, give_back, giving_back, remainder, slices, spans, store, table, utf8

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN, ATTENTION = 1 << 13, 1 << 13, 12, 8, 8
#: Labelled rows of either class to learn from; scoring has no such bound.
TOXIC_ROWS, CLEAN_ROWS = 1000, 3000
#: Windows of each of them that the driver gets: so many of the strongest, and so many drawn from all others.
STRONG, DRAWN = 16, 32
#: Words whose log-odds tell the strongest windows.
ODDS_WORDS = 1 << 16
EPOCHS, BATCH, RATE = 20, 128, 0.01
#: Words whose trigrams are held at once.
PORTION = 1 << 14


# ---------------------------------------------------------------- inputs


def word_inputs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its row among the word embeddings, and its trigrams' rows among the character ones with their bounds."""
    length = ends - starts
    cut = np.concatenate([[0], np.cumsum(length)])
    tri = np.empty(cut[-1], np.int32)
    for s in range(0, len(starts), PORTION):
        c = cut[s : s + PORTION + 1]
        n = length[s : s + PORTION]
        inside = np.arange(c[-1] - c[0]) - np.repeat(c[:-1] - c[0], n)
        at = np.repeat(starts[s : s + PORTION], n) + inside
        byte = data[at].astype(np.uint32)
        before = np.where(inside > 0, data[np.maximum(at - 1, 0)], 2).astype(np.uint32)
        after = np.where(inside < np.repeat(n, n) - 1, data[np.minimum(at + 1, len(data) - 1)], 3).astype(np.uint32)
        tri[c[0] : c[-1]] = (((before * np.uint32(65599) + byte) * np.uint32(65599) + after) * np.uint32(0x9E3779B1)) >> np.uint32(19)
    return (h % np.uint64(WORD_ROWS)).astype(np.int64), tri, cut


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end of the text's words, bounds) of the overlapping windows of texts whose words begin at first: every text has at least one."""
    n = np.diff(first)
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
    cut = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = first[:-1][row] + (np.arange(cut[-1]) - cut[row]) * STRIDE
    return start, first[1:][row], cut


def unfold(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of each place of some windows."""
    inside = start[:, None] + np.arange(WINDOW)
    mask = inside < end[:, None]
    return codes[np.where(mask, inside, 0)] if len(codes) else np.zeros(mask.shape, np.int64), mask


# ---------------------------------------------------------------- network


def new_network(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    net = {"words": np.zeros((WORD_ROWS, WIDTH), np.float32), "chars": rng.normal(0, 0.3, (CHAR_ROWS, WIDTH)).astype(np.float32)}
    for d in "fb":
        net |= {f"{d}x": draw(2 * WIDTH, 3 * HIDDEN), f"{d}0": np.zeros(3 * HIDDEN, np.float32), f"{d}g": draw(HIDDEN, 2 * HIDDEN), f"{d}n": draw(HIDDEN, HIDDEN)}
    return net | {"a": draw(2 * HIDDEN, ATTENTION), "v": draw(ATTENTION, 1)[:, 0], "o": draw(2 * HIDDEN, 1)[:, 0], "o0": np.zeros(1, np.float32)}


def embed(net: dict, word: np.ndarray, tri: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Inputs of words: their own embedding and the mean of their trigrams', whose rows are gathered for a portion of the words at a time."""
    out = np.zeros((len(word), 2 * WIDTH), np.float32)
    out[:, :WIDTH] = net["words"][word]
    for s in range(0, len(word), PORTION):
        c = cut[s : s + PORTION + 1]
        out[s : s + PORTION, WIDTH:] = np.add.reduceat(net["chars"][tri[c[0] : c[-1]]], c[:-1] - c[0], axis=0) / np.diff(c)[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def forward(net: dict, x: np.ndarray, places: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows over words with inputs x; with keep, what the gradient needs too."""
    n, steps = places.shape
    states = np.empty((n, steps, 2 * HIDDEN), np.float32)
    memo: dict = {}
    for k, d in enumerate("fb"):
        projected = x @ net[f"{d}x"] + net[f"{d}0"] if len(x) else np.zeros((1, 3 * HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            p, on = projected[places[:, t]], mask[:, t, None]
            gates = _sigmoid(p[:, : 2 * HIDDEN] + h @ net[f"{d}g"])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(p[:, 2 * HIDDEN :] + (r * h) @ net[f"{d}n"])
            after = np.where(on, new + z * (h - new), h)
            if keep:
                memo[d, t] = (h, z, r, new)
            states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = after
            h = after
    u = np.tanh(states @ net["a"])
    e = np.where(mask, u @ net["v"], -30)
    e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
    alpha = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
    pooled = (alpha[:, None, :] @ states)[:, 0]
    logit = pooled @ net["o"] + net["o0"][0]
    return (logit, (states, u, alpha, pooled, memo)) if keep else logit


def gradients(net: dict, x: np.ndarray, places: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted cross-entropy; ``x`` has that of the words' inputs."""
    logit, (states, u, alpha, pooled, memo) = forward(net, x, places, mask, keep=True)
    dl = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
    g = {"o": dl @ pooled, "o0": np.array([dl.sum()], np.float32)}
    dp = dl[:, None] * net["o"]
    da = (states @ dp[:, :, None])[:, :, 0]
    de = alpha * (da - (alpha * da).sum(axis=1, keepdims=True))
    ds = alpha[:, :, None] * dp[:, None, :]
    du = de[:, :, None] * net["v"] * (1 - u**2)
    g["v"] = np.einsum("nt,nta->a", de, u)
    g["a"] = np.einsum("nts,nta->sa", states, du)
    ds += du @ net["a"].T
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        g[f"{d}g"], g[f"{d}n"] = np.zeros_like(net[f"{d}g"]), np.zeros_like(net[f"{d}n"])
        dproj = np.zeros((len(x), 3 * HIDDEN), np.float32)
        dh = np.zeros((len(y), HIDDEN), np.float32)
        steps = places.shape[1]
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h, z, r, new = memo[d, t]
            dh = dh + ds[:, t, k * HIDDEN : (k + 1) * HIDDEN]
            on = mask[:, t, None]
            dnew = dh * (1 - z) * (1 - new**2) * on
            drh = dnew @ net[f"{d}n"].T
            dgates = np.hstack([dh * (h - new) * z * (1 - z), drh * h * r * (1 - r)]) * on
            g[f"{d}n"] += (r * h).T @ dnew
            g[f"{d}g"] += h.T @ dgates
            np.add.at(dproj, places[:, t], np.hstack([dgates, dnew]))
            dh = np.where(on, dh * z + drh * r + dgates @ net[f"{d}g"].T, dh)
        g[f"{d}x"], g[f"{d}0"] = x.T @ dproj, dproj.sum(axis=0)
        dx += dproj @ net[f"{d}x"].T
    return g | {"x": dx}


# ---------------------------------------------------------------- training


def _inputs_of(texts: list[bytes]):
    """Inputs of the distinct words of some windows, where each window's words begin and end, and the distinct word of each word."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    # words are numbered as they come, a portion of the windows at a time: the driver never holds the hashes of all of them
    known: dict[int, int] = {}
    spelt: list[bytes] = []
    codes, sizes = [], []
    for lo, hi in slices(offsets, 1 << 20):
        part = data[offsets[lo] : offsets[hi]]
        h, rows, starts, ends = spans(part, offsets[lo : hi + 1] - offsets[lo], NOT_ALNUM)
        code, distinct = pd.factorize(h)
        at = np.empty(len(distinct), np.int64)
        at[code[::-1]] = np.arange(len(h))[::-1]
        for v, i in zip(distinct.tolist(), at.tolist(), strict=True):
            if v not in known:
                known[v] = len(known)
                spelt.append(part[starts[i] : ends[i]].tobytes())
        numbers = np.fromiter(map(known.__getitem__, distinct.tolist()), np.int32, len(distinct))
        codes.append(numbers[code])
        sizes.append(np.bincount(rows, minlength=hi - lo))
    distinct = np.fromiter(known, np.uint64, len(known))
    ends = np.cumsum([len(w) for w in spelt]).astype(np.int64)
    starts = ends - np.array([len(w) for w in spelt], np.int64)
    inputs = word_inputs(np.frombuffer(b"".join(spelt), np.uint8), starts, ends, distinct.astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return inputs, first[:-1], first[1:], np.concatenate(codes)


def train(sample: list[tuple[list[bytes], int]], seed: int = 5) -> dict:
    """Network from (windows of a text, label) rows, a text's strongest window first; each window is at most WINDOW words.

    A label marks a document, not a window. The windows to learn as positive are the strongest ones, until the network takes another
    window of the text for toxic and not that one. Negatives are windows drawn from all of the clean texts, and the highest of some. ``calibrate`` turns logits into probabilities.
    """
    net = new_network(seed)
    y = np.array([label for _, label in sample], np.float32)
    rate = float(y.mean()) if len(y) else 0.0
    if not len(y) or rate in (0.0, 1.0):
        return {"net": net, "scale": 0.0, "rate": rate, "shift": float(np.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 0.5)))}
    rng = np.random.default_rng(seed)
    (word, tri, cut), start, end, codes = _inputs_of([w for ws, _ in sample for w in ws])
    n_docs = len(y)
    of = np.concatenate([[0], np.cumsum([len(ws) for ws, _ in sample])])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    clean_windows = np.flatnonzero(np.repeat(y == 0, np.diff(of)))
    best = of[:-1].copy()
    step = 0
    for epoch in range(EPOCHS):
        drawn = rng.choice(clean_windows, min(len(clean_windows), 3 * len(toxic)), replace=False)
        hard = best[rng.choice(clean, min(len(clean), len(toxic)), replace=False)]
        chosen = np.concatenate([best[toxic], drawn, hard])
        target = np.concatenate([np.ones(len(toxic)), np.zeros(len(drawn) + len(hard))]).astype(np.float32)
        order = rng.permutation(len(chosen))
        for s in range(0, len(order), BATCH):
            i = chosen[order[s : s + BATCH]]
            places, mask = unfold(codes, start[i], end[i])
            used, inverse = np.unique(places, return_inverse=True)
            lengths = np.diff(cut)[used]
            sub_cut = np.concatenate([[0], np.cumsum(lengths)])
            sub_tri = tri[np.repeat(cut[used] - sub_cut[:-1], lengths) + np.arange(sub_cut[-1])]
            x = embed(net, word[used], sub_tri, sub_cut)
            g = gradients(net, x, inverse.reshape(len(i), WINDOW), mask, target[order[s : s + BATCH]], np.ones(len(i), np.float32))
            dx = g.pop("x")
            g["words"] = np.zeros_like(net["words"])
            np.add.at(g["words"], word[used], dx[:, :WIDTH])
            g["chars"] = np.zeros_like(net["chars"])
            np.add.at(g["chars"], sub_tri, np.repeat(dx[:, WIDTH:] / lengths[:, None], lengths, axis=0))
            step += 1
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                net[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        if epoch in (3, 9, 15):
            logit = _all_logits(net, embed(net, word, tri, cut), codes, start, end)
            top = np.array([of[i] + logit[of[i] : of[i + 1]].argmax() for i in range(n_docs)])
            # a positive leaves its window only for one that the network takes for toxic, and only if it doesn't take its own for that
            best = np.where((y == 0) | ((logit[best] < 0) & (logit[top] > 0)), top, best)
    return {"net": net, "scale": 1.0, "shift": 0.0, "rate": rate}


def calibrate(top: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(scale, shift) of the logits of documents with labels y. share: of toxic rows among all, since a sample may hold more of one class."""
    rate = y.mean()
    each = np.where(y == 1, share / rate, (1 - share) / (1 - rate))
    scale, shift = 1.0, 0.0
    for _ in range(200):  # logistic regression of the labels on the documents' highest logits, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(scale * top + shift, -30, 30)))
        w = each * p * (1 - p) + 1e-6
        grad = np.array([(each * (p - y) * top).sum(), (each * (p - y)).sum()])
        hess = np.array([[(w * top**2).sum() + 1e-3, (w * top).sum()], [(w * top).sum(), w.sum() + 1e-3]])
        scale, shift = np.array([scale, shift]) - 0.5 * np.linalg.solve(hess, grad)
    return float(scale), float(shift)


def _all_logits(net: dict, x: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.concatenate([forward(net, x, *unfold(codes, start[s : s + 1024], end[s : s + 1024])) for s in range(0, len(start), 1024)])


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_ROWS, clean: int = CLEAN_ROWS) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of at most so many toxic and clean labelled texts by a hash of their id, stored; the share of toxic ones among all labelled texts.

    Labels other than 0 and 1, null ids and texts are left out. An id with unlike labels is toxic; of unlike texts of an id the
    one of the smallest SHA-256 counts.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where("text is not null").select("doc_id", "text")
    present = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    share = present.agg(F.avg("toxic")).first()[0]
    first = lambda value, n: present.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = store(first(1, toxic).unionByName(first(0, clean)), "picked")
    joined = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"), F.max("toxic").cast("int").alias("toxic"))
    out = store(joined, "labelled")
    drop(picked)
    return out, share or 0.0


def _words_of(text: bytes):
    data = LOWER[np.frombuffer(text, np.uint8)]
    return data, spans(data, np.array([0, len(data)]), NOT_ALNUM)


def _doc_words(batches):
    """Arrow function: the distinct words of each text, with its label."""
    for batch in batches:
        texts, labels = batch.column("text"), batch.column("toxic").to_pylist()
        for i, label in enumerate(labels):
            h = np.unique(_words_of(texts[i].as_py().encode())[1][0])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), label, np.int32))], names=["h", "toxic"])


def _chosen(words: np.ndarray, odds: np.ndarray):
    """Arrow function: the windows of each text to learn from, given the log-odds of sorted words."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            out = []
            for i in range(batch.num_rows):
                text = texts[i].as_py().encode()
                data, (h, rows, starts, ends) = _words_of(text)
                start, end, _ = windows(bounds(rows, 1))
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                strength = np.where(words[at] == h, odds[at], np.float32(-9)) if len(words) else np.zeros(len(h), np.float32)
                places, mask = unfold(strength, start, end)
                order = np.argsort(-np.where(mask, places, -9).max(axis=1), kind="stable")
                rest = order[STRONG:]
                drawn = np.random.default_rng(len(text)).choice(rest, min(DRAWN, len(rest)), replace=False)
                some = np.concatenate([order[:STRONG], drawn]).astype(np.int64)
                out.append([data[starts[start[w]] : ends[min(start[w] + WINDOW, end[w]) - 1]].tobytes() if len(h) else b"" for w in some])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "toxic", "windows"])

    return run


def fit(sample: DataFrame, share: float | None = None) -> dict:
    """Model from sample(doc_id, text, toxic), of a bounded number of rows. The driver trains for a time that the sample's size sets, whatever the input's. share: of toxic rows among all; by default that of the sample."""
    spark, kind = sample.sparkSession, sample.schema["doc_id"].dataType.simpleString()
    n, positive = sample.agg(F.count("*"), F.sum("toxic")).first()
    rate = (positive or 0) / max(1, n)
    counts = sample.mapInArrow(_doc_words, "h long, toxic int").groupBy("h").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    odds = counts.select("h", F.log((F.col("t") + rate) / (F.col("n") - F.col("t") + (1 - rate))).cast("float").alias("odds")) if 0 < rate < 1 else spark.createDataFrame([], "h long, odds float")
    top = odds.orderBy(F.desc("odds"), "h").limit(ODDS_WORDS).toArrow()
    words = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(words)
    chosen = sample.mapInArrow(_chosen(words[order], top.column("odds").to_numpy()[order]), f"doc_id {kind}, toxic int, windows array<binary>")
    model = train([([bytes(w) for w in r.windows], r.toxic) for r in chosen.orderBy("doc_id").toLocalIterator()])
    if model["scale"]:
        logits = score(sample, model).select("logit", "row.toxic").toArrow()
        y = logits.column("toxic").to_numpy().astype(np.float64)
        model["scale"], model["shift"] = calibrate(logits.column("logit").to_numpy(), y, float(y.mean()) if share is None else share)
        model["rate"] = float(y.mean()) if share is None else share
    give_back()
    return model


# ---------------------------------------------------------------- scoring


def _score(shared):
    def run(batches):
        model = shared.value
        net = model["net"]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, 1 << 20):
                part = LOWER[data[offsets[lo] : offsets[hi]]]
                h, rows, starts, ends = spans(part, offsets[lo : hi + 1] - offsets[lo], NOT_ALNUM)
                codes, distinct = pd.factorize(h)
                first_at = np.empty(len(distinct), np.int64)
                first_at[codes[::-1]] = np.arange(len(h))[::-1]
                x = embed(net, *word_inputs(part, starts[first_at], ends[first_at], h[first_at]))
                start, end, of = windows(bounds(rows, hi - lo))
                top = np.maximum.reduceat(_all_logits(net, x, codes, start, end), of[:-1]).astype(np.float64)
                p = 1 / (1 + np.exp(-np.clip(model["scale"] * top + model["shift"], -30, 30)))
                if model["scale"]:
                    p[np.bincount(rows, minlength=hi - lo) == 0] = model["rate"]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(p), pa.array(np.diff(of)), pa.array(top)], names=["row", "score", "n_windows", "logit"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """row (a struct of the columns of docs but text), score (0 to 1), n_windows and logit (before calibration) of each whole text.

    A null or empty text, or one without words, has one window without words, of which nothing is known: its score is the rate of toxic labels. Repeated rows each get a row.
    Without labelled rows of both classes every text gets the labels' smoothed rate. The broadcast model has a fixed size.
    """
    rest = [c for c in docs.columns if c != "text"]
    source = docs.select("text", F.struct(*rest).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return source.mapInArrow(giving_back(_score(shared)), f"row {source.schema['row'].dataType.simpleString()}, score double, n_windows long, logit double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents; learned from the labelled rows whose crc32 remainder by 4 isn't 2. Columns as the contract names them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    model = fit(*labelled_sample(docs.where("not held_out"), labels))
    return score(docs, model).select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
