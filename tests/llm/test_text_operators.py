"""Brute force, held-out accuracy and edge cases of the operators over texts."""

import glob
import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import decontamination, language_id, license_scan, lm_scoring, mixing, near_dedup, sharding, token_counts, toxicity
from driftspark.llm.common import shared_dir
from tests.llm.conftest import rows, sentence


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---------------------------------------------------------------- language-model scoring


def brute_ctw(train, text):
    """Natural log-probability of a text by the textbook recursion over a dictionary of nodes."""
    depth = lm_scoring.DEPTH
    counts = {}

    def grams(t):
        s = b"\xff" * depth + lower(t).encode() + b"\xff"
        for i in range(depth, len(s)):
            yield s[i - depth : i][::-1], s[i]

    for t in train:
        for context, byte in grams(t):
            for j in range(8):
                for d in range(depth + 1):
                    c = counts.setdefault((context[:d], (1 << j) | (byte >> (8 - j))), [0, 0])
                    c[byte >> (7 - j) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    weighted, below = {}, Counter()
    for d in range(depth, -1, -1):
        for (context, node), (a, b) in [x for x in counts.items() if len(x[0][0]) == d]:
            w = kt(a, b) if d == depth else np.logaddexp(kt(a, b), below[context, node]) - math.log(2)
            weighted[context, node] = w
            if d:
                below[context[:-1], node] += w

    def bit(context, node, value, d=0):
        a, b = counts.get((context[:d], node), (0, 0))
        if a + b == 0:
            return None if d else 0.5
        own = ((b if value else a) + 0.5) / (a + b + 1)
        deeper = bit(context, node, value, d + 1) if d < depth else None
        if deeper is None:
            return own
        share = math.exp(min(0.0, kt(a, b) - math.log(2) - weighted[context[:d], node]))
        return share * own + (1 - share) * deeper

    return sum(math.log(bit(context, (1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1)) for context, byte in grams(text) for j in range(8))


def test_lm_scoring_against_brute_force(spark, monkeypatch):
    texts = [(i, sentence(i, 12)) for i in range(8)] + [(8, None), (9, "ÉTÉ été"), (9, "ÉTÉ été"), (None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = lm_scoring.score(docs, F.col("doc_id") % 3 != 0).collect()
    train = [t for i, t in texts if i is not None and i % 3 != 0]
    counts = Counter(w for t in train for w in [*lower(t).split(), None])
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for r in got:
        text = next(t for i, t in texts if i == r.row.doc_id)
        tokens = [*lower(text).split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens))
        assert r.score == pytest.approx(brute_ctw(train, text) / math.log(10), rel=1e-6)


def test_lm_scoring_edges(docs, none):
    assert lm_scoring.score(none, F.lit(True)).count() == 0
    got = lm_scoring.score(docs, F.lit(False)).collect()
    assert len(got) == len(rows())
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.bits_per_byte == pytest.approx(8) for r in got)


# ---------------------------------------------------------------- toxicity, language


def test_toxicity_learns_and_scores_whole_texts(spark):
    plain = lambda seed, n: re.sub("[0-9]", "", sentence(seed, n))
    sample = [(i, plain(i, 60), 0) for i in range(120)]
    for i in range(40):  # half of them hold their word far behind 6000 bytes
        words = plain(1000 + i, 60 if i % 2 else 2500).split()
        words[i + 5 if i % 2 else 2300 + i] = "nasty"
        sample.append((1000 + i, " ".join(words), 1))
    model = toxicity.fit(spark.createDataFrame(sample, "doc_id long, text string, toxic int"))
    late = plain(5, 3000) + " nasty " + plain(6, 50)
    docs = spark.createDataFrame([(1, late), (2, plain(5, 3000)), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    got = [(r.row.doc_id, r.score, r.n_windows) for r in toxicity.score(docs, model).collect()]
    score = {i: s for i, s, _ in got}
    assert len(got) == 5 and score[1] > 0.5 > score[2] and score[3] == score[4] == 0.25  # the labels' rate
    assert {i: n for i, _, n in got}[2] == math.ceil((3000 - 32) / 16) + 1


def test_labelled_sample_is_defined_for_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c"), (3, "c"), (None, "d"), (4, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (9, 1), (None, 1), (4, None), (4, 7)], "doc_id long, toxic int")
    sample, share = toxicity.labelled_sample(docs, labels)
    least = min(("a", "b"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert sorted(map(tuple, sample.collect())) == [(1, least, 1), (3, "c", 0)] and share == 0.5  # of labels with a text
    sample, _ = toxicity.labelled_sample(docs, labels, toxic=0, clean=1)
    assert [r.doc_id for r in sample.collect()] == [3]


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(float) for k, v in toxicity.new_network(1).items()}
    x, places = rng.normal(size=(9, 2 * toxicity.WIDTH)), rng.integers(0, 9, (3, toxicity.WINDOW))
    mask, y = np.ones((3, toxicity.WINDOW), bool), np.array([1.0, 0, 1])
    mask[1, 5:] = False
    loss = lambda: np.mean(np.log1p(np.exp(z := toxicity.forward(net, x, places, mask))) - y * z)
    g = toxicity.gradients(net, x, places, mask, y, np.ones(3))
    for name in ("fx", "bg", "fn", "a", "v", "o"):
        at = tuple(rng.integers(0, s) for s in net[name].shape)
        kept = net[name][at]
        net[name][at] = kept + 1e-3
        up = loss()
        net[name][at] = kept - 1e-3
        down = loss()
        net[name][at] = kept
        assert (up - down) / 2e-3 == pytest.approx(g[name][at], rel=2e-2, abs=2e-5)


def test_toxicity_without_both_classes(spark, docs, none):
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert toxicity.score(none, model).count() == 0
    assert {round(r.score, 6) for r in toxicity.score(docs, model).collect()} == {0.5}


def test_language_id_held_out(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet")
    model = language_id.fit(language_id.sample_rows(docs.where("doc_id % 4 <> 1")))
    found = language_id.identify(docs.where("doc_id % 4 = 1"), model).select("lang_pred", "score", "row.lang").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.93 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_learns_from_whole_texts(spark):
    """The only sign of a language lies behind 6000 bytes of text that both languages share."""
    shared = " ".join(sentence(5, 3000).split())
    rows = [(f"{shared} {i} " + "qwx " * 900, "xx") for i in range(12)] + [(f"{shared} {i} " + "jyk " * 900, "yy") for i in range(12)]
    sample = language_id.sample_rows(spark.createDataFrame([*rows, *rows, (None, "xx"), ("", "yy"), ("z", None)], "text string, lang string"))
    assert len(shared) > 6000 and Counter(lang for _, lang in sample) == {"xx": 12, "yy": 12}
    model = language_id.fit(sample)
    late = spark.createDataFrame([(1, shared + " qwx" * 900), (2, shared + " jyk" * 900)], "doc_id long, text string")
    assert {r.row.doc_id: r.lang_pred for r in language_id.identify(late, model).collect()} == {1: "xx", 2: "yy"}


def test_language_id_edges(docs, none, monkeypatch):
    model = language_id.fit([(language_id._features(t), lang) for t, lang in ((b"the cat is on the mat", "en"), (b"der hund ist in dem haus", "de"))])
    assert language_id.identify(none, model).count() == 0
    got = {(r.row.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()}
    assert {(40, "und"), (41, "und"), (42, "und")} <= got and (43, "en") in got
    whole = np.frombuffer(b" a text longer than a piece ", np.uint8)
    grams = Counter(int(g) for n, ids in enumerate(language_id.gram_ids(whole)) for g in ids[n:])
    for piece in (1 << 20, 7, 2):
        monkeypatch.setattr(language_id, "PIECE", piece)
        x = language_id._features(b"a text longer than a piece")
        assert {i: round(v * len(whole)) for i, v in enumerate(x) if v} == grams
    empty = language_id.fit([])
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark, docs, none):
    passage = sentence(7, 80).split()
    items = [(1, " ".join(passage[3:40])), (2, "One"), (3, None), (4, ""), (5, " ".join(passage[60:67])), (10, "a text without an id"), (6, sentence(12345, 25)), (1, " ".join(passage[50:70])), (7, "école 日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.contamination(docs, bench).collect())
    want = Counter()
    for r in rows():
        n, hit, found = brute_hits(r[1], items)
        want[r[0], n, hit, tuple(found)] += 1
    assert got == want
    assert decontamination.contamination(none, bench).count() == 0
    assert {r.n_hit for r in decontamination.contamination(docs, bench.limit(0)).collect()} == {0}


def test_winnowing_keeps_a_gram_of_every_long_span():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    kept = decontamination.winnow(h, np.zeros(400, np.int64), 1)
    for i in range(400 - decontamination.SPAN + 1):
        assert ((kept >= i) & (kept <= i + decontamination.SPAN - decontamination.K)).any()


# ---------------------------------------------------------------- tokens


def test_token_counts_through_the_cache(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    definition = open(path, encoding="utf-8").read()
    tokenizer = Tokenizer.from_file(path)
    odd = [(60, "a<|endoftext|>b <|ENDOFTEXT|> it's 12 é  x"), (61, "x y\x1cz")]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    cache = f"{tmp_path}/cache"
    every = docs.select("doc_id", "text").unionByName(extra)
    for run in range(2):
        got = Counter((r.row.doc_id, r.n_tokens) for r in token_counts.count_tokens(every, definition, cache).collect())
        want = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in [(r[0], r[1]) for r in rows()] + odd)
        assert got == want
        stored = token_counts.read_cache(spark, cache).count()
        assert stored == token_counts.read_cache(spark, cache).select("digest").distinct().count()
    assert token_counts.count_tokens(none, definition, cache).count() == 0


def test_word_tokenizer_is_counted_by_words_and_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    definition = open(path, encoding="utf-8").read()
    assert token_counts.drops_white_space(definition)
    count, tokenizer = token_counts.counter(definition), Tokenizer.from_file(path)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert count([t.encode() for t in texts]) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_white_space_counts_where_the_tokenizer_keeps_it(spark, docs, name, tmp_path):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        definition, tokenizer = open(path, encoding="utf-8").read(), Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    else:
        definition, pieces = open(path, "rb").read(), sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(pieces.encode(t))
    assert not token_counts.drops_white_space(definition)
    odd = spark.createDataFrame([(70, "a b"), (71, "a \n\n  b"), (72, " a b "), (73, "<|endoftext|> <s>")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    got = Counter((r.row.doc_id, r.n_tokens) for r in token_counts.count_tokens(every, definition, f"{tmp_path}/cache").collect())
    assert got == Counter((r.doc_id, count(r.text or "")) for r in every.collect())


def test_token_count_query_keeps_its_cache(spark, sf):
    cache = lambda: sum(1 for _ in glob.glob(f"{shared_dir(spark)}/token-cache/*/*/part-*.parquet"))
    first = sorted(token_counts.op6_token_counts(spark, sf).collect())
    stored = [token_counts.read_cache(spark, p).count() for p in glob.glob(f"{shared_dir(spark)}/token-cache/*")]
    assert cache() and sorted(token_counts.op6_token_counts(spark, sf).collect()) == first
    assert [token_counts.read_cache(spark, p).count() for p in glob.glob(f"{shared_dir(spark)}/token-cache/*")] == stored


# ---------------------------------------------------------------- near duplicates


def brute_components(texts, k, percent):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    return [len(s) for s in sets], [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80), (2, 60)])
def test_near_dedup_against_brute_force(spark, docs, k, percent):
    family = sentence(77, 120).split()
    more = []
    for i in range(40):  # near copies of one text, some chained, most not linked to each other
        w = list(family)
        for p in range(i % 7):
            w[(i * 11 + p * 17) % 120] = f"x{i}"
        more.append((100 + i, " ".join(w)))
    texts = [(r[0], r[1]) for r in rows()] + more
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    sizes, root = brute_components(texts, k, percent)
    least = {}
    for (i, _), t in zip(texts, root, strict=True):
        least[t] = min([x for x in (least.get(t), i) if x is not None], default=None)
    want = Counter((i, n, least[t], i == least[t]) for (i, _), n, t in zip(texts, sizes, root, strict=True))
    got = near_dedup.near_duplicates(every, k=k, percent=percent).collect()
    assert Counter((r.row.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert sum(r.first for r in got) == len(set(root))


def test_near_dedup_empty(none):
    assert near_dedup.near_duplicates(none).count() == 0


def test_bands_find_what_they_should():
    assert (near_dedup.band_rows(85), near_dedup.band_rows(80)) == (5, 4)
    for percent in (40, 50, 60, 70, 75, 90, 95, 100):
        r = near_dedup.band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (near_dedup.REGISTERS // r) <= near_dedup.MISS
    with pytest.raises(ValueError):
        near_dedup.band_rows(5)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 63, 4000).astype(np.uint64) for _ in range(2))
    x, y = np.concatenate([a[:3000], b[:500]]), np.concatenate([a[:3000], b[500:1000]])
    sketch = lambda s: near_dedup.registers(s, np.array([0]))
    assert (np.maximum(sketch(x), sketch(y)) == sketch(np.concatenate([x, y]))).all()
    sx, sy = sketch(x), sketch(y)
    j = near_dedup.likelihood_jaccard((sx > sy).sum(axis=1), (sx < sy).sum(axis=1), np.array([3500.0]), np.array([3500.0]))
    assert abs(j[0] - 0.75) < 0.15


# ---------------------------------------------------------------- mixing, licenses, sharding


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([("a", "en", "p", 100), ("a", "de", "p", 50), ("b", "en", "q", 10), ("b", "de", "p", 30), ("b", "de", "q", 5)], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.4, "b": 0.6}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"p": 0.8, "q": 0.2}}
    targets = {by: mixing.completed(cells, by, t) for by, t in goal.items()}
    got, off = mixing.rake(cells, targets, tolerance=1e-7)
    got = got.collect()
    for by, t in goal.items():
        assert off[by] <= 1e-7
        for value, share in t.items():
            assert sum(r.factor * r.tokens for r in got if r[by] == value) / 195 == pytest.approx(share, abs=1e-4)


def test_raking_states_what_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "en", "p", 100), ("b", "de", "p", 100)], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.5, "de": 0.5}}
    _, off = mixing.rake(cells, {by: mixing.completed(cells, by, t) for by, t in goal.items()})
    assert off["source"] == pytest.approx(0.4) and off["lang"] == pytest.approx(0)


def test_given_targets_with_a_rest(spark):
    cells = spark.createDataFrame([("a", 10), ("b", 30), ("c", 60), ("d", 0)], "lang string, tokens long")
    got = dict(map(tuple, mixing.completed(cells, "lang", {"a": 0.5, "x": 0.1, "*": 0.3}).collect()))
    assert got == {k: pytest.approx(v) for k, v in {"a": 0.5 / 0.8, "b": 0.1 / 0.8, "c": 0.2 / 0.8}.items()}


def brute_mix(texts, goal, power, topics):
    """Topic, tokens and factor of each row by plain loops."""
    out = []
    for _, text, lang, source in texts:
        w = [x for x in re.split("[\t\n\x0b\f\r ]+", lower(text)) if x]
        held = sorted((-w.count(t), t) for t in topics if t in w)
        out.append([held[0][1] if held else "other", len(w), lang or "∅", source or "∅"])
    sums = Counter()
    for topic, n, lang, source in out:
        sums[source, lang, topic] += n
    total = sum(sums.values())
    shares = [Counter(), Counter(), Counter()]
    for cell, n in sums.items():
        for i in range(3):
            shares[i][cell[i]] += n / total
    want = [{k: v**power for k, v in shares[0].items() if v}, goal, dict(shares[2])]
    want = [{k: v / sum(t.values()) for k, v in t.items()} for t in want]
    factor = dict.fromkeys(sums, 1.0)
    for _ in range(500):
        for i in range(3):
            mass = Counter()
            for cell, n in sums.items():
                mass[cell[i]] += factor[cell] * n
            for cell in sums:
                factor[cell] *= want[i].get(cell[i], 0) * total / mass[cell[i]] if mass[cell[i]] else 0
    return [(t, n, factor[s, la, t]) for t, n, la, s in out]


def test_mix_against_brute_force(spark, docs, none, monkeypatch):
    monkeypatch.setattr(mixing.rake, "__defaults__", (1e-6,))
    more = [(200 + i, "the of " * 4 + ("harbour " * 6 if i % 4 == 0 else "") + sentence(i, 30), "en de".split()[i % 2], f"s{i % 3}") for i in range(40)]
    texts = [r[:4] for r in rows()] + more
    every = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    topics = mixing.learn_topics(every.select(F.coalesce("lang", F.lit("∅")).alias("lang"), "text"), n=1, least=0.1, most=0.4)
    assert topics == ["harbour"]
    monkeypatch.setattr(mixing, "learn_topics", lambda d: topics)
    goal = {"en": 0.6, "de": 0.3, "fr": 0.1}
    got = mixing.mix(every, temper={"source": 0.5, "topic": 1.0}, targets={"lang": goal}).collect()
    want = Counter((i, t, n, round(f, 3)) for (i, *_), (t, n, f) in zip(texts, brute_mix(texts, goal, 0.5, topics), strict=True))
    assert Counter((r.row.doc_id, r.topic, r.tokens, round(r.factor, 3)) for r in got) == want
    most = max(r.factor for r in got)
    assert all(r.probability == pytest.approx(r.factor / most) for r in got) and all(r.sampled for r in got if r.probability == 1)
    assert len({(r.row.doc_id, r.row.text, r.sampled) for r in got}) == len({(r[0], r[1]) for r in texts})
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a")], "doc_id long, text string, lang string, source string")
    assert [r.sampled for r in mixing.mix(blank).collect()] == [True, True]


def test_sampling_follows_the_probabilities(spark):
    rows = [(i, "a b c", "en" if i % 2 else "de", "s") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), targets={"lang": {"en": 0.75, "de": 0.25}}, topic=F.col("source")).collect()
    kept = Counter(r.row.lang for r in got if r.sampled)
    assert kept["en"] == 2000 and abs(kept["de"] - 2000 / 3) < 80 and {r.topic for r in got} == {"s"}


def test_license_scan(spark, docs, none):
    notes = license_scan.TEMPLATES
    mit = notes["mit"].split()
    texts = [(1, sentence(1, 300) + "\n" + notes["mit"] + "\n" + sentence(2, 90)), (2, " ".join(mit[: len(mit) // 2])), (3, "x " + notes["mit-notice"].upper()), (4, " ".join(w if i != 40 else "changed" for i, w in enumerate(mit))), (5, None), (6, ""), (6, "")]
    got = [(r.row.doc_id, [m.template for m in r.matches]) for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, ["mit"]), (2, []), (3, ["mit-notice"]), (4, ["mit"]), (5, []), (6, []), (6, [])]
    assert license_scan.scan(none).count() == 0
    assert license_scan.scan(docs).count() == len(rows())


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=4, keep=("text",)).collect()
    assert len(got) == len(rows())
    by_text = {}
    for r in got:
        blob = (r.text or "").encode()
        assert r["size"] == len(blob) + 1 and r.text_crc32 == zlib.crc32(blob) and r.law == "bytes" and r.grown_shard is None
        assert by_text.setdefault(r.text, r.shard) == r.shard
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).count() == 0


def brute_licenses(text, templates, containment=0.8):
    """Templates of which some run of as many shingles as their scale holds enough: every run, not every window."""
    words = lambda t: [w for w in re.split("[^0-9a-z\x80-\U0010FFFF]+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    g, out = grams(words(text)), set()
    for name, t in templates.items():
        own = set(grams(words(t)))
        c = 1 << max(0, math.ceil(math.log2(len(own)))) if own else 0
        if own and any(len(own & set(g[i : i + c])) >= containment * len(own) - 1e-9 for i in range(max(1, len(g) - c + 1))):
            out.add(name)
    return out


@pytest.mark.parametrize("piece", [1 << 12, 64])
def test_license_scan_finds_every_run_of_brute_force(spark, monkeypatch, piece):
    """Notices with changed, lost and doubled words, anywhere in texts, over the borders of pieces too."""
    import random

    monkeypatch.setattr(license_scan, "PIECE", piece)
    texts = []
    for i in range(90):
        r = random.Random(i)
        parts = [sentence(i, r.randint(0, 260))]
        for name in r.sample(sorted(license_scan.TEMPLATES), r.randint(1, 3)):
            w = license_scan.TEMPLATES[name].split()
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [w[at]] * 2, ["changed"], [w[at]]])
            parts += [" ".join(w), sentence(1000 + i, r.randint(0, 30))]
        texts.append((i, r.choice([" ", "\n\n"]).join(parts)))
    texts += [(100, sentence(100, 9000) + " " + license_scan.TEMPLATES["mit"] + " " + sentence(101, 9000))]
    got = {r.row.doc_id: {m.template for m in r.matches} for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        assert brute_licenses(t, license_scan.TEMPLATES) <= got[i]
        w = {x for m in got[i] for x in [m]}
        assert w <= set(license_scan.TEMPLATES)


def test_license_bands_keep_the_guarantee():
    for c, sizes in {1: [1], 4: [3, 4], 8: [8], 16: [9], 32: [30], 64: [36], 128: [76, 82, 83]}.items():
        n = license_scan.bands_of(c, sizes, 0.8)
        for m in sizes:
            need = license_scan.need_of(m, 0.8)
            j = need / (c + license_scan.step_of(c) - 1 + m - need)
            assert j >= 1 or (1 - j) ** n <= license_scan.MISS


def plain_lpt(sizes, shards):
    """Loads of longest-first through a heap, group by group."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def test_lpt_matches_the_plain_heap():
    import random

    for seed in range(60):
        r = random.Random(seed)
        shards = r.randint(1, 9)
        top = r.choice([5, 900, 50_000_000])
        classes = {r.randint(1, top): r.randint(1, 60) for _ in range(r.randint(0, 80))}
        loads = [0] * shards
        for size, upto in sharding.lpt_counts(sorted(classes.items(), reverse=True), shards):
            assert upto[-1] == classes[size]
            for s, given in enumerate(np.diff([0, *upto])):
                loads[s] += size * int(given)
        assert sorted(loads) == plain_lpt([s for s, n in classes.items() for _ in range(n)], shards)


def test_shards_are_those_of_the_plain_heap(spark, monkeypatch):
    """Copies add up to groups of over 1 MB; sizes are as near equal as longest-first makes them."""
    monkeypatch.setattr(sharding, "PORTION", 7)
    texts = [(i, "x" * (1 + 37 * (i % 61))) for i in range(400)] + [(1000 + i, "y" * 9000) for i in range(150)] + [(2000 + i, "z" * 700_001) for i in range(3)] + [(3000, "w" * 1_500_000), (3001, None), (3001, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sharding.shard(docs, shards=8).collect()
    groups = Counter()
    for _, t in texts:
        groups[t] += len((t or "").encode()) + 1
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert sorted(loads.values()) == plain_lpt(groups.values(), 8)
