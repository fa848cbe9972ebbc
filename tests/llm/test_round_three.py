"""Quality rules, token alignment and hard negatives against brute force, with odd rows."""

import bisect
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import hard_negatives, quality_rules, token_alignment

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, len(again))


def test_text_counts_match_brute_force(spark, docs, none):
    extra = spark.createDataFrame([(60, "a a a a\na a a a\n\n  \n# x | y\n# x | y\r\n", "en", "s0", 1, "u", "n", "r"), (61, "é è 日本 #1 x", "fr", None, 1, "u", "n", "r")], docs.schema)
    every = docs.unionByName(extra)
    rows = quality_rules.count_texts(every.withColumn("key", F.concat_ws("/", "doc_id", "lang", "source")).select("key", "text")).collect()
    want = Counter(("/".join(str(x) for x in (r.doc_id, r.lang, r.source) if x is not None), *counts_of(r.text)) for r in every.collect())
    assert Counter((r.row.key, *r[1:]) for r in rows) == want
    assert quality_rules.quality(none).collect() == []


def test_sketches_merge_and_bounds_follow_the_group(spark):
    rng = np.random.default_rng(5)
    rows = [("en", "big", int(v), 100, 0, 10, 0, 0) for v in rng.integers(400, 600, 300)] + [("en", "small", 500, 100, 0, 10, 0, 0)] * 3 + [("xx", "one", 900, 100, 0, 10, 0, 0)] * 2
    t = spark.createDataFrame(rows, "lang string, source string, word_chars long, n_words long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    fine = quality_rules.sketch(t, ["lang", "source"])
    assert {tuple(r) for r in quality_rules.merge(fine, ["lang"]).collect()} == {tuple(r) for r in quality_rules.sketch(t, ["lang"]).collect()}
    down = lambda v: v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0)
    values = sorted(down(1000 * r[2] // 100) for r in rows if r[1] == "big")
    q25, q75 = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
    got = {(r.lang, r.source): r for r in quality_rules.bounds(fine, ["lang", "source"]).collect()}
    assert got["en", "big"].least == {"word_length": q25 - 3 * max(q75 - q25, 200)} and got["en", "big"].most["word_length"] == q75 + 3 * max(q75 - q25, 200)
    wide = quality_rules.quantiles(quality_rules.sketch(t, ["lang"]), ["lang"]).where("lang = 'en' and rule = 'word_length'").first()
    assert got["en", "small"].most["word_length"] == wide.q75 + 3 * max(wide.q75 - wide.q25, 200)
    assert got["xx", "one"].most["word_length"] == got["en", "small"].most["word_length"] or got["xx", "one"].most["word_length"] > 0
    assert got["en", "big"].most["symbols"] == 300


def test_quality_rejects_what_its_group_makes_odd(spark):
    clean = " ".join(f"word{i} other{i} thing{i}" for i in range(30))
    noisy = " ".join(f"a{i}b|c{i}d | e{i}f" for i in range(40))
    rows = [(i, f"{clean} {i}", "en", "a") for i in range(120)] + [(200, noisy, "en", "a"), (201, None, "en", "a"), (202, "", None, None), (203, clean * 3000, "en", "a"), (204, "few words", "en", "a"), (204, "few words", "en", "a")]
    rows += [(300 + i, f"{noisy} {i}", "en", "tables") for i in range(120)]
    out = quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("row.doc_id", "base_failed", "failed", "kept").collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert all(by[i].kept for i in range(120)) and all(by[300 + i].kept for i in range(120))  # tables are usual in their source
    assert by[200].failed and not by[200].kept and not by[200].base_failed
    assert [by[i].base_failed for i in (201, 202, 203, 204)] == [True] * 4


# ---------------------------------------------------------------- alignment


def definitions():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return a, f.read()


def tokens(a, b):
    """text -> ids and token bytes of either side, by the libraries on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_str(a)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=b)
    table = token_alignment._byte_characters()
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], [], [], []
        ia, ib = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        ba, bb = [bytes(table[c] for c in first.id_to_token(i)) for i in ia], [piece(i) for i in ib]
        whole = (" " + text).encode()
        return (ia, ib, ba, bb) if b"".join(ba) == whole == b"".join(bb) else ([], [], [], [])

    return run


def brute(run, text):
    """(a, b, groups, links) by the set of common ends."""
    ia, ib, ba, bb = run(text)
    ea, eb = list(accumulate(map(len, ba))), list(accumulate(map(len, bb)))
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        x, y = bisect.bisect_left(ea, cut) + 1, bisect.bisect_left(eb, cut) + 1
        groups.append(",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])))
        links.append((ia[x - 1], ib[y - 1]))
        i, j = x, y
    return len(ia), len(ib), ";".join(groups), links


ODD = ["<|endoftext|> and </s> <0x41> stay text", "two  blanks\tand\nlines ½ ﬁ", "▁ a▁b c▁", "plain x▁y words after it", "日本語のテキスト、混ぜた text です", "👩‍👩‍👧 é", "x" * 700, " lead and trail  ", "a\x00b", "no_blank_here"]


def test_alignment_matches_common_ends(spark, docs, none):
    a, b = definitions()
    extra = spark.createDataFrame([(70 + i, t, "en", "s", 1, "u", "n", "r") for i, t in enumerate(ODD)], docs.schema)
    every = docs.unionByName(extra).repartition(3)
    run = tokens(a, b)
    texts, pairs = token_alignment.align(every.select("text", "doc_id", "uid", "n", "row"), a, b)
    want = [(r.doc_id, *brute(run, r.text)) for r in every.collect()]
    count = Counter(p for *_, links in want for p in links)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    expected = Counter((i, na, nb, g, len(g.split(";")) if g else 0, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)) for i, na, nb, g, links in want)
    assert Counter((r.row.doc_id, r.n_a, r.n_b, r.groups, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in texts.collect()) == expected
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == most[p[1]]) for p, n in count.items()}
    empty, no_pairs = token_alignment.align(none.select("text", "doc_id"), a, b)
    assert empty.collect() == [] and no_pairs.collect() == []


def test_cuts_are_found_wherever_they_are():
    rng = np.random.default_rng(3)
    for _ in range(200):
        end = int(rng.integers(1, 60))
        ea, eb = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(0, 40)), end)) for _ in range(2))
        common = np.intersect1d(ea, eb)
        want = np.append(0, np.searchsorted(ea, common[:-1]) + 1)
        assert token_alignment.divide(ea, eb, np.array([0]), np.array([len(ea)])).tolist() == want.tolist()


def test_segments_change_no_token():
    a, b = definitions()
    run = tokens(a, b)
    encoder = token_alignment.Encoder(a, b)
    for text in [*ODD, *ODD]:
        (ia, _), (ib, _) = encoder.encode([text])
        assert (ia.tolist(), ib.tolist()) == tuple(run(text)[:2])


# ---------------------------------------------------------------- hard negatives


def mined(rows, positives=5, negatives=10):
    once = {}
    for i, label, vec in rows:
        if i is not None and label is not None and vec is not None and all(x is not None and abs(x) < 1 << 24 for x in vec):
            once[i] = min(once.get(i, (label, vec)), (label, vec))
    out = []
    for a, (label, vec) in once.items():
        if a % 10:
            continue
        score = {i: sum(x * y for x, y in zip(v, vec, strict=True)) for i, (_, v) in once.items() if i != a and len(v) == len(vec)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if once[i][0] == label][:positives]:
            fits = [i for i in order if once[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("part", [64, 1 << 18])
def test_hard_negatives_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(hard_negatives, "PART", part)
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 40, (4, 12))
    rows = [(i, str(i % 3), np.rint(centres[i % 4] + rng.normal(0, 25, 12)).astype(int).tolist()) for i in range(230)]
    rows += [(300 + i, "0", rows[10][2]) for i in range(7)] + [(310 + i, "1", rows[20][2]) for i in range(15)]  # ties
    rows += [(400, "0", [0] * 12), (401, None, [1] * 12), (402, "1", None), (403, "1", [None] * 12), (404, "2", [1 << 24] * 12), (410, "7", [5] * 12), (420, "1", [3, 4]), (421, "1", [1, 1]), (422, "2", [1, 0]), (430, "1", []), (431, "1", []), (432, "2", [])]
    rows += [rows[0], (10, "0", [9] * 12), (None, "1", [1] * 12), (500, "0", [-x for x in rows[1][2]]), (510, "1", [(1 << 24) - 1] * 12), (511, "1", [(1 << 24) - 1] * 12), (512, "0", [(1 << 23)] * 12)]
    table = spark.createDataFrame([(*r, "n", 1) for r in rows], "vec_id long, label string, vec array<long>, negative_id string, rank int").repartition(4)
    assert sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 10 == 0).collect())) == mined(rows)
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []
