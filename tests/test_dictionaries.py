"""Dictionary matching against brute force, with nested, long, shared and broken entries."""

import random
import re

import pytest

DICTIONARY = "position int, label string, phrase string"


def _brute(texts, entries):
    out = set()
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    for key, text in texts:
        if text is None:
            continue
        words, hits = split(text), set()
        for position, label, phrase in entries:
            e = split(phrase or "")
            hits |= {(i + 1, len(e), position, label) for i in range(len(words) - len(e) + 1) if e and words[i : i + len(e)] == e}
        inside = lambda a: any(b[0] <= a[0] and a[0] + a[1] <= b[0] + b[1] and b[1] > a[1] for b in hits)  # noqa: B023, E731
        out |= {(key, *h) for h in hits if not inside(h)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_brute_force(spark, seed):
    from driftspark.operators.dictionaries import dictionary_matches, labels_found

    rng = random.Random(seed)
    phrase = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    entries = [(i, f"L{rng.randrange(12)}", phrase(rng.randrange(1, 8))) for i in range(30)] + [(90, "same", "a b"), (91, "other", "A, b"), (92, "none", None), (93, "bare", "--")]
    texts = [(i, rng.choice([" ", ", ", "_"]).join(phrase(1).upper() if rng.random() < 0.3 else phrase(1) for _ in range(rng.randrange(60)))) for i in range(25)] + [(98, None), (99, "")]
    df, words = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(entries, DICTIONARY)
    want = _brute(texts, entries)
    got = [tuple(r) for r in dictionary_matches(df, "k", "t", words, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {}
    for k, _, _, position, label in want:
        first.setdefault(k, {})[label] = min(position, first.get(k, {}).get(label, position))
    assert {r.k: r.found for r in labels_found(df, "k", "t", words, 3).collect()} == {k: sorted(v, key=lambda x: (v[x], x)) for k, v in first.items()}


def test_the_longest_name_wins_and_order_is_the_dictionarys(spark):
    from driftspark.operators.dictionaries import labels_found

    words = spark.createDataFrame([(1, "Guinea", "Guinea"), (2, "Papua New Guinea", "Papua New Guinea"), (3, "Österreich", "österreich"), (4, "Peru", "Peru")], DICTIONARY)
    texts = spark.createDataFrame([(1, "PERU; Papua  New\nGuinea"), (2, "Papua New Guinea, Guinea, ÖSTERREICH."), (3, "Peruvian")], "k int, t string")
    assert {r.k: r.found for r in labels_found(texts, "k", "t", words).collect()} == {1: ["Papua New Guinea", "Peru"], 2: ["Guinea", "Papua New Guinea", "Österreich"]}
    assert labels_found(texts.limit(0), "k", "t", words).count() == labels_found(texts, "k", "t", words.limit(0)).count() == 0


def test_the_plan_does_not_grow_with_the_dictionary(spark):
    from driftspark.operators.dictionaries import labels_found

    texts = spark.range(100).selectExpr("id AS k", "concat('entry ', id) AS t")
    size = lambda n: len(labels_found(texts, "k", "t", spark.range(n).selectExpr("CAST(id AS INT) AS position", "concat('E', id) AS label", "concat('entry ', id) AS phrase"))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(12) == size(10_000)
