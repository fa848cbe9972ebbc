import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, n string, row string"

WORDS = "the of and in for with is by to from on at as that this".split()


def sentence(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.6 else "") for _ in range(n))


def rows():
    """Hand-made documents: plain ones, copies, near copies, nulls, empties, a very long one, clashing columns."""
    base = [(i, sentence(i, 20 + 13 * (i % 9)), "en" if i % 2 else "de", f"s{i % 3}") for i in range(24)]
    long = sentence(7, 80)
    near = long.split()
    near[40] = "changed"
    out = base + [(30, long, "en", "s0"), (31, " ".join(near), "en", "s0"), (32, long.upper(), "en", None), (33, long, None, "s1")]
    out += [(40, None, "en", "s0"), (41, "", "en", "s0"), (42, "  \n\t ", None, None), (43, "one", "en", "s2"), (44, "ONE", "en", "s2"), (45, sentence(99, 30_000), "en", "s0")]
    out += [(None, "a text without an id of its own", "en", "s0"), (50, "été à l'école — 日本語 ok", "fr", "s1"), (30, long, "en", "s0")]
    return [(a, b, c, d, None if b is None else len(b), "u", "n", "r") for a, b, c, d in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
