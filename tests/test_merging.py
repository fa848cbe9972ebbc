"""Merging of an alert's comparisons against brute force."""

import random

RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def _merged(rows):
    """The statement, row by row."""
    out = {}
    for key, order, changes, reason, level in sorted(rows, key=lambda r: (r[0], r[1])):
        at = out.setdefault(key, {"before": {}, "after": {}, "reasons": [], "level": "low"})
        for field, before, after in changes:
            at["before"].setdefault(field, before)
            values = at["after"].setdefault(field, [])
            values.extend(v for i, v in enumerate(after) if v not in values and v not in after[:i])
        if reason and reason not in at["reasons"]:
            at["reasons"].append(reason)
        if level and RANK[level] > RANK[at["level"]]:
            at["level"] = level
    return {k: (sorted(v["before"]), v["before"], v["after"], " ".join(v["reasons"]), v["level"]) for k, v in out.items()}


def test_merge_keeps_first_values_and_order(spark):
    from driftspark.operators.evidence import merge_comparisons

    rng = random.Random(3)
    value = lambda: rng.choice("pqrstu")
    rows = []
    for order in range(400):
        changes = [(f, [value()] * rng.randrange(3), [value() for _ in range(rng.randrange(4))]) for f in rng.sample(["name", "owner", "place"], rng.randrange(4))]
        rows.append(("hot" if order % 3 else rng.choice("abc"), f"{order:04}", changes, rng.choice(["", None, "one.", "two.", "three."]), rng.choice([None, *RANK])))
    rows.append(("bare", "0", [], None, None))
    schema = "k string, o string, changes array<struct<field:string,before_values:array<string>,after_values:array<string>>>, comparison_reason string, materiality string"
    df = spark.createDataFrame(rng.sample(rows, len(rows)), schema)
    got = merge_comparisons(df.repartition(7), ["k"], "o").collect()
    assert len(got) == 5 and {r.k: (r.changed_fields, r.before, r.after, r.comparison_reason, r.materiality) for r in got} == _merged(rows)
    assert merge_comparisons(df.limit(0), ["k"], "o").count() == 0


def test_sentence_quality(spark):
    from driftspark.operators.evidence import sentence_quality

    rows = [("short", 0), ("x" * 90, 2), ("x" * 160, 3), ("It ANNOUNCED a plan", 3), ("a|b", -3), ("News | The Guardian", -9), ("Skip to main content: it has closed" + "x" * 60, -1), ("|" + "x" * 219, 3), (None, 0)]
    df = spark.createDataFrame(rows, "t string, want int")
    assert [r for r in df.withColumn("got", sentence_quality(df.t)).collect() if r.got != r.want] == []
