"""Each registered query of the library against DuckDB on the same tables."""

import decimal
import math
from collections import Counter

import duckdb
import pytest

from driftspark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or isinstance(v, (bool, int, str)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(plans.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(canon(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert Counter(tuple(canon(v) for v in r) for r in df.select(*columns).collect()) == want


def test_material_and_suppressed_partition_the_alerts(spark, sf):
    from driftspark.plans import evidence

    rows = evidence.classified(spark, sf).select("alert_id", "material", "reasons").collect()
    assert len({r.alert_id for r in rows}) == len(rows)
    assert all(r.material == (not r.reasons) for r in rows)


def test_upsert_is_idempotent(spark):
    from driftspark.operators.evidence import upsert_notifications

    run = spark.createDataFrame([("m", "a", "2024-02-01", 1), ("m", "b", "2024-02-01", 2)], "rm_id string, alert_id string, seen string, policy_rank int")
    state = spark.createDataFrame([("m", "a", "2024-01-01", True, 9), ("m", "c", "2024-01-01", True, 3)], "rm_id string, alert_id string, first_seen string, active boolean, position int")
    once = upsert_notifications(state, run)
    twice = upsert_notifications(once, run)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("m", "a", "2024-01-01", True, 1), ("m", "b", "2024-02-01", True, 2), ("m", "c", "2024-01-01", False, 3)]


def test_maker_checker(spark):
    from driftspark.operators.governance import maker_checker

    requests = spark.createDataFrame([(1, "x", "pending"), (2, "x", "pending")], "request_id int, maker string, status string")
    decisions = spark.createDataFrame([(1, 1, "x", "approved", 1), (2, 2, "y", "approved", 1), (3, 2, "z", "rejected", 2), (4, 7, "z", "approved", 1)], "decision_id int, request_id int, checker string, decision string, decided_at int")
    got = {r.decision_id: r.reason for r in maker_checker(requests, decisions).collect()}
    assert got == {1: "maker_is_checker", 2: None, 3: "already_decided", 4: "unknown_request"}
