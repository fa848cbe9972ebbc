"""Operators that look back over a key's past, against brute force over small random histories."""

import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

DAY = dt.timedelta(days=1)
START = dt.date(2024, 1, 1)


@pytest.mark.parametrize("most", [0, 2])
def test_quiet_days_look_back_without_pairing(spark, most):
    from driftspark.operators.bank import linked_clusters, quiet_days

    rng = random.Random(most)
    pays = [(rng.randrange(4), rng.randrange(12), START + rng.randrange(60) * DAY) for _ in range(120)] + [(1, None, START), (1, 3, None), (2, 99, START)]
    past = [(rng.randrange(12), START + rng.randrange(-20, 60) * DAY) for _ in range(60)] + [(None, START), (3, None)]
    payments = spark.createDataFrame(pays, "counterparty_id int, customer_id int, booked_on date")
    activity = spark.createDataFrame(past, "customer_id int, booked_on date")
    before = lambda c, day: sum(x == c and d is not None and day - 10 * DAY <= d < day for x, d in past)
    quiet = {(c, d) for _, c, d in pays if c is not None and d is not None and before(c, d) <= most}
    assert {tuple(r) for r in quiet_days(payments, activity, 10, most).collect()} == quiet
    kept = [(p, c, d) for p, c, d in pays if (c, d) in quiet]
    want = {}
    for p, _, d in kept:
        near = {c for q, c, e in kept if q == p and abs((e - d).days) <= 2}
        if len(near) >= 2:
            want[p, d] = len(near)
    got = linked_clusters(payments, 2, 2, activity, 10, most).collect()
    assert len(got) == len(want) and {(r.counterparty_id, r.booked_on): r.customers for r in got} == want


def test_quiet_days_of_empty_tables(spark):
    from driftspark.operators.bank import quiet_days

    some = spark.createDataFrame([(1, START)], "customer_id int, booked_on date")
    assert [tuple(r) for r in quiet_days(some, some.limit(0), 5, 0).collect()] == [(1, START)]
    assert quiet_days(some.limit(0), some, 5, 0).count() == 0


def test_holdings_and_large_holders(spark):
    from driftspark.operators.chain import holdings, large_holders

    rng = random.Random(5)
    moves = [(START + rng.randrange(12) * DAY, rng.randrange(5), rng.randrange(5), rng.choice("xy"), Decimal(rng.randrange(0, 40))) for _ in range(150)] + [(START, 1, 2, None, Decimal(5)), (START, 1, None, "x", Decimal(7))]
    df = spark.createDataFrame([(dt.datetime.combine(t, dt.time(9)), a, b, k, v) for t, a, b, k, v in moves], "ts timestamp_ntz, sender int, receiver int, asset string, amount decimal(18,2)")
    balance, want = defaultdict(Decimal), {}
    for day in sorted({m[0] for m in moves}):
        changed = Counter()
        for t, a, b, k, v in moves:
            if t == day and k is not None:
                for who, sign in ((a, -1), (b, 1)):
                    if who is not None:
                        changed[who, k] += sign * v
        for key, v in changed.items():
            balance[key] += v
        for (who, k), v in changed.items():
            if v:
                want[who, k, day] = (balance[who, k], sum(max(b, 0) for (_, a), b in balance.items() if a == k))
    got = holdings(df).collect()
    assert len(got) == len(want) and {(r.address, r.asset, r.day): (r.balance, r.total) for r in got} == want
    large = {k: float(b) / float(t) for k, (b, t) in want.items() if t and float(b) / float(t) >= 0.4}
    assert large and {(r.address, r.asset, r.day): r.share for r in large_holders(df, 0.4).collect()} == pytest.approx(large)
    assert holdings(df.limit(0)).count() == 0


def test_frequent_days(spark):
    from driftspark.operators.chain import frequent_days

    at = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(at(1), "a", 1.0), (at(2), "a", 1.0), (at(3), "b", 9.0), (at(4), "c", 1.0)], "ts timestamp_ntz, sender string, amount double")
    assert {(r.sender, r.transfers, r.volume) for r in frequent_days(df, 2, 9).collect()} == {("a", 2, 2.0), ("b", 1, 9.0)}
