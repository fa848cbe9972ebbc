"""The findings of round 3: what failed before, on small planted rows."""

import datetime as dt
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from driftspark import plans
from driftspark.operators import bank, chain, facts
from driftspark.streaming import feeds


def test_f1_linked_entities_of_a_group_are_not_paired_with_its_customers(spark):
    day = dt.date(2020, 1, 1)
    txns = spark.createDataFrame([(1, "A-b Ltd", "in", 5.0), (1, "A B LTD", "in", 2.0), (2, "A-b Ltd", "out", 1.0), (3, "A-b Ltd", "in", 9.0), (1, "other", "in", 1.0)], "customer_id long, counterparty string, direction string, amount double").withColumn("booked_on", F.lit(day))
    groups = spark.createDataFrame([(1, 7), (1, 8), (1, 7), (2, 7), (3, 9)], "customer_id long, group long")
    entities = spark.createDataFrame([(7, "a b ltd"), (8, "A  B Ltd"), (9, "c")], "group long, entity string")
    got = Counter(map(tuple, bank.linked_entity_flow(txns, entities, groups).collect()))
    assert got == Counter(map(tuple, bank.linked_entity_flow(txns, groups.join(entities, "group").select("customer_id", "entity")).collect())) == {(1, "a b ltd", "in", 2, 7.0): 1, (2, "a b ltd", "out", 1, 1.0): 1}


WORDS = ["die", "dieß", "ädie", "die1", "die_", "die-", "dié", "1die", "DIE!", "theé", "éles", "leſ", "les‿", "leⓐ", "lesⅣ", "les²", "fröhlichö", "fröhlich.", "thané", "than"]


def test_f2_to_f5_words_end_where_unicodes_do_in_query_and_sql(spark, sf, tmp_path):
    """Accented letters beside a pattern's words: the ladders and their SQL name the same jurisdictions."""
    con = duckdb.connect()
    for t in ("nation", "region", "customer"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    rows = [(i, f"erach thering\n{w} cited\nbody", "en", "web", 9) for i, w in enumerate(WORDS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("fact_new_jurisdiction", "fact_confidence", "fact_low_confidence_skip", "fact_ids"):
        df = plans.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(df.columns)} from ({plans.SQL[name]})").fetchall()
        assert want and Counter(map(tuple, df.collect())) == Counter(want), name
    found = spark.createDataFrame([(w,) for w in WORDS], "w string").where(F.size(facts.named_jurisdictions(F.col("w"), ("x",), {"x": (r"\bdie\b",)})) > 0)
    assert [r.w for r in found.collect()] == ["die", "die-", "DIE!"]


def test_f6_several_visits_of_a_url_have_one_previous_each(spark, tmp_path):
    """Repeated urls, with and without state, one of them null: a visit is compared with the one before it, in query and SQL."""
    html = lambda x: f"<p>{x}</p>"
    rows = [(1, "u", html("a")), (2, "u", html("b")), (4, "u", html("c")), (5, "u", html("a")), (6, "v", html("a")), (7, "v", html("a")), (5, "w", html("a")), (10, "w", html("b")), (11, None, html("x")), (12, "y", html("x")), (13, "z", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for t in ("events", "customer", "nation", "region", "lineitem", "orders", "supplier", "part", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = plans.QUERIES["st_page_changes"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({plans.SQL['st_page_changes']})").fetchall()
    assert len(want) == 9 and Counter(map(tuple, df.collect())) == Counter(want)


def test_f10_to_f16_transactions_are_joined_once(spark, sf):
    """The joined transactions are stored, or read for both sides at once: no query joins the lines of orders again for each of its parts."""
    for name, most in {"chain_sanctioned": 1, "chain_bridge": 0, "chain_unusual_volume": 0, "chain_contract_abuse": 0, "chain_high_risk_link": 0, "fused_context": 0, "fuse_alerts": 0}.items():
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation [l_orderkey" in line for line in plan.splitlines()) <= most, name


def test_f14_only_activity_that_can_count_is_read(spark, sf):
    plan = plans.QUERIES["play_linked_cluster"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [l_orderkey" in line for line in plan.splitlines()) == plan.count("1998-01-01") + plan.count("1997-10-03") > plan.count("1998-01-01")


def test_f16_touching_keeps_both_sides(spark):
    transfers = spark.createDataFrame([(1, 2, 5), (2, 1, 6), (2, 2, 7), (3, 4, 8), (None, 2, 9)], "sender long, receiver long, amount long")
    got = Counter((r.sender, r.receiver, r.amount, r.side) for r in chain.touching(transfers, spark.createDataFrame([(2,), (9,)], "address long")).collect())
    assert got == {(1, 2, 5, "receiver"): 1, (2, 1, 6, "sender"): 1, (2, 2, 7, "sender"): 1, (2, 2, 7, "receiver"): 1, (None, 2, 9, "receiver"): 1}


def test_f13_deposits_across_wide_buckets_are_paired(spark):
    """All days of a year against each other: buckets of two spans lose no pair and find none twice."""
    days = [dt.date(2019, 12, 20) + dt.timedelta(i) for i in range(0, 200, 3)]
    rows = spark.createDataFrame([(1, d, c, 100.0) for d in days for c in ("x", "y")], "sender long, ts date, chain string, amount double")
    want = sum(0 <= (b - a).days <= 30 for a in days for b in days)
    assert {(r.in_chain, r.out_chain): r.crossings for r in chain.bridges(rows, 30, 0.2).collect()} == {("x", "y"): want, ("y", "x"): want}


def test_f9_hops_equal_a_search(spark):
    edges = [(1, 2), (2, 3), (3, 4), (5, 3), (6, 6), (7, 8), (2, 1), (9, 1)]
    got = sorted(map(tuple, chain.within_hops(spark.createDataFrame(edges, "sender long, receiver long"), spark.createDataFrame([(1,), (1,), (8,)], "address long"), 2).collect()))
    assert got == [(1, 0), (2, 1), (3, 2), (7, 1), (8, 0), (9, 1)]


def test_f8_value_changes_by_buckets_of_keys(spark, tmp_path):
    """Three batches of many keys in few buckets, large and null keys, null values: as a walk through each key's rows. Python is called for buckets, not for keys."""
    schema = "a long, b string, ts timestamp, v string"
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    big, values = 2**60 + 1, ["x", None, "y", "x", "None", None, None, "y"]
    keys = [(big, "p"), (big + 1, "p"), (None, "q"), (7, None), *[(i, "r") for i in range(20)]]
    want, last = Counter(), {}
    for batch in range(3):
        rows = [(*k, t(100 * batch + i), values[(i * (batch + 2) + n) % 8]) for n, k in enumerate(keys) for i in range(4 if n % 3 else 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for a, b, at, v in sorted(rows, key=lambda r: r[2]):
            want[(a, b, at, v)] += (a, b) not in last or last[(a, b)] != v
            last[(a, b)] = v
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = feeds.value_changes(stream, ["a", "b"], "ts", "v", "a long, b string, at timestamp, value string", buckets=3)
    found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert Counter(tuple(r) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()) == +want


def test_f7_numbered_names_meet_about_once_a_pair(spark):
    """Names that differ in their numbers: all pairs within two edits, few of them twice, and keys made by all tasks."""
    number = lambda c, p: F.format_string(f"{p} %09d", c).alias("known" if p == "b" else "name")
    left, right = spark.range(1000).select(number("id", "a")), spark.range(0, 1000, 25).select(number(F.col("id") + 4, "b"))
    want = left.crossJoin(right).withColumn("distance", F.levenshtein("name", "known")).where("distance <= 2")
    found = bank._near_pairs(left, right)
    assert found.distinct().exceptAll(want).count() == want.exceptAll(found.distinct()).count() == 0
    keys = [bank._name_keys(x, c, spark.createDataFrame([([11],)], "lengths array<int>"), c == "name") for x, c in ((left, "name"), (right, "known"))]
    assert keys[0].rdd.getNumPartitions() == 4
    assert want.count() <= found.count() <= 1.5 * want.count() and keys[0].join(keys[1], "key").count() < 4 * want.count()


def test_f7_each_row_of_a_name_is_screened(spark):
    """Several spellings of a name, repeated rows, null and wordless names; the names are normalised once each, not once a row."""
    rows = [(1, "ACME Trading, Ltd."), (1, "ACME Trading, Ltd."), (2, "Acme  trading"), (3, "acme tradng"), (4, None), (5, "the ltd"), (6, "acme trading"), (7, "ac"), (8, "")]
    entries = spark.createDataFrame([("Acme Trading", "sanctions", ["AB", None]), (None, "exposed", [])], "entry string, list_name string, aliases array<string>")
    found = bank.screen_names(spark.createDataFrame(rows, "id int, name string"), entries, least=0.4)
    assert Counter(map(tuple, found.collect())) == Counter([(1, "ACME Trading, Ltd.", "Acme Trading", "sanctions", "exact", 1.0)] * 2 + [(2, "Acme  trading", "Acme Trading", "sanctions", "exact", 1.0), (3, "acme tradng", "Acme Trading", "sanctions", "near", 0.9167), (6, "acme trading", "Acme Trading", "sanctions", "exact", 1.0), (7, "ac", "Acme Trading", "sanctions", "near", 0.5)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "regexp_replace(replace(lower(name" not in plan
