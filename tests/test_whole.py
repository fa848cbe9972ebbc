"""Queries over whole inputs: against SQL without the cut that the registered SQL holds, or against small made-up rows."""

import datetime
import hashlib
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from driftspark import plans
from tests.test_plans import TABLES, canon


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def agree(df, duck, sql):
    columns = sorted(df.columns)
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(canon(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert want and sorted(tuple(canon(v) for v in r) for r in df.select(*columns).collect()) == want


OWNERSHIP = ["own_documents", "own_records", "own_summary", "own_questions", "own_rollup", "own_sort", "prof_investors", "prof_build", "prof_completeness", "prof_next_steps", "prof_summary"]


@pytest.mark.parametrize("name", OWNERSHIP)
def test_ownership_reads_every_document(spark, sf, duck, name):
    cut = " WHERE document_id % 2 = 0"
    agree(plans.QUERIES[name](spark, sf), duck, plans.SQL[name].replace(cut, ""))


def write(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_encoding_is_repaired_in_every_language(spark, sf, duck, tmp_path):
    agree(plans.QUERIES["text_encoding_repair"](spark, sf), duck, plans.SQL["text_encoding_repair"].replace(" WHERE lang = 'fr'", ""))
    good = ["Élève à l’école – déjà", "Größe über alles", "plain", "ñandú “él”", "naïve → 中文 Ã", None, ""]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(good, ["fr", "de", "en", "es", "en", "en", "fr"], strict=True))]
    rows += [(10, good[0].encode().decode("cp1252"), "fr"), (11, good[1].encode().decode("latin-1"), "de"), (12, "ñandú él".encode().decode("cp1252"), "es"), (13, "ÃO JOÃO", "es")]
    write(spark, tmp_path, rows, "doc_id long, text string, lang string", "documents")
    got = {r.doc_id: r.sha for r in plans.QUERIES["text_encoding_repair"](spark, str(tmp_path)).collect()}
    want = {i: t for i, t, _ in rows} | {10: good[0], 11: good[1], 12: "ñandú él"}
    assert got == {i: t if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_notifications_have_no_cap(spark, sf, duck):
    agree(plans.QUERIES["notify_list"](spark, sf), duck, plans.SQL["notify_list"].replace(" WHERE policy_rank <= 5", " WHERE policy_rank IS NOT NULL"))


def test_watch_lists_are_joined_as_pairs(spark):
    from driftspark.operators.evidence import evaluate_policies

    alerts = spark.createDataFrame([(i % 2, f"a{i}", True, 0.9, 100 + i, "risk", "high", "x", [("u",)]) for i in range(9)], "customer_id long, alert_id string, in_window boolean, confidence double, material_score int, category string, severity string, signal_type string, evidence array<struct<source_url:string>>")
    policies = spark.createDataFrame([("m", 50, 0.5, ["risk"], ["high"], []), ("n", 107, 0.5, ["risk"], ["high"], [])], "rm_id string, minimum_material_score int, minimum_confidence double, categories array<string>, severities array<string>, signal_types array<string>")
    watched = spark.createDataFrame([("m", 0), ("m", 1), ("n", 1)], "rm_id string, customer_id long")
    out = evaluate_policies(alerts, policies, watched)
    ranks = {(r.rm_id, r.alert_id): r.policy_rank for r in out.collect()}
    assert ranks == {("m", f"a{i}"): 9 - i for i in range(9)} | {("n", f"a{i}"): 1 if i == 7 else None for i in (1, 3, 5, 7)}
    assert "BROADCAST" not in out._jdf.queryExecution().optimizedPlan().toString().upper()


def test_notify_list_goes_beyond_the_fifth(spark, monkeypatch):
    from driftspark.plans import evidence

    rows = [("m", f"a{i}", 2 * i, [], i) for i in range(1, 8)] + [("m", "b", 2, ["category_disabled"], None)]
    judged = spark.createDataFrame(rows, "rm_id string, alert_id string, customer_id long, failures array<string>, policy_rank int")
    monkeypatch.setattr(evidence, "judged", lambda spark, d: judged)
    assert [(r.policy_rank, r.alert_id) for r in plans.QUERIES["notify_list"](spark, "").collect()] == [(i, f"a{i}") for i in range(1, 8)]


def test_integrity_counts_every_broken_row(spark, sf, duck):
    from driftspark.operators.evidence import integrity

    found = {r.error: r.rows for r in plans.QUERIES["integrity_check"](spark, sf).collect()}
    want = dict(duck.execute(plans.SQL["integrity_check"].replace("customer_id % 9 <> 0 AND ", "")).fetchall())
    assert want.items() <= found.items()
    facts = [("f1", 9, 1, "t", "A", 0.5, "o", None), ("f2", 1, 1, "t", "A", 0.5, None, ""), ("f3", 1, 7, "t", None, 0.5, None, "v")]
    alerts = [("a1", 1, "c", "s", "o", ["x"], "low", 0.5, [(1,), (8,)], ["f1", "f9"]), ("a2", 1, "c", "s", None, [], "low", 0.5, [], [])]
    out = integrity(
        spark.createDataFrame(facts, "fact_id string, customer_id long, document_id long, fact_type string, source_quality string, confidence double, object string, value string"),
        spark.createDataFrame(alerts, "alert_id string, customer_id long, category string, signal_type string, object string, changed_fields array<string>, severity string, confidence double, evidence array<struct<document_id:long>>, fact_ids array<string>"),
        spark.createDataFrame([(1,)], "document_id long"),
        spark.createDataFrame([(1,)], "customer_id long"),
    )
    once = "fact_fields fact_content alert_fields empty_fields alert_facts alert_evidence fact_document fact_customer alert_fact alert_document".split()
    assert {r.error: r.rows for r in out.collect()} == dict.fromkeys(once, 1)


def test_late_rows_are_those_behind_the_watermark(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    for i, rows in enumerate([[(10, 10), (1, 3)], [(20, 20)], [(21, 21)], [(30, 2), (23, 22)]]):
        path = str(tmp_path / f"events.parquet/part-{i}.parquet")
        table = {"event_id": [e for e, _ in rows], "ts": pa.array([datetime.datetime(2024, 1, day) for _, day in rows], pa.timestamp("us"))}
        pq.write_table(pa.table(table), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    got = {r.event_id: r.late for r in plans.QUERIES["st_late_rows"](spark, str(tmp_path)).collect()}
    assert got == {10: False, 1: False, 20: False, 21: False, 30: True, 23: False}


def test_pages_are_read(spark, tmp_path):
    pages = [(1, '<ix:header>x</ix:header><div style="display:none">y</div><p>kept</p>'), (2, '<meta property="article:published_time" content="2022-03-04T08:00:00Z"><p>On May 6, 2021</p>'), (3, "<p>On May 6, 2021</p>"), (4, "<p>undated</p>"), (5, None)]
    write(spark, tmp_path, pages, "page_id long, html string", "pages")
    pruned = {r.page_id: r.sha for r in plans.QUERIES["pages_prune_html"](spark, str(tmp_path)).collect()}
    assert pruned == {i: h and hashlib.sha256(h.encode()).hexdigest() for i, h in (dict(pages) | {1: "  <p>kept</p>"}).items()}
    assert {r.page_id: r.day for r in plans.QUERIES["pages_published_at"](spark, str(tmp_path)).collect() if r.day} == {2: "2022-03-04", 3: "2021-05-06"}


def test_page_text_title_and_date(spark):
    from pyspark.sql import functions as F

    from driftspark.functions.text import visible_text
    from driftspark.operators.discovery import published_at, title

    html = """<html><head><script>var x = '<p>no</p>';</script><style>p {}</style></head><body><div style="color: red; display : none"><p>hidden <b>deep</b></p></div>
<table><tr><th>Name</th><td>A &amp; B</td></tr></table><blockquote>same</blockquote><address>same</address><!-- <p>gone</p> --><noscript>off</noscript><svg><text>drawn</text></svg><p>last   line</p></body></html>"""
    dated = ['<meta content="March 4, 2022" name="pubdate">', '<script>{"datePublished": "2022-03-04T01:00:00Z"}</script>', "<meta name='dc.date' content='3/4/2022'>", "<p>seen 2022-03-04</p>", "<p>" + "x" * 2000 + " 2022-03-04</p>"]
    rows = spark.createDataFrame([(0, html), *enumerate(dated, 1), (9, "")], "id int, html string")
    out = {r.id: r for r in rows.select("id", visible_text(F.col("html")).alias("text"), title(F.col("html")).alias("title"), published_at(F.col("html"), visible_text(F.col("html"))).alias("day"), title(F.col("html"), F.lit("told")).alias("told")).collect()}
    assert out[0].text == "Name\nA & B\nsame\nlast line"
    assert out[0].title == "Name\nA & B\nsame\nlast line" and out[9].title == "Untitled source" and out[9].told == "told"
    assert [out[i].day for i in range(1, 6)] == ["2022-03-04"] * 4 + [None]


def test_quotes_of_any_length_are_grounded(spark):
    from driftspark.operators.discovery import grounded_pairs

    docs = {1: "The quick brown fox jumps", 2: "over the lazy dog, the end", 3: "quickly", 4: None, 5: "", 6: "the the the"}
    quotes = {1: "quick brown fox", 2: "quick", 3: "he la", 4: "zy d", 5: "e", 6: "", 7: None, 8: "brown fox jumps over", 9: "dog,  the\nend", 10: "the the"}
    fold = lambda t: " ".join((t or "").lower().split())
    want = {(i, j) for i, t in docs.items() for j, q in quotes.items() if fold(q) and fold(q) in fold(t)}
    got = grounded_pairs(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame(list(quotes.items()), "item_id int, quote string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_audit_chain_shows_changes_losses_and_moves(spark):
    from pyspark.sql import functions as F

    from driftspark.operators.governance import chained, verify_chain

    rows = spark.createDataFrame([(c, i, f"v{i}") for c in "abcd" for i in range(1, 7)], "c string, i int, v string")
    stored = chained(rows, ["c"], ["i"], ["i", "v"]).cache()
    last = None
    for r in sorted(stored.where("c = 'a'").collect(), key=lambda r: r.i):
        assert r.previous_hash == last
        last = hashlib.sha256(f"{last or ''}|{r.i}|{r.v}".encode()).hexdigest()
        assert r.event_hash == last
    lost = stored.where("not (c = 'b' and i = 3)")
    fourth = F.max(F.when((F.col("c") == "b") & (F.col("i") == 2), F.col("event_hash")))
    mended = lost.withColumn("previous_hash", F.when((F.col("c") == "b") & (F.col("i") == 4), F.lit(stored.agg(fourth).first()[0])).otherwise(F.col("previous_hash")))
    changed = mended.withColumn("v", F.when((F.col("c") == "c") & (F.col("i") == 5), "x").otherwise(F.col("v")))
    moved = changed.withColumn("i", F.when((F.col("c") == "d") & (F.col("i") == 2), 3).when((F.col("c") == "d") & (F.col("i") == 3), 2).otherwise(F.col("i")))
    assert {r.c: (r.valid, r.first_break) for r in verify_chain(moved, ["c"], ["i"], ["i", "v"]).collect()} == {"a": (True, None), "b": (False, 4), "c": (False, 5), "d": (False, 2)}


def test_bursts_across_any_boundary(spark):
    from driftspark.operators.chain import repeated_calls, structuring

    days = [datetime.date(1970, 3, 30), datetime.date(1970, 4, 2), datetime.date(1970, 4, 2), datetime.date(1971, 1, 1)]
    t = spark.createDataFrame([(d, 1, 2, 10.0) for d in days], "ts date, sender int, receiver int, amount double")
    got = structuring(t, spark.createDataFrame([(2,)], "address int"), 50.0, 4, 2).collect()
    assert sorted((r.window_start, r.transfers, r.volume) for r in got) == [(days[0], 3, 30.0), (days[1], 2, 20.0)]
    assert [(r.window_start, r.calls) for r in repeated_calls(t, 300, 4).collect()] == [(days[0], 4)]


def test_material_tables_hold_the_whole_vocabulary():
    from driftspark.functions import rules

    assert len(rules.MATERIAL_KEYWORDS) == 27 and len(rules.BUSINESS_IMPACT_KEYWORDS) == 15


def test_dates_are_read_from_texts(spark, tmp_path):
    texts = ["seen 20220304T050607Z", "on 2022-03-04 at noon", "the 4 Mar 2022 issue", "at 2022-03-04 05:06:07.", "soon", "Published March 4, 2022", "3/4/2022"]
    write(spark, tmp_path, [(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string", "documents")
    write(spark, tmp_path, [(1,)], "c_custkey long", "customer")
    assert {r.doc_id: r.day for r in plans.QUERIES["date_normalize"](spark, str(tmp_path)).collect() if r.day} == dict.fromkeys((1, 3, 5, 6), "2022-03-04")


def test_clusters_count_each_customer_once(spark):
    import itertools
    import random

    from driftspark.operators.bank import linked_clusters

    rng = random.Random(5)
    start = datetime.date(2024, 1, 1)
    rows = [(rng.randrange(3), rng.randrange(6), start + datetime.timedelta(rng.randrange(40))) for _ in range(60)]
    got = {(r.counterparty_id, r.booked_on): r.customers for r in linked_clusters(spark.createDataFrame(rows, "counterparty_id int, customer_id int, booked_on date"), 2, 3).collect()}
    want = {}
    for party, day in {(p, d) for p, _, d in rows}:
        near = {c for p, c, d in rows if p == party and abs((d - day).days) <= 2}
        if len(near) >= 3:
            want[party, day] = len(near)
    assert got == want and want
    assert all(a != b for a, b in itertools.combinations(got, 2))


def test_names_are_screened_by_alias_and_likeness(spark):
    from driftspark.operators.bank import screen_names

    parties = spark.createDataFrame([(1, "ACME Trading, Ltd."), (2, "Northwind Traders"), (3, "Acme Tradingg"), (4, "Other Firm"), (5, None), (6, "Ltd"), (7, "Acme Trade"), (8, "Akme Trading")], "id int, name string")
    entries = spark.createDataFrame([("Acme Trading", "sanctions", ["North-Wind Traders", "Northwind Traders Inc"]), ("Firmament", "exposed", None)], "entry string, list_name string, aliases array<string>")
    got = {(r.id, r.entry): (r.list_name, r.reason, r.score) for r in screen_names(parties, entries).collect()}
    assert got == {(1, "Acme Trading"): ("sanctions", "exact", 1.0), (2, "Acme Trading"): ("sanctions", "alias", 0.95), (3, "Acme Trading"): ("sanctions", "near", 0.9231), (8, "Acme Trading"): ("sanctions", "near", 0.9167)}


def test_loans_repaid_across_buckets(spark):
    import random

    from driftspark.operators.chain import repaid_loans

    rng = random.Random(3)
    start = datetime.date(1970, 1, 20)
    make = lambda n: [(1, rng.randrange(2), start + datetime.timedelta(rng.randrange(60)), float(rng.choice([0, 75, 80, 99, 100, 101, 124, 125, 200]))) for _ in range(n)]
    ins, outs = make(60), make(60)
    frame = lambda rows: spark.createDataFrame(rows, "sender int, receiver int, ts date, amount double")
    got = {(r.receiver, r.window_start): r.repayments for r in repaid_loans(frame(ins), frame(outs), 10, 0.25).collect()}
    want = {}
    for _, party, day, lent in ins:
        n = sum(p == party and 0 <= (d - day).days <= 10 and lent > 0 and back > 0 and abs(back - lent) <= lent * 0.25 for _, p, d, back in outs)
        if n:
            want[party, day] = want.get((party, day), 0) + n
    assert got == want and want


def test_policies_ask_for_a_source(spark, monkeypatch):
    from driftspark.operators.evidence import evaluate_policies

    cited = "evidence array<struct<source_url:string>>"
    scored = spark.createDataFrame([("a", 1, True, 0.9, 90, "risk", "high", "t", [("u",)]), ("b", 1, True, 0.9, 90, "risk", "high", "t", [(None,), ("",)]), ("c", 1, True, 0.9, 80, "risk", "high", "t", None)], f"alert_id string, customer_id int, in_window boolean, confidence double, material_score int, category string, severity string, signal_type string, {cited}")
    policies = spark.createDataFrame([("m", 50, 0.5, ["risk"], ["high"], [])], "rm_id string, minimum_material_score int, minimum_confidence double, categories array<string>, severities array<string>, signal_types array<string>")
    watched = spark.createDataFrame([("m", 1)], "rm_id string, customer_id int")
    got = {r.alert_id: (r.failures, r.policy_rank) for r in evaluate_policies(scored, policies, watched).collect()}
    assert got == {"a": ([], 1), "b": (["missing_source_url"], None), "c": (["missing_source_url"], None)}
