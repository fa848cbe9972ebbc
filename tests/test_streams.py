"""The stream of page visits: restarts, expiry, and the state it leaves."""

import datetime as dt

from driftspark.streaming import feeds

SCHEMA = "url string, html string, seen_at timestamp"
DAY_MS = 86_400_000


def test_page_visits_restart_and_expire(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    digest = lambda text: __import__("hashlib").sha256(text.encode()).hexdigest()
    known = spark.createDataFrame([("k", digest("one"), at(0)), ("k", digest("older"), at(-1)), ("gone", digest("x"), at(-300)), (None, "x", at(0))], "url string, sha256 string, seen_at timestamp")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = feeds.page_visits(spark.readStream.schema(SCHEMA).parquet(source), known, 30 * DAY_MS, emit_unchanged=True)
        with feeds.rocksdb(spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return {(r.url, r.seen_at): (r.changed, r.first_seen, r.previous) for r in spark.read.parquet(out).collect()}

    first = run([("k", "<p>one</p>", at(1)), ("k", "<p>two</p>", at(2)), ("gone", "<p>x</p>", at(1)), ("new", "<p>n</p>", at(2)), (None, "<p>n</p>", at(2)), ("none", None, at(2))])
    assert first == {("k", at(1)): (False, False, digest("one")), ("k", at(2)): (True, False, digest("one")), ("gone", at(1)): (True, True, None), ("new", at(2)): (True, True, None)}
    second = run([("k", "<p>two</p>", at(3)), ("new", "<p>m</p>", at(3))])  # a new query on the old checkpoint
    assert second[("k", at(3))] == (False, False, digest("two")) and second[("new", at(3))] == (True, False, digest("n")) and len(second) == 6
    third = run([("k", "<p>two</p>", at(50))])
    assert third[("k", at(50))] == (True, True, None)
    fourth = run([("new", "<p>m</p>", at(51)), ("k", "<p>two</p>", at(51))])  # the watermark is past the expiry of new's state
    assert fourth[("new", at(51))] == (True, True, None) and fourth[("k", at(51))] == (False, False, digest("two"))
    state = {(r.url, r.sha256) for r in feeds.last_visits(spark.read.parquet(out), known.where("url is not null")).collect()}
    assert state == {("k", digest("two")), ("gone", digest("x")), ("new", digest("m"))}
