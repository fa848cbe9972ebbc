"""Streaming queries, run to completion over the events table, against the same aggregates in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftspark.functions import text as tx
from driftspark.plans.discovery import PAGES
from driftspark.plans.registry import query
from driftspark.sources import domain, readers
from driftspark.streaming import feeds


def _stream(spark, d, **options):
    schema = domain.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).options(**options).parquet(f"{d}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark, df, mode):
    """The whole result of a stream over what is there now, kept in the shared folder as a table."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    if mode == "append":
        run = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    else:
        run = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/log").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("st_documents_dedupe", "SELECT DISTINCT user_id, k FROM ev")
def st_documents_dedupe(spark, d):
    rows = _stream(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return _finished(spark, feeds.deduplicated(rows, ["user_id", "k"], "ts", "60 days").select("user_id", "k"), "append")


@query("st_volume_monthly", "SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume, TIMESTAMP '1970-01-01' + to_days(CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 30 * 30 AS INT)) AS start FROM ev GROUP BY user_id, 4")
def st_volume_monthly(spark, d):
    rows = _stream(spark, d).withColumn("amount", F.col("value").cast("decimal(18,2)"))
    out = _finished(spark, feeds.tumbling_volume(rows, "user_id", "ts", "amount"), "complete")
    return out.withColumns({"volume": F.col("volume").cast("double"), "start": F.col("start").cast("timestamp_ntz")})


@query("st_news_spike", """, h AS (SELECT user_id, date_trunc('hour', ts) AS h FROM ev WHERE event_type = 'error')
SELECT user_id, until, count(*) AS n FROM (SELECT user_id, unnest(generate_series(h + INTERVAL 1 HOUR, h + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS until FROM h) GROUP BY 1, 2 HAVING count(*) >= 3""")
def st_news_spike(spark, d):
    out = _finished(spark, feeds.spike_counts(_stream(spark, d).where("event_type = 'error'"), "user_id", "ts"), "complete")
    return out.where("n >= 3").withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("st_dormancy_session", """, g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM ev),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def st_dormancy_session(spark, d):
    out = _finished(spark, feeds.active_sessions(_stream(spark, d), "user_id", "ts", "1 day"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st_policy_join", "SELECT user_id, count(*) AS n FROM ev JOIN customer ON c_custkey = user_id WHERE value > 20 + c_nationkey GROUP BY 1")
def st_policy_join(spark, d):
    limits = domain.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.lit(20) + F.col("c_nationkey")).alias("least"))
    rows = feeds.with_policy(_stream(spark, d), limits, "user_id").where("value > least")
    return _finished(spark, rows.groupBy("user_id").agg(F.count("*").alias("n")), "complete")


@query("st_value_changes", "SELECT user_id, event_type, count(*) AS changes FROM (SELECT user_id, event_type, k, lag(k) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS p FROM ev) WHERE p IS DISTINCT FROM k GROUP BY 1, 2")
def st_value_changes(spark, d):
    rows = _stream(spark, d).withColumn("k", F.get_json_object("props", "$.k"))
    changes = feeds.value_changes(rows.select("user_id", "event_type", "ts", "k"), ["user_id", "event_type"], "ts", "k", "user_id long, event_type string, at timestamp, value string")
    return _finished(spark, changes, "append").groupBy("user_id", "event_type").agg(F.count("*").alias("changes"))


@query("st_page_changes", PAGES + """, st AS (SELECT url, max(CASE WHEN page_id % 4 = 0 THEN 'old' ELSE sha256(text) END) AS sha FROM vis WHERE page_id % 5 <> 0 AND url IS NOT NULL GROUP BY url),
seen AS (SELECT v.url, sha256(text) AS sha256, coalesce(lag(sha256(text)) OVER (PARTITION BY v.url ORDER BY sha256(text)), st.sha) AS previous FROM vis v LEFT JOIN st USING (url) WHERE v.url IS NOT NULL AND text IS NOT NULL)
SELECT url, sha256, previous, previous IS NULL AS first_seen, previous IS DISTINCT FROM sha256 AS changed FROM seen""")
def st_page_changes(spark, d):
    """Every visit to a page, changed or not, against the visit before, or the state that an earlier run left: one hash a url. All visits have one time, so those of a url come by hash."""
    pages = domain.table(spark, d, "pages")
    known = pages.where("page_id % 5 <> 0").select("url", F.when(F.col("page_id") % 4 == 0, "old").otherwise(F.sha2(tx.visible_text(F.col("html")), 256)).alias("sha256"), F.lit("2024-01-15 00:00:00").cast("timestamp").alias("seen_at"))
    rows = spark.readStream.schema(pages.schema).parquet(f"{d}/pages.parquet*").withColumn("seen_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    with feeds.rocksdb(spark):
        return _finished(spark, feeds.page_visits(rows, known, 90 * 86_400_000, emit_unchanged=True), "append").drop("seen_at")


@query("st_lookback_feed", "SELECT user_id, count(*) AS n, max(event_id) AS newest FROM ev WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1")
def st_lookback_feed(spark, d):
    """Rows of the day before a fixed clock, merged by foreachBatch into a keyed table of 16 buckets, of which a batch rewrites those it touches."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/") + f"/feed-{uuid.uuid4().hex}"
    end = F.lit("2024-01-30 00:00:00").cast("timestamp")
    rows = _stream(spark, d).withWatermark("ts", "1 day").where((F.col("ts") >= end - F.expr("interval 24 hours")) & (F.col("ts") <= end)).select("event_id", "user_id")
    readers.create_bucketed(spark.createDataFrame([], rows.schema), f"{folder}/rows", ["event_id"], 16)
    merge = lambda old, new: old.unionByName(new).dropDuplicates(["event_id"])
    run = rows.writeStream.foreachBatch(feeds.merging(f"{folder}/rows", rows.schema, ["event_id"], 16, merge)).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return readers.bucketed(spark, f"{folder}/rows", rows.schema).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("st_late_rows", "SELECT event_id, FALSE AS late FROM ev")
def st_late_rows(spark, d):
    """All events; late are those that came behind the watermark of the files before theirs, a file a batch in the order they were written.

    The SQL holds for a table of one file: no event comes behind a watermark that its own batch sets. Tests hold several files to their order.
    """
    kept = _finished(spark, feeds.deduplicated(_stream(spark, d, maxFilesPerTrigger=1), ["event_id"], "ts").select("event_id"), "append")
    return feeds.backfilled(kept, domain.table(spark, d, "events").select("event_id"), "event_id")
