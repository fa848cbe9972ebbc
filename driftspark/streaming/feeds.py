"""Streaming forms of the monitoring operators. Event times are timestamps with a zone: cast timestamp_ntz before a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.functions.text import visible_text
from driftspark.sources import readers


def deduplicated(rows: DataFrame, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def tumbling_volume(rows: DataFrame, key: str, at: str, amount: str, width: str = "30 days", late: str = "7 days") -> DataFrame:
    """Number and sum of a key's rows per tumbling window."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(amount).alias("volume")).select(F.col("window.start").alias("start"), key, "n", "volume")


def spike_counts(rows: DataFrame, key: str, at: str, late: str = "2 hours") -> DataFrame:
    """Rows of a key in the 24 hours up to each hour; compare with a static baseline by ``with_policy``."""
    return rows.withWatermark(at, late).groupBy(F.window(at, "24 hours", "1 hour"), key).agg(F.count("*").alias("n")).select(F.col("window.end").alias("until"), key, "n")


def active_sessions(rows: DataFrame, key: str, at: str, gap: str = "3 days", late: str = "1 day") -> DataFrame:
    """Sessions of a key that a gap without rows ends."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def with_policy(rows: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """Stream-static join with the managers' policies; AQE and the size threshold decide on a broadcast."""
    return rows.join(policies, key)


def merging(path: str, schema: T.StructType, key: list[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a keyed table of hash buckets; replaying a batch changes nothing if ``merge`` is idempotent."""
    return lambda batch, _: readers.merge_bucketed(batch, path, schema, key, buckets, merge)


def value_changes(rows: DataFrame, key: list[str], at: str, value: str, schema: str, buckets: int = 1024) -> DataFrame:
    """Rows at which a key's value differs from its last one, which is kept as state; a key's first row is a change, null after null is none.

    schema: of the key's columns, the event time as ``at`` and the value, a string, as ``value``. State is one value per key. Keys are many and their
    rows few, so Python is called once for each of so many buckets of keys, whose rows it compares as columns, and not once for each key; a bucket's
    state is the keys in it with their values. The number of buckets can't change while a checkpoint is in use.
    """
    fields = T.StructType([f for f in T.StructType.fromDDL(schema).fields if f.name in key])

    def run(_: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        seen = pd.concat(list(parts), ignore_index=True).sort_values(["_key", "at", "value"], ignore_index=True)
        first, last = seen["_key"] != seen["_key"].shift(1), seen["_key"] != seen["_key"].shift(-1)
        before = seen["value"].shift(1).astype(object)
        before[first] = seen.loc[first, "_key"].map(held.get).astype(object)
        same = (seen["value"] == before) | (seen["value"].isna() & before.isna())
        changed = seen[~same | (first & ~seen["_key"].isin(list(held)))]
        held.update((k, None if pd.isna(v) else v) for k, v in zip(seen.loc[last, "_key"], seen.loc[last, "value"], strict=True))
        state.update((list(held), list(held.values())))
        yield changed[["_key", "at", "value"]]

    dealt = rows.select(F.to_json(F.struct(*key)).alias("_key"), F.col(at).alias("at"), F.col(value).alias("value"), F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_bucket"))
    found = dealt.groupBy("_bucket").applyInPandasWithState(run, "_key string, at timestamp, value string", "keys array<string>, lasts array<string>", "append", "NoTimeout")
    return found.select(F.from_json("_key", fields).alias("k"), "at", "value").select("k.*", "at", "value")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What a visit to a page gives: its hash, the one before it and whether it is new to the state.
VISIT = "url string, sha256 string, seen_at timestamp, previous string, first_seen boolean, changed boolean"


def page_visits(pages: DataFrame, known: DataFrame, keep_ms: int, late: str = "1 day", emit_unchanged: bool = False) -> DataFrame:
    """Visits to pages(url, html, seen_at) as VISIT rows, against the hash of the page's last visit, which is kept as state for each url.

    The state begins as known(url, sha256, seen_at), the state that an earlier run left; a page without any is first_seen and changed. A page not
    visited for more than ``keep_ms`` milliseconds is first seen when it comes back; a timer drops its state once the watermark is past that. Only
    changed visits are given, with ``emit_unchanged`` all: ``last_visits`` of those is the new state. Visits of a page in one batch are taken by
    time, then hash; a visit before the last one of an earlier batch is compared with that one and becomes the last. Rows with a null url, page or
    time are dropped. Hashes are made before Python sees a row. Needs the RocksDB state store, which keeps state out of the JVM's heap.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Pages(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "sha256 string, ms long")

        def keep(self, sha256, ms):
            if self.last.exists():
                self.handle.deleteTimer(self.last.get()[1] + keep_ms)
            self.last.update((sha256, ms))
            self.handle.registerTimer(ms + keep_ms)

        def handleInitialState(self, key, initialState, timerValues):
            self.keep(initialState["sha256"].iloc[0], int(initialState["ms"].iloc[0]))

        def handleInputRows(self, key, rows, timerValues):
            seen = pd.concat(list(rows)).sort_values(["ms", "sha256"])
            last, at = self.last.get() if self.last.exists() else (None, 0)
            hashes, times = list(seen["sha256"]), [int(x) for x in seen["ms"]]
            before = [p if now - then <= keep_ms else None for p, then, now in zip([last, *hashes], [at, *times], times)]
            out = pd.DataFrame({"url": key[0], "sha256": hashes, "seen_at": seen["seen_at"].to_numpy(), "previous": pd.Series(before, dtype=object)})
            out["first_seen"] = out["previous"].isna()
            out["changed"] = out["first_seen"] | (out["previous"] != out["sha256"])
            self.keep(hashes[-1], times[-1])
            yield out if emit_unchanged else out[out["changed"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.last.clear()
            yield from ()

        def close(self):
            pass

    ms = F.unix_millis("seen_at").alias("ms")
    hashed = pages.withWatermark("seen_at", late).select("url", F.sha2(visible_text(F.col("html")), 256).alias("sha256"), "seen_at", ms).dropna()
    begin = known.select("url", "sha256", ms).dropna().groupBy("url").agg(F.max_by("sha256", F.struct("ms", "sha256")).alias("sha256"), F.max("ms").alias("ms"))  # one row a url
    return hashed.groupBy("url").transformWithStateInPandas(statefulProcessor=Pages(), outputStructType=VISIT, outputMode="Append", timeMode="EventTime", initialState=begin.groupBy("url"))


def last_visits(visits: DataFrame, known: DataFrame) -> DataFrame:
    """The new state (url, sha256, seen_at): the last visit of each page, and what was known of those not visited."""
    last = visits.groupBy("url").agg(F.max_by("sha256", F.struct("seen_at", "sha256")).alias("sha256"), F.max("seen_at").alias("seen_at"))
    return last.unionByName(known.join(last, "url", "left_anti").select("url", "sha256", "seen_at"))


def backfilled(stream_rows: DataFrame, batch_rows: DataFrame, key: str) -> DataFrame:
    """The rows that a stream kept, and from a batch read those it missed because they came behind its watermark."""
    late = batch_rows.join(stream_rows.select(key), key, "left_anti")
    return stream_rows.select(*batch_rows.columns).withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
