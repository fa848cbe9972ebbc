"""Review actions, approvals, audit chain and cost, and the workspace views over them."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of field names whose values are masked.
SENSITIVE = ("account", "amount", "beneficial_owner", "counterparty", "date_of_birth", "email", "iban", "passport", "payment", "phone", "purpose", "swift", "tax_id", "transaction_id")


def append_actions(existing: DataFrame, new: DataFrame, allowed: list[str]) -> DataFrame:
    """Valid new actions whose id isn't stored yet, notes cut to 2000: insert-ignore by an anti join."""
    valid = new.where(F.col("action").isin(allowed) & F.col("id").isNotNull() & F.col("alert_id").isNotNull()).dropDuplicates(["id"])
    return valid.join(existing.select("id"), "id", "left_anti").withColumn("note", F.substring("note", 1, 2000))


def maker_checker(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with their outcome: only the first on a pending request counts, by another than its maker, with a known value."""
    first = Window.partitionBy("request_id").orderBy("decided_at", "decision_id")
    d = decisions.withColumn("nth", F.row_number().over(first)).join(requests, "request_id", "left")
    reason = (
        F.when(F.col("maker").isNull(), "unknown_request")
        .when((F.col("status") != "pending") | (F.col("nth") > 1), "already_decided")
        .when(F.col("maker") == F.col("checker"), "maker_is_checker")
        .when(~F.col("decision").isin("approved", "rejected"), "bad_decision")
    )
    return d.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def body_of(fields: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


#: What stands before the first event of a keyed chain.
GENESIS = "0" * 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed hash of a text, in hexadecimal: two nested digests over the key padded to a block of 64 bytes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    padded = lambda byte: F.lit(bytes(b ^ byte for b in block))
    inner = F.unhex(F.sha2(F.concat(padded(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(padded(0x5C), inner), 256)


def chained(events: DataFrame, chain: list[str], order: list[str], fields: list[str], key: bytes | None = None) -> DataFrame:
    """Audit rows: previous_hash and event_hash, the SHA-256 of previous_hash and the event's own fields; with a key its HMAC.

    The first previous_hash of a chain is null, with a key GENESIS.

    Each hash needs the one before it, so a chain is read in order by one task, which holds one hash and one batch, not the chain.
    """
    rows = events.select("*", body_of(fields).alias("_body"), F.concat_ws("|", *chain).alias("_chain")).repartition(*chain).sortWithinPartitions(*chain, *order)
    kind = T.StructType(rows.schema.fields + [T.StructField(n, T.StringType()) for n in ("previous_hash", "event_hash")])

    first = None if key is None else GENESIS
    digest = hashlib.sha256 if key is None else lambda message: hmac.new(key, message, hashlib.sha256)

    def run(batches):
        of, last = None, first
        for df in batches:
            before, own = [], []
            for name, body in zip(df["_chain"], df["_body"], strict=True):
                last = last if name == of else first
                of = name
                before.append(last)
                last = digest(f"{last or ''}|{body}".encode()).hexdigest()
                own.append(last)
            yield df.assign(previous_hash=before, event_hash=own)

    return rows.mapInPandas(run, kind).drop("_body", "_chain")


def verify_chain(rows: DataFrame, chain: list[str], order: list[str], fields: list[str], key: bytes | None = None) -> DataFrame:
    """Per chain: rows checked, whether all hashes hold, and the first row where one doesn't: changed, moved, or with a row lost before it. Whoever lacks the key can't make a row that holds."""
    w = Window.partitionBy(*chain).orderBy(*order)
    message = F.concat(F.coalesce("previous_hash", F.lit("")), F.lit("|"), body_of(fields))
    expected = F.sha2(message, 256) if key is None else hmac_sha256(key, message)
    before = F.lag("event_hash").over(w) if key is None else F.lag("event_hash", 1, GENESIS).over(w)
    bad = ~expected.eqNullSafe(F.col("event_hash")) | ~F.col("previous_hash").eqNullSafe(before)
    return rows.withColumn("bad", bad).groupBy(*chain).agg(F.count("*").alias("checked"), (~F.bool_or("bad")).alias("valid"), F.min(F.when(F.col("bad"), F.struct(*order))).getField(order[-1]).alias("first_break"))


def cost_summary(costs: DataFrame) -> DataFrame:
    """Count, tokens, cost and duration per stage and in all, by one rollup."""
    return costs.rollup("stage").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("duration").alias("duration"))


def latest_status(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Status by the latest action on the alert's own or its notification key (two equi joins, not an OR join), else the alert's own."""
    status = F.when(F.col("action") == "view", "in_review").when(F.col("action") == "purchase", "accepted").when(F.col("action") == "error", "dismissed").otherwise("open")
    latest = actions.groupBy("key").agg(F.max_by("action", F.struct("created_at", "id")).alias("action"), F.max(F.struct("created_at", "id")).alias("at"))
    by = lambda c: alerts.select("alert_id", F.col(c).alias("key")).join(latest, "key").select("alert_id", "at", "action")
    one = by("alert_key").unionByName(by("notification_key")).groupBy("alert_id").agg(F.max_by("action", "at").alias("action"))
    return alerts.join(one, "alert_id", "left").withColumn("current_status", F.when(F.col("action").isNull(), F.col("status")).otherwise(status)).drop("action")


def mask(column: Column, kind: T.DataType) -> Column:
    """A text of more than four characters keeps its last four; null stays; a shorter one and a value of any other type are redacted whole."""
    if not isinstance(kind, T.StringType):
        return F.when(column.isNotNull(), "[REDACTED]")
    return F.when(column.isNull(), None).when(F.length(column) > 4, F.concat(F.lit("***"), F.right(column, F.lit(4)))).otherwise("[REDACTED]")


def mask_sensitive(df: DataFrame, parts: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Mask every field, at any depth, whose name contains a sensitive part, whatever the case; numbers, lists and structs under such a name become one text."""

    def walk(c: Column, kind: T.DataType, name: str) -> Column:
        if any(p in name.lower() for p in parts):
            return mask(c, kind)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, ""))
        return c

    return df.select(*[walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def scope(rows: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Rows of the customers in a manager's portfolio(rm_id, customer_id)."""
    return rows.join(portfolio, "customer_id")


def search(alerts: DataFrame, text: str = "", category: str = "all", severity: str = "all", columns: tuple[str, ...] = ("object", "signal_type", "comparison_reason")) -> DataFrame:
    """Alerts that match all set filters; 'all' and the empty text switch one off."""
    out = alerts
    for column, value in (("category", category), ("severity", severity)):
        out = out if value == "all" else out.where(F.col(column) == value)
    return out.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))) if text else out


def timeline_windows(events: DataFrame, at: str, now: Column, spans: dict[str, int]) -> DataFrame:
    """events with a row for each span (name -> days) that holds them. A span ends at the later of now and the latest event, but at the latest event where that is older than the span."""
    latest = events.agg(F.max(at).alias("_latest"))  # one row
    days = lambda n: F.make_dt_interval(F.lit(n))
    end = lambda n: F.when(F.col("_latest") < now - days(n), F.col("_latest")).otherwise(F.greatest("_latest", now))
    held = [F.when((F.col(at) >= end(n) - days(n)) & (F.col(at) <= end(n)), name) for name, n in spans.items()]
    return events.join(latest, F.col(at) <= F.col("_latest")).withColumn("span", F.explode(F.array_compact(F.array(*held)))).drop("_latest")
