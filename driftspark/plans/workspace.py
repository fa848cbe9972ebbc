"""Queries of the workspace and of governance. Events stand in for actions, audit rows and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftspark.functions import rules
from driftspark.functions.text import lookup
from driftspark.operators import governance as gov
from driftspark.plans import evidence as ep
from driftspark.plans.evidence import ALERTS, CLASSIFIED, SCORED
from driftspark.plans.registry import query
from driftspark.sources import domain

_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def _rank():
    return lookup("severity", rules.SEVERITY_RANK, 0)


# ---------------------------------------------------------------- governance


@query("gov_actions_append", """, new AS (SELECT DISTINCT event_id AS id, event_type AS action, user_id AS alert_id, props AS note FROM ev WHERE event_type <> 'signup')
SELECT id, action, alert_id, substr(note, 1, 2000) AS note FROM new WHERE id % 3 <> 0""")
def gov_actions_append(spark, d):
    every = domain.events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("user_id").alias("alert_id"), F.col("props").alias("note"))
    return gov.append_actions(every.where("id % 3 = 0"), every, ["click", "view", "purchase", "error"])


@query("gov_actions_list", "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM ev")
def gov_actions_list(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return domain.events(spark, d).select("user_id", "event_id", "event_type", F.row_number().over(w).alias("nth"))


_REQ = """, req AS (SELECT event_id AS request_id, concat('u', user_id % 7) AS maker, CASE WHEN k % 10 = 0 THEN 'approved' ELSE 'pending' END AS status FROM ev WHERE event_type = 'purchase'),
dec AS (SELECT event_id AS decision_id, event_id - 1 AS request_id, concat('u', k % 7) AS checker, CASE WHEN k % 11 = 0 THEN 'maybe' WHEN k % 2 = 0 THEN 'approved' ELSE 'rejected' END AS decision, ts FROM ev WHERE event_type <> 'purchase')
"""


@query("gov_maker_checker", _REQ + """SELECT decision_id, maker IS NOT NULL AND status = 'pending' AND maker <> checker AND decision <> 'maybe' AS accepted,
CASE WHEN maker IS NULL THEN 'unknown_request' WHEN status <> 'pending' THEN 'already_decided' WHEN maker = checker THEN 'maker_is_checker' WHEN decision = 'maybe' THEN 'bad_decision' END AS reason FROM dec LEFT JOIN req USING (request_id)""")
def gov_maker_checker(spark, d):
    e, k = domain.events(spark, d), F.col("k")
    requests = e.where("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("maker"), F.when(k % 10 == 0, "approved").otherwise("pending").alias("status"))
    value = F.when(k % 11 == 0, "maybe").when(k % 2 == 0, "approved").otherwise("rejected")
    decisions = e.where("event_type <> 'purchase'").select(F.col("event_id").alias("decision_id"), (F.col("event_id") - 1).alias("request_id"), F.concat(F.lit("u"), k % 7).alias("checker"), value.alias("decision"), F.col("ts").alias("decided_at"))
    return gov.maker_checker(requests, decisions).select("decision_id", "accepted", "reason")


@query("gov_approval_queue", _REQ + "SELECT maker, count(*) AS requests, count(*) FILTER (status = 'pending') AS pending, max(request_id) AS newest FROM req GROUP BY 1")
def gov_approval_queue(spark, d):
    e = domain.events(spark, d).where("event_type = 'purchase'")
    status = F.when(F.col("k") % 10 == 0, "approved").otherwise("pending")
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id") % 7).alias("maker")).agg(F.count("*").alias("requests"), F.count_if(status == "pending").alias("pending"), F.max("event_id").alias("newest"))


_BODY = ["event_id", "created_at", "actor", "action", "entity_type", "entity_id", "payload"]
_KEY = b"a key of the tests alone"


@query("gov_audit_verify", "SELECT user_id, count(*) AS checked, NOT bool_or(k = 17) AS valid, arg_min(event_id, (ts, event_id)) FILTER (k = 17) AS first_break FROM ev GROUP BY 1")
def gov_audit_verify(spark, d):
    """A user's events as a keyed chain, in which some payloads were changed and their hashes made anew, but without the key."""
    e = domain.events(spark, d)
    told = e.select("user_id", "ts", "event_id", "k", F.col("ts").cast("string").alias("created_at"), F.concat(F.lit("u"), "user_id").alias("actor"), F.col("event_type").alias("action"), F.lit("event").alias("entity_type"), F.col("value").cast("string").alias("entity_id"), F.col("props").alias("payload"))
    rows = gov.chained(told, ["user_id"], ["ts", "event_id"], _BODY, _KEY)
    forged = F.col("k") == 17
    changed = rows.withColumn("payload", F.when(forged, "changed").otherwise(F.col("payload")))
    unkeyed = F.sha2(F.concat(F.col("previous_hash"), F.lit("|"), gov.body_of(_BODY)), 256)
    changed = changed.withColumn("event_hash", F.when(forged, unkeyed).otherwise(F.col("event_hash")))
    return gov.verify_chain(changed, ["user_id"], ["ts", "event_id"], _BODY, _KEY)


@query("gov_audit_list", "SELECT event_id, user_id, event_type FROM ev ORDER BY ts DESC, event_id DESC LIMIT 200")
def gov_audit_list(spark, d):
    return domain.events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type")


def _costs(spark, d):
    return domain.events(spark, d).select(F.col("event_type").alias("stage"), F.col("k").alias("tokens"), F.col("value").cast("decimal(18,2)").alias("duration")).withColumn("cost", (F.col("tokens") * 2).cast("decimal(18,4)"))


@query("gov_cost_summary", """SELECT stage, n, tokens, cost, duration FROM (SELECT event_type AS stage, count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens, round(CAST(sum(k * 2) AS DOUBLE) / 1000000, 8) AS cost, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS duration FROM ev GROUP BY ROLLUP (event_type))""")
def gov_cost_summary(spark, d):
    return gov.cost_summary(_costs(spark, d)).withColumns({"cost": F.round(F.col("cost").cast("double") / 1_000_000, 8), "duration": F.col("duration").cast("double")})


@query("cost_per_1000", "SELECT event_type AS stage, round(CAST(sum(k * 2) AS DOUBLE) / 1000000 / (SELECT count(*) FROM customer) * 1000, 8) AS cost FROM ev GROUP BY 1")
def cost_per_1000(spark, d):
    every = domain.table(spark, d, "customer").agg(F.count("*").alias("customers"))
    per = _costs(spark, d).groupBy("stage").agg(F.sum("cost").cast("double").alias("cost"))
    return per.crossJoin(F.broadcast(every)).select("stage", F.round(F.col("cost") / 1_000_000 / F.col("customers") * 1000, 8).alias("cost"))


@query("model_usage", "SELECT user_id, CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(sum(k % 13) AS BIGINT) AS completion_tokens, round(CAST(sum(k) * 0.5 + sum(k % 13) * 1.5 AS DOUBLE) / 1000000, 10) AS cost FROM ev GROUP BY 1")
def model_usage(spark, d):
    sums = domain.events(spark, d).groupBy("user_id").agg(F.sum("k").alias("prompt_tokens"), F.sum(F.col("k") % 13).alias("completion_tokens"))
    return sums.withColumn("cost", F.round((F.col("prompt_tokens") * F.lit(0.5) + F.col("completion_tokens") * F.lit(1.5)) / 1_000_000, 10))


# ---------------------------------------------------------------- workspace


@query("ws_filter_alerts", ALERTS + "SELECT alert_id, severity FROM alerts WHERE category = 'risk' AND contains(lower(concat_ws(' ', object, signal_type, comparison_reason)), 'conduct')")
def ws_filter_alerts(spark, d):
    return gov.search(ep.alerts(spark, d), "conduct", category="risk").select("alert_id", "severity")


@query("ws_notification_key", ALERTS + """SELECT alert_id, concat_ws('|', customer_id, signal_type, object_key, (SELECT min(u.source_url) FROM (SELECT unnest(evidence) AS u))) AS notification_key FROM alerts""")
def ws_notification_key(spark, d):
    url = F.array_min(F.transform("evidence", lambda e: e["source_url"]))
    return ep.alerts(spark, d).select("alert_id", F.concat_ws("|", "customer_id", "signal_type", "object_key", url).alias("notification_key"))


_STATUS = ALERTS + """, al AS (SELECT alert_id, customer_id, concat('a', customer_id % 40) AS k1, concat('n', customer_id % 150) AS k2 FROM alerts),
act AS (SELECT CASE WHEN event_id % 2 = 0 THEN concat('a', user_id) ELSE concat('n', user_id) END AS key, event_type, ts, event_id FROM ev WHERE event_type <> 'click'),
la AS (SELECT alert_id, arg_max(event_type, (ts, event_id)) AS action FROM (SELECT alert_id, act.* FROM al JOIN act ON k1 = key UNION ALL SELECT alert_id, act.* FROM al JOIN act ON k2 = key) GROUP BY 1),
st AS (SELECT al.alert_id, customer_id, CASE action WHEN 'view' THEN 'in_review' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'dismissed' WHEN 'signup' THEN 'open' ELSE 'new' END AS current_status FROM al LEFT JOIN la USING (alert_id))
"""


def _status(spark, d):
    a = ep.alerts(spark, d).select("alert_id", "customer_id", F.concat(F.lit("a"), F.col("customer_id") % 40).alias("alert_key"), F.concat(F.lit("n"), F.col("customer_id") % 150).alias("notification_key"), F.lit("new").alias("status"))
    e = domain.events(spark, d).where("event_type <> 'click'")
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a"), "user_id")).otherwise(F.concat(F.lit("n"), "user_id"))
    actions = e.select(key.alias("key"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return gov.latest_status(a, actions)


@query("ws_current_status", _STATUS + "SELECT alert_id, current_status FROM st")
def ws_current_status(spark, d):
    return _status(spark, d).select("alert_id", "current_status")


@query("ws_visible_notifications", _STATUS + "SELECT alert_id FROM st WHERE current_status NOT IN ('in_review', 'dismissed')")
def ws_visible_notifications(spark, d):
    return _status(spark, d).where(~F.col("current_status").isin("in_review", "dismissed")).select("alert_id")


@query("ws_customer_aggregate", _STATUS + f"SELECT customer_id, count(*) AS alerts, count(*) FILTER (category = 'risk') AS risk, count(*) FILTER (category = 'opportunity') AS opportunity, count(*) FILTER (category = 'ownership_control') AS ownership, CAST(max({_RANK}) AS INT) AS highest FROM alerts JOIN (SELECT alert_id, current_status FROM st) USING (alert_id) WHERE current_status <> 'dismissed' GROUP BY 1")
def ws_customer_aggregate(spark, d):
    n = lambda c: F.count_if(F.col("category") == c)
    left = ep.alerts(spark, d).join(_status(spark, d).where("current_status <> 'dismissed'").select("alert_id"), "alert_id", "left_semi")
    return left.groupBy("customer_id").agg(F.count("*").alias("alerts"), n("risk").alias("risk"), n("opportunity").alias("opportunity"), n("ownership_control").alias("ownership"), F.max(_rank()).alias("highest"))


@query("ws_customer_list", ALERTS + f""", m AS (SELECT customer_id, count(*) AS alerts, CAST(max({_RANK}) AS INT) AS highest FROM alerts GROUP BY 1)
SELECT c.customer_id, legal_name, coalesce(alerts, 0) AS alerts, coalesce(highest, 0) AS highest FROM customers c LEFT JOIN m USING (customer_id) WHERE contains(lower(legal_name || ' ' || segment), 'building') OR customer_id IN (SELECT customer_id FROM alerts WHERE contains(lower(object), 'notice'))""")
def ws_customer_list(spark, d):
    a, c = ep.alerts(spark, d), domain.customers(spark, d)
    own = c.where(F.contains(F.lower(F.concat_ws(" ", "legal_name", "segment")), F.lit("building"))).select("customer_id")
    matched = own.unionByName(gov.search(a, "notice", columns=("object",)).select("customer_id")).distinct()
    per = a.groupBy("customer_id").agg(F.count("*").alias("alerts"), F.max(_rank()).alias("highest"))
    return c.join(matched, "customer_id", "left_semi").join(per, "customer_id", "left").select("customer_id", "legal_name", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("highest", F.lit(0)).alias("highest"))


@query("ws_sorted_alerts", SCORED + f"SELECT customer_id, alert_id, row_number() OVER (PARTITION BY customer_id ORDER BY {_RANK} DESC, material_score DESC, confidence DESC, signal_type, alert_id) AS nth FROM scored")
def ws_sorted_alerts(spark, d):
    w = Window.partitionBy("customer_id").orderBy(F.desc(_rank()), F.desc("material_score"), F.desc("confidence"), "signal_type", "alert_id")
    return ep.scored(spark, d).select("customer_id", "alert_id", F.row_number().over(w).alias("nth"))


@query("ws_call_brief", SCORED + f""", b AS (SELECT *, row_number() OVER (PARTITION BY customer_id, category ORDER BY material_score DESC, alert_id) AS nth FROM scored)
SELECT customer_id, coalesce(string_agg(signal_type, '|' ORDER BY material_score DESC, alert_id) FILTER (category = 'risk'), '') AS risks, coalesce(string_agg(signal_type, '|' ORDER BY material_score DESC, alert_id) FILTER (category = 'opportunity'), '') AS opportunities FROM b WHERE nth <= 5 GROUP BY 1""")
def ws_call_brief(spark, d):
    w = Window.partitionBy("customer_id", "category").orderBy(F.desc("material_score"), "alert_id")
    top = ep.scored(spark, d).withColumn("nth", F.row_number().over(w)).where("nth <= 5")
    entry = F.struct((-F.col("material_score")).alias("o"), "alert_id", "signal_type")
    pick = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, entry))), lambda x: x["signal_type"]), "|")
    return top.groupBy("customer_id").agg(pick("risk").alias("risks"), pick("opportunity").alias("opportunities"))


@query("ws_unique_evidence", SCORED + "SELECT customer_id, document_id, max(source_url) AS source_url FROM ex JOIN alerts USING (alert_id) GROUP BY 1, 2")
def ws_unique_evidence(spark, d):
    return ep.alerts(spark, d).select("customer_id", F.explode("evidence").alias("e")).groupBy("customer_id", "e.document_id").agg(F.max("e.source_url").alias("source_url"))


@query("ws_timeline", SCORED + "SELECT customer_id, newest AS at, 'alert' AS kind, signal_type AS title FROM scored UNION ALL SELECT user_id, ts, 'action', event_type FROM ev")
def ws_timeline(spark, d):
    a = ep.scored(spark, d).select("customer_id", F.col("newest").cast("timestamp_ntz").alias("at"), F.lit("alert").alias("kind"), F.col("signal_type").alias("title"))
    e = domain.events(spark, d).select(F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp_ntz").alias("at"), F.lit("action").alias("kind"), F.col("event_type").alias("title"))
    return a.unionByName(e)


_RANGES = {"1d": 1, "1w": 7, "1m": 30, "3m": 90, "1y": 365}


@query("ws_timeline_window", ", latest AS (SELECT max(ts) AS newest FROM ev), spans AS (SELECT span, days, CASE WHEN newest < TIMESTAMP '2024-02-01' - to_days(days) THEN newest ELSE greatest(newest, TIMESTAMP '2024-02-01') END AS until FROM latest, (VALUES ('1d', 1), ('1w', 7), ('1m', 30), ('3m', 90), ('1y', 365)) AS v(span, days)) SELECT span, user_id, event_id FROM ev JOIN spans ON ts BETWEEN until - to_days(days) AND until")
def ws_timeline_window(spark, d):
    e = domain.events(spark, d)
    return gov.timeline_windows(e, "ts", F.lit("2024-02-01").cast(e.schema["ts"].dataType), _RANGES).select("span", "user_id", "event_id")


@query("ws_footprint", CLASSIFIED + """, p AS (SELECT customer_id, domicile AS place, 1 AS r, 'domicile' AS kind FROM customers UNION ALL SELECT customer_id, region, 2, 'known' FROM customers
UNION ALL SELECT customer_id, trim(unnest(string_split(jurisdiction, ';'))), 3, 'risk' FROM facts JOIN customers USING (customer_id) WHERE jurisdiction IS NOT NULL)
SELECT customer_id, place, arg_max(kind, r) AS kind FROM p GROUP BY 1, 2""")
def ws_footprint(spark, d):
    c = domain.customers(spark, d)
    rows = c.select("customer_id", F.col("domicile").alias("place"), F.lit(1).alias("r"), F.lit("domicile").alias("kind")).unionByName(c.select("customer_id", F.col("region").alias("place"), F.lit(2).alias("r"), F.lit("known").alias("kind")))
    risky = ep.facts(spark, d).where("jurisdiction is not null").join(c.select("customer_id"), "customer_id", "left_semi")
    risky = risky.select("customer_id", F.explode(F.split("jurisdiction", ";\\s*")).alias("place"), F.lit(3).alias("r"), F.lit("risk").alias("kind"))
    return rows.unionByName(risky).groupBy("customer_id", "place").agg(F.max_by("kind", "r").alias("kind"))


@query("ws_data_health", SCORED + "SELECT max(collected_at) AS newest, count(DISTINCT alert_id) AS alerts FROM ex")
def ws_data_health(spark, d):
    return ep.alerts(spark, d).agg(F.max(F.array_max(F.transform("evidence", lambda e: e["collected_at"]))).alias("newest"), F.count_distinct("alert_id").alias("alerts"))


@query("ws_portfolio_scope", ALERTS + "SELECT n_name AS rm_id, alert_id FROM alerts JOIN customer ON c_custkey = customer_id JOIN nation ON c_nationkey = n_nationkey")
def ws_portfolio_scope(spark, d):
    rows = domain.table(spark, d, "customer").join(domain.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("rm_id"), F.col("c_custkey").alias("customer_id"))
    return gov.scope(ep.alerts(spark, d), rows).select("rm_id", "alert_id")


@query("ws_mask_sensitive", """, t AS (SELECT concat(l_orderkey, '-', l_linenumber) AS id, o_custkey AS customer_id, s_name, l_extendedprice AS price, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT customer_id, CASE WHEN length(id) > 4 THEN '***' || right(id, 4) ELSE '[REDACTED]' END AS transaction_id, '[REDACTED]' AS amount, CASE WHEN length(s_name) > 4 THEN '***' || right(s_name, 4) ELSE '[REDACTED]' END AS counterparty, '[REDACTED]' AS payments, CASE WHEN length(p_type) > 4 THEN '***' || right(p_type, 4) ELSE '[REDACTED]' END AS purpose_code, s_name AS party FROM t""")
def ws_mask_sensitive(spark, d):
    t = domain.transactions(spark, d)
    details = F.struct(F.col("purpose").alias("Purpose_Code"), F.col("counterparty").alias("party"))
    rows = t.select("customer_id", "transaction_id", "amount", "counterparty", F.array(F.struct("amount", "rail")).alias("payments"), F.array(details).alias("details"))
    masked = gov.mask_sensitive(rows)
    return masked.select("customer_id", "transaction_id", "amount", "counterparty", "payments", F.get("details", 0)["Purpose_Code"].alias("purpose_code"), F.get("details", 0)["party"].alias("party"))


@query("ws_recent_jobs", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM ev) WHERE nth <= 30")
def ws_recent_jobs(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return domain.events(spark, d).withColumn("nth", F.row_number().over(w)).where("nth <= 30").select("user_id", "event_id")


@query("ws_alert_overlay", CLASSIFIED + "SELECT a.alert_id, CASE WHEN material THEN 'material' ELSE 'suppressed' END AS status, coalesce(material_score, 0) AS material_score FROM alerts a LEFT JOIN classified c USING (alert_id)")
def ws_alert_overlay(spark, d):
    over = ep.classified(spark, d).select("alert_id", F.when(F.col("material"), "material").otherwise("suppressed").alias("status"), "material_score")
    return ep.alerts(spark, d).select("alert_id").join(over, "alert_id", "left").select("alert_id", F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("material_score", F.lit(0)).alias("material_score"))


@query("ws_questions", ALERTS + "SELECT DISTINCT customer_id, CASE category WHEN 'risk' THEN 'Has compliance reviewed it?' WHEN 'ownership_control' THEN 'Who controls the company?' WHEN 'opportunity' THEN 'Is the product of interest?' ELSE 'What has changed?' END AS question FROM alerts")
def ws_questions(spark, d):
    asks = {"risk": "Has compliance reviewed it?", "ownership_control": "Who controls the company?", "opportunity": "Is the product of interest?"}
    return ep.alerts(spark, d).select("customer_id", lookup("category", asks, "What has changed?").alias("question")).distinct()
