"""Queries over ownership records, public profiles and model answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftspark.functions import rules
from driftspark.functions.text import lookup
from driftspark.operators import profiles as pf
from driftspark.plans import evidence as ep
from driftspark.plans.evidence import CLASSIFIED, SCORED
from driftspark.plans.registry import query
from driftspark.sources import domain

RECORDS = """, base AS (SELECT customer_id, domicile || ' Trust' AS holder, 'owner' AS role, 'high' AS impact, 50.0::DOUBLE AS percent, 0.9::DOUBLE AS confidence FROM customers WHERE customer_id % 3 = 0),
docs AS (SELECT DISTINCT e.customer_id, source_name AS holder, CASE WHEN contains(lower(raw_text), 'license') THEN 'lender' ELSE 'investor' END AS role, CASE source_quality WHEN 'A' THEN 'high' WHEN 'B' THEN 'medium' ELSE 'low' END AS impact, NULL::DOUBLE AS percent, 0.6::DOUBLE AS confidence FROM evidence e JOIN customers c USING (customer_id)),
rec AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY o, holder, role) AS number FROM (SELECT *, 0 AS o FROM base UNION ALL SELECT *, 1 FROM docs))
"""


def _records(spark, d):
    c = domain.customers(spark, d)
    base = c.where("customer_id % 3 = 0").select("customer_id", F.concat("domicile", F.lit(" Trust")).alias("holder"), F.lit("owner").alias("role"), F.lit("high").alias("impact"), F.lit(50.0).alias("percent"), F.lit(0.9).alias("confidence"))
    e = domain.evidence(spark, d).join(c.select("customer_id"), "customer_id", "left_semi")
    role = F.when(F.contains(F.lower("raw_text"), F.lit("license")), "lender").otherwise("investor")
    found = e.select("customer_id", F.col("source_name").alias("holder"), role.alias("role"), lookup("source_quality", {"A": "high", "B": "medium"}, "low").alias("impact"), F.lit(None).cast("double").alias("percent"), F.lit(0.6).alias("confidence")).distinct()
    return pf.ownership_records(base, found)


@query("own_baseline", RECORDS + "SELECT customer_id, holder, role, impact FROM rec WHERE o = 0")
def own_baseline(spark, d):
    return _records(spark, d).where("origin = 0").select("customer_id", "holder", "role", "impact")


@query("own_documents", RECORDS + "SELECT customer_id, holder, role, impact FROM rec WHERE o = 1")
def own_documents(spark, d):
    return _records(spark, d).where("origin = 1").select("customer_id", "holder", "role", "impact")


@query("own_records", RECORDS + "SELECT customer_id, number, holder, role, impact, percent, confidence FROM rec")
def own_records(spark, d):
    return _records(spark, d).select("customer_id", "number", "holder", "role", "impact", "percent", "confidence")


@query("own_summary", RECORDS + "SELECT customer_id, count(*) AS records, count(*) FILTER (role = 'owner') AS controlling, count(*) FILTER (percent IS NULL) AS unknown_stake, count(*) FILTER (impact = 'high') AS high_impact FROM rec GROUP BY 1")
def own_summary(spark, d):
    return pf.ownership_summary(_records(spark, d))


@query("own_questions", RECORDS + """SELECT customer_id, CASE WHEN len(q) = 0 THEN 'Any change in holders?' ELSE array_to_string(q, '|') END AS questions FROM (SELECT customer_id,
list_filter([CASE WHEN bool_or(percent IS NULL) THEN 'What is the stake?' END, CASE WHEN bool_or(impact = 'high') THEN 'Who has control?' END, CASE WHEN bool_or(role = 'lender') THEN 'What are the terms?' END], lambda x: x IS NOT NULL) AS q FROM rec GROUP BY 1)""")
def own_questions(spark, d):
    return pf.questions(_records(spark, d)).withColumn("questions", F.array_join("questions", "|"))


@query("own_rollup", RECORDS + "SELECT c.customer_id, CAST(count(rec.customer_id) AS BIGINT) AS records, coalesce(string_agg(holder, '|' ORDER BY number), '') AS holders FROM customers c LEFT JOIN rec USING (customer_id) GROUP BY 1")
def own_rollup(spark, d):
    out = pf.rollup(domain.customers(spark, d).select("customer_id"), _records(spark, d))
    return out.select("customer_id", "records", F.coalesce(F.array_join(F.transform("holders", lambda h: h["holder"]), "|"), F.lit("")).alias("holders"))


@query("own_sort", RECORDS + "SELECT customer_id, holder, role, row_number() OVER (PARTITION BY customer_id ORDER BY CASE role WHEN 'owner' THEN 0 WHEN 'investor' THEN 1 ELSE 2 END, CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, percent IS NULL, confidence DESC, holder) AS nth FROM rec")
def own_sort(spark, d):
    rank = [lookup("role", {"owner": 0, "investor": 1}, 2), lookup("impact", {"high": 0, "medium": 1}, 2), F.col("percent").isNull(), F.desc("confidence"), F.asc("holder")]
    return _records(spark, d).select("customer_id", "holder", "role", F.row_number().over(Window.partitionBy("customer_id").orderBy(*rank)).alias("nth"))


@query("prof_alerts", SCORED + """, r AS (SELECT customer_id, alert_id, row_number() OVER (PARTITION BY customer_id ORDER BY material_score DESC, confidence DESC, alert_id) AS nth FROM scored)
SELECT customer_id, n AS alerts, string_agg(alert_id, ';' ORDER BY nth) AS top FROM r JOIN (SELECT customer_id, count(*) AS n FROM scored GROUP BY 1) USING (customer_id) WHERE nth <= 5 GROUP BY 1, 2""")
def prof_alerts(spark, d):
    w = Window.partitionBy("customer_id").orderBy(F.desc("material_score"), F.desc("confidence"), "alert_id")
    s = ep.scored(spark, d).select("customer_id", "alert_id", F.row_number().over(w).alias("nth"), F.count("*").over(Window.partitionBy("customer_id")).alias("alerts"))
    top = s.where("nth <= 5").groupBy("customer_id", "alerts").agg(F.array_sort(F.collect_list(F.struct("nth", "alert_id"))).alias("t"))
    return top.select("customer_id", "alerts", F.array_join(F.transform("t", lambda x: x["alert_id"]), ";").alias("top"))


@query("prof_investors", RECORDS + """, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY role = 'owner' DESC, percent IS NOT NULL DESC, confidence DESC, holder, role) AS nth FROM rec)
SELECT c.customer_id, coalesce(string_agg(holder, '|' ORDER BY nth), '') AS investors FROM customers c LEFT JOIN (SELECT * FROM r WHERE nth <= 4) t USING (customer_id) GROUP BY 1""")
def prof_investors(spark, d):
    w = Window.partitionBy("customer_id").orderBy(F.desc(F.col("role") == "owner"), F.desc(F.col("percent").isNotNull()), F.desc("confidence"), "holder", "role")
    top = _records(spark, d).withColumn("nth", F.row_number().over(w)).where("nth <= 4").groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("nth", "holder"))).alias("t"))
    return domain.customers(spark, d).select("customer_id").join(top, "customer_id", "left").select("customer_id", F.coalesce(F.array_join(F.transform("t", lambda x: x["holder"]), "|"), F.lit("")).alias("investors"))


@query("prof_sources", "SELECT customer_id, count(*) AS sources, array_to_string(list_sort(list(DISTINCT source_type)), '|') AS types, min(source_quality) AS best FROM evidence GROUP BY 1")
def prof_sources(spark, d):
    return domain.evidence(spark, d).groupBy("customer_id").agg(F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_set("source_type")), "|").alias("types"), F.min("source_quality").alias("best"))


PROFILE = SCORED + RECORDS + """, prof AS (SELECT c.customer_id, legal_name, CASE WHEN customer_id % 6 = 0 THEN '' ELSE segment END AS segment, risk_rating, s.n AS sources, a.n AS alerts, h.n AS holders FROM customers c LEFT JOIN (SELECT customer_id, count(*) AS n FROM evidence GROUP BY 1) s USING (customer_id)
  LEFT JOIN (SELECT customer_id, count(*) AS n FROM scored GROUP BY 1) a USING (customer_id) LEFT JOIN (SELECT customer_id, count(*) AS n FROM rec GROUP BY 1) h USING (customer_id)),
pc AS (SELECT *, list_filter([CASE WHEN segment = '' THEN 'segment' END, CASE WHEN sources IS NULL THEN 'sources' END, CASE WHEN alerts IS NULL THEN 'alerts' END, CASE WHEN holders IS NULL THEN 'holders' END], lambda x: x IS NOT NULL) AS missing FROM prof)
"""


def _profile(spark, d):
    c = domain.customers(spark, d).select("customer_id", "legal_name", F.when(F.col("customer_id") % 6 == 0, "").otherwise(F.col("segment")).alias("segment"), "risk_rating")
    count = lambda df, name: df.groupBy("customer_id").agg(F.count("*").alias(name))
    out = c.join(count(domain.evidence(spark, d), "sources"), "customer_id", "left").join(count(ep.scored(spark, d), "alerts"), "customer_id", "left").join(count(_records(spark, d), "holders"), "customer_id", "left")
    return pf.completeness(out, ["legal_name", "segment", "risk_rating", "sources", "alerts", "holders"])


@query("prof_build", PROFILE + "SELECT customer_id, legal_name, segment, risk_rating, sources, alerts, holders FROM pc")
def prof_build(spark, d):
    return _profile(spark, d).select("customer_id", "legal_name", "segment", "risk_rating", "sources", "alerts", "holders")


@query("prof_completeness", PROFILE + "SELECT customer_id, round(1 - len(missing) / 6, 4) AS completeness, array_to_string(missing, '|') AS missing FROM pc")
def prof_completeness(spark, d):
    return _profile(spark, d).select("customer_id", "completeness", F.array_join("missing", "|").alias("missing"))


@query("prof_next_steps", PROFILE + "SELECT customer_id, array_to_string(list_filter([CASE WHEN risk_rating = 'high' THEN 'Enhanced review' END, CASE WHEN len(missing) > 0 THEN 'Complete profile' END, CASE WHEN alerts IS NOT NULL THEN 'Read alerts' END], lambda x: x IS NOT NULL), '|') AS steps FROM pc")
def prof_next_steps(spark, d):
    steps = F.array_compact(F.array(F.when(F.col("risk_rating") == "high", "Enhanced review"), F.when(F.size("missing") > 0, "Complete profile"), F.when(F.col("alerts").isNotNull(), "Read alerts")))
    return _profile(spark, d).select("customer_id", F.array_join(steps, "|").alias("steps"))


@query("prof_summary", PROFILE + "SELECT risk_rating, count(*) AS customers, round(avg(1 - len(missing) / 6), 4) AS completeness FROM pc GROUP BY 1")
def prof_summary(spark, d):
    return _profile(spark, d).groupBy("risk_rating").agg(F.count("*").alias("customers"), F.round(F.avg(1 - F.size("missing") / 6), 4).alias("completeness"))


@query("prof_identity", "SELECT customer_id, CASE WHEN customer_id % 5 = 0 THEN upper(legal_name) ELSE legal_name END AS name, CASE WHEN customer_id % 5 = 0 THEN legal_name ELSE legal_name || '|' || domicile END AS names FROM customers")
def prof_identity(spark, d):
    c = domain.customers(spark, d).withColumn("profile_name", F.when(F.col("customer_id") % 5 == 0, F.upper("legal_name")))
    names = F.when(F.col("customer_id") % 5 == 0, F.array("legal_name", F.lower("legal_name"))).otherwise(F.array("legal_name", "domicile", F.upper("legal_name")))
    kept = F.filter(names, lambda x, i: F.array_position(F.transform(names, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return c.select("customer_id", F.coalesce("profile_name", "legal_name").alias("name"), F.array_join(kept, "|").alias("names"))


@query("gap_report", CLASSIFIED + "SELECT signal_type, severity, material, count(*) AS alerts FROM classified GROUP BY 1, 2, 3")
def gap_report(spark, d):
    return ep.classified(spark, d).groupBy("signal_type", "severity", "material").agg(F.count("*").alias("alerts"))
