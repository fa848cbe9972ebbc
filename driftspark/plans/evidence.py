"""Queries over evidence: documents -> facts -> comparison -> alerts -> material feed -> managers' policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark.functions import rules
from driftspark.operators import evidence as ev
from driftspark.plans.registry import query
from driftspark.sources import domain
from driftspark.sources.tables import store


def _q(x):
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _case(column, values, default):
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {v if not isinstance(v, str) or v.replace('.', '').isdigit() else _q(v)}" for k, v in values.items()) + f" ELSE {default} END"


_RULES = ", ".join(f"({_q(t)}, {p}, [{', '.join(map(_q, a))}]::VARCHAR[], [{', '.join(map(_q, n))}]::VARCHAR[], {_q(o)}, {_q(v)}, {_q(j)}, {d}, {m}, {r})" for t, p, a, n, o, v, j, d, m, r in rules.FACT_RULES)
_NORM = "array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t NOT IN (" + ", ".join(map(_q, ("the", *rules.SUFFIXES))) + ")), ' ')"
_SPLIT = "list_filter(list_transform(string_split_regex({0}, '[;|]'), lambda x: trim(x)), lambda x: x <> '')"
_WATCH = "customer_id % 3 <> 0"

FACTS = f""", rules(fact_type, priority, has_words, no_words, object, value, jurisdiction, direct, ambiguous, derived) AS (VALUES {_RULES}),
lowered AS (SELECT *, lower(concat_ws(' ', title, raw_text)) AS low FROM evidence),
hits AS (SELECT e.* EXCLUDE (low), r.* EXCLUDE (has_words, no_words), row_number() OVER (PARTITION BY document_id, fact_type ORDER BY priority) AS nth FROM lowered e, rules r
  WHERE len(list_filter(has_words, lambda w: contains(low, w))) > 0 AND len(list_filter(no_words, lambda w: contains(low, w))) = 0),
facts AS (SELECT * EXCLUDE (nth, raw_text, language), concat_ws('|', document_id, fact_type) AS fact_id, greatest(0, least(1, {_case('source_quality', rules.FACT_QUALITY, 0.35)} + direct * 0.05
  - CASE WHEN source_type = 'reputable_news' THEN 0.10 ELSE 0 END - ambiguous * 0.15 - derived * 0.06 - CASE WHEN published_at IS NULL THEN 0.03 ELSE 0 END))::DECIMAL(4,2) AS confidence FROM hits WHERE nth = 1)
"""
_FIELDS = ", ".join(f"({_q(t)}, {_q(f)})" for t, fs in rules.SIGNAL_FIELDS.items() for f in fs)
DRIFT = FACTS + f""", fields(fact_type, field) AS (VALUES {_FIELDS}),
each AS (SELECT f.*, field, last_reviewed_at, CASE field WHEN 'known_jurisdictions' THEN {_SPLIT.format('coalesce(jurisdiction, object)')} WHEN 'risk_rating' THEN ['Review due to ' || object] WHEN 'entity_type' THEN [object] ELSE {_SPLIT.format('object')} END AS candidates,
  CASE field WHEN 'known_jurisdictions' THEN [domicile, region] WHEN 'business_area' THEN [segment] WHEN 'risk_rating' THEN [risk_rating] ELSE [] END AS have
  FROM facts f JOIN fields USING (fact_type) JOIN customers c USING (customer_id)),
fresh AS (SELECT *, CASE WHEN field IN ('risk_rating', 'entity_type', 'domicile') THEN list_slice(candidates, 1, 1) ELSE list_filter(candidates, lambda c: NOT ({_NORM.format('c')} <> ''
  AND len(list_filter(have, lambda h: contains({_NORM.format('h')}, {_NORM.format('c')}) OR contains({_NORM.format('c')}, {_NORM.format('h')}))) > 0)) END AS new FROM each),
changed AS (SELECT *, field IN ('risk_rating', 'entity_type', 'domicile') OR len(new) > 0 AS changed, array_to_string(have, '; ') AS before, array_to_string(new, '; ') AS after FROM fresh),
comp AS (SELECT f.*, last_reviewed_at, changed_fields, changes, reason AS comparison_reason, coalesce(CAST(substr(published_at, 1, 10) AS DATE) <= last_reviewed_at, false) AS predates_baseline,
    len(changed_fields) > 0 AND NOT coalesce(CAST(substr(published_at, 1, 10) AS DATE) <= last_reviewed_at, false) AS is_new_information,
    CASE WHEN fact_type IN ('regulatory_scrutiny', 'jurisdiction_restriction', 'ownership_change', 'risk_rating_review') OR (fact_type = 'treasury_policy_change' AND contains(lower(object), 'bitcoin')) THEN 'high' WHEN fact_type IN ('commercial_opportunity', 'public_listing') THEN 'low' ELSE 'medium' END AS materiality
  FROM facts f JOIN (SELECT fact_id, max(last_reviewed_at) AS last_reviewed_at, coalesce(list_sort(list(field) FILTER (changed)), []) AS changed_fields, coalesce(list(field || '=' || before || '>' || after ORDER BY field) FILTER (changed), []) AS changes,
    coalesce(array_to_string(list_sort(list(array_to_string(new, ', ') || ' is not in ' || field) FILTER (changed)), '. '), '') AS reason FROM changed GROUP BY fact_id) USING (fact_id))
"""
ALERTS = DRIFT + f""", grp AS (SELECT *, {_NORM.format('object')} AS object_key, {_case('source_quality', rules.ALERT_QUALITY, '0.30')} AS quality FROM comp WHERE is_new_information),
a0 AS (SELECT customer_id, fact_type AS signal_type, object_key, arg_min(object, fact_id) AS object, list_sort(list_distinct(flatten(list(changed_fields)))) AS changed_fields, max(materiality) AS materiality,
    list(DISTINCT {{'document_id': document_id, 'source_name': source_name, 'source_url': source_url, 'source_quality': source_quality, 'published_at': published_at, 'collected_at': collected_at, 'title': title}}) AS evidence,
    list_sort(list(fact_id)) AS fact_ids, count(DISTINCT document_id) AS documents, avg(CAST(confidence AS DOUBLE)) AS fact_confidence, avg(CAST(quality AS DOUBLE)) AS quality,
    bool_or(source_type IN ({', '.join(map(_q, rules.OFFICIAL))})) AS official, array_to_string(list_sort(list(DISTINCT comparison_reason)), ' ') AS comparison_reason FROM grp GROUP BY 1, 2, 3),
a1 AS (SELECT *, {_case('signal_type', rules.CATEGORY, _q('mixed'))} AS category, round(0.45::DOUBLE * fact_confidence + 0.25::DOUBLE * quality + 0.2::DOUBLE * CASE WHEN len(list_filter(changed_fields, lambda f: f <> 'risk_rating')) = 0 THEN 0.75 ELSE 0.95 END
    + 0.1::DOUBLE * CASE WHEN documents >= 2 THEN 1.0 WHEN official THEN 0.85 ELSE 0.65 END + 1e-9, 2) AS confidence FROM a0),
alerts AS (SELECT *, concat_ws('|', customer_id, signal_type, object_key) AS alert_id,
    CASE WHEN regexp_matches(lower(object), 'ofac|sanction|north korea|dprk|ransomware|darknet') THEN 'critical' WHEN signal_type IN ('regulatory_scrutiny', 'jurisdiction_restriction', 'risk_rating_review') AND regexp_matches(lower(object), 'russia|aml|cftc|gambling|blocked') THEN 'high'
    WHEN materiality = 'high' THEN 'high' WHEN category = 'opportunity' THEN 'medium' WHEN materiality = 'low' THEN 'low' ELSE 'medium' END AS severity FROM a1)
"""
_TS = "CASE WHEN length({0}) = 10 THEN CAST({0} AS TIMESTAMP) ELSE strptime({0}, '%Y-%m-%dT%H:%M:%SZ') END"
_IN = "(CASE WHEN length({0}) = 10 THEN CAST({0} AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-02-01' ELSE strptime({0}, '%Y-%m-%dT%H:%M:%SZ') BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-02-01 00:00:00' END)"


def _sum(words):
    return " + ".join(f"CASE WHEN contains(text, {_q(w)}) THEN {p} ELSE 0 END" for w, p in words.items())


SCORED = ALERTS + f""", ex AS (SELECT alert_id, unnest(evidence, recursive := true) FROM alerts),
es AS (SELECT alert_id, max({_TS.format('published_at')}) AS newest, max({_case('source_quality', rules.SOURCE_POINTS, 0)}) AS source_points,
    bool_or(coalesce({_IN.format('published_at')}, false) OR (published_at IS NULL AND {_IN.format('collected_at')})) AS in_window,
    arg_max(source_url, ({_case('source_quality', rules.SOURCE_POINTS, 0)}, coalesce({_TS.format('published_at')}, {_TS.format('collected_at')}), -document_id)) AS primary_url,
    string_agg(concat_ws(' ', title, source_name), ' ') AS etext FROM ex GROUP BY 1),
s0 AS (SELECT a.*, es.* EXCLUDE (alert_id, etext), lower(concat_ws(' ', object, comparison_reason, etext)) AS text, CASE WHEN newest IS NULL THEN NULL ELSE greatest(0, CAST(floor((epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(newest)) / 86400) AS INT)) END AS freshness_days FROM alerts a JOIN es USING (alert_id)),
s1 AS (SELECT *, CASE WHEN freshness_days IS NULL THEN -3 WHEN freshness_days <= 30 THEN 12 WHEN freshness_days <= 180 THEN 8 WHEN freshness_days <= 365 THEN 5 WHEN category = 'risk' OR signal_type IN ('regulatory_scrutiny', 'jurisdiction_restriction') THEN 4 ELSE -6 END AS freshness_points,
    least(26, {_sum(rules.KEYWORDS)}) AS keyword_points,
    least(110, CASE WHEN category = 'risk' THEN 18 ELSE 0 END + CASE WHEN signal_type IN ('regulatory_scrutiny', 'jurisdiction_restriction', 'risk_rating_review') THEN 18 ELSE 0 END + CASE WHEN signal_type IN ('ownership_change', 'new_subsidiary') THEN 12 ELSE 0 END
      + CASE WHEN signal_type IN ('domain_registration', 'new_jurisdiction') THEN 8 ELSE 0 END + {_sum(rules.IMPACT_KEYWORDS)}) AS impact_points,
    CAST(least(28, coalesce(list_sum(list_transform(changed_fields, lambda f: {_case('f', rules.FIELD_POINTS, 0)})), 0)) AS INT) AS field_points,
    CASE WHEN category = 'risk' OR severity IN ('critical', 'high') THEN 'Compliance review' WHEN signal_type IN ('ownership_change', 'new_subsidiary', 'new_jurisdiction', 'domain_registration') THEN 'KYC update' WHEN category = 'opportunity' THEN 'RM opportunity' ELSE 'RM review' END AS lane FROM s0),
scored AS (SELECT *, CAST({_case('severity', rules.SEVERITY_POINTS, 0)} + {_case('category', rules.CATEGORY_POINTS, 0)} + round(confidence * 20) + {_case('signal_type', rules.SIGNAL_POINTS, 0)} + source_points + field_points + freshness_points + keyword_points + impact_points AS INT) AS material_score FROM s1)
"""
CLASSIFIED = SCORED + f""", c0 AS (SELECT *, bool_or(in_window AND category = 'risk' AND material_score >= 100) OVER (PARTITION BY customer_id) AS shadowed FROM scored),
c1 AS (SELECT *, list_filter([CASE WHEN NOT ({_WATCH}) THEN 'outside_watchlist' END, CASE WHEN NOT in_window THEN 'outside_window' END, CASE WHEN NOT EXISTS (SELECT 1 FROM ex WHERE ex.alert_id = c0.alert_id AND ex.source_url <> '') THEN 'no_source_url' END, CASE WHEN confidence < 0.70 AND severity NOT IN ('critical', 'high') THEN 'low_confidence' END,
    CASE WHEN category = 'opportunity' AND shadowed AND material_score < 120 THEN 'shadowed' END, CASE WHEN signal_type IN ('commercial_opportunity', 'new_product', 'public_listing') AND category = 'opportunity' AND material_score < 115 THEN 'generic_opportunity' END], lambda x: x IS NOT NULL) AS r0,
    material_score >= 100 OR (severity IN ('critical', 'high') AND confidence >= 0.65) OR (category IN ('risk', 'ownership_control') AND confidence >= 0.72) AS qualifies FROM c0),
classified AS (SELECT *, qualifies AND len(r0) = 0 AS material, CASE WHEN len(r0) = 0 AND NOT qualifies THEN ['below_threshold'] ELSE r0 END AS reasons FROM c1)
"""
POLICIES = """, policies AS (SELECT n_name AS rm_id, list(c_custkey) AS watchlist, 60 + 10 * (max(n_nationkey) % 8) AS minimum_material_score, 0.6 + 0.05 * (max(n_nationkey) % 4) AS minimum_confidence,
  CASE WHEN max(n_nationkey) % 3 = 0 THEN ['risk', 'mixed'] ELSE ['risk', 'mixed', 'opportunity', 'ownership_control'] END AS categories, CASE WHEN max(n_nationkey) % 5 = 0 THEN ['critical', 'high'] ELSE ['critical', 'high', 'medium'] END AS severities
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
pe AS (SELECT p.*, s.*, list_filter([CASE WHEN NOT in_window THEN 'outside_refresh_window' END, CASE WHEN NOT EXISTS (SELECT 1 FROM ex WHERE ex.alert_id = s.alert_id AND ex.source_url <> '') THEN 'missing_source_url' END, CASE WHEN confidence < minimum_confidence THEN 'below_minimum_confidence' END, CASE WHEN material_score < minimum_material_score THEN 'below_minimum_material_score' END,
  CASE WHEN NOT list_contains(categories, category) THEN 'category_disabled' END, CASE WHEN NOT list_contains(severities, severity) THEN 'severity_disabled' END], lambda x: x IS NOT NULL) AS failures
  FROM (SELECT * EXCLUDE (watchlist), unnest(watchlist) AS customer_id FROM policies) p JOIN scored s USING (customer_id)),
pr AS (SELECT *, CASE WHEN len(failures) = 0 THEN row_number() OVER (PARTITION BY rm_id, len(failures) = 0 ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, material_score DESC, confidence DESC, alert_id) END AS policy_rank FROM pe)
"""


def facts(spark, d):
    return ev.rule_facts(domain.evidence(spark, d))


def profiles(spark, d):
    c = domain.customers(spark, d)
    return c.select("customer_id", "last_reviewed_at", F.create_map(F.lit("known_jurisdictions"), F.array("domicile", "region"), F.lit("business_area"), F.array("segment"), F.lit("risk_rating"), F.array("risk_rating")).alias("baseline"))


def comparisons(spark, d):
    return ev.compare(facts(spark, d), profiles(spark, d))


def alerts(spark, d):
    return ev.make_alerts(comparisons(spark, d))


def scored(spark, d):
    return ev.score(alerts(spark, d), domain.NOW, 720, keywords=rules.KEYWORDS, impact_keywords=rules.IMPACT_KEYWORDS)


def classified(spark, d):
    return ev.classify(scored(spark, d), F.col("customer_id") % 3 != 0)


def watched(spark, d):
    """Which manager watches which customer."""
    rows = domain.table(spark, d, "customer").join(domain.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("rm_id"), F.col("c_custkey").alias("customer_id"))


def policies(spark, d):
    rows = domain.table(spark, d, "customer").join(domain.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.max("n_nationkey")
    every = lambda *x: F.array(*map(F.lit, x))
    return rows.groupBy(F.col("n_name").alias("rm_id")).agg(
        (60 + 10 * (k % 8)).alias("minimum_material_score"),
        (0.6 + 0.05 * (k % 4)).alias("minimum_confidence"),
        F.when(k % 3 == 0, every("risk", "mixed")).otherwise(every("risk", "mixed", "opportunity", "ownership_control")).alias("categories"),
        F.when(k % 5 == 0, every("critical", "high")).otherwise(every("critical", "high", "medium")).alias("severities"),
        F.array().cast("array<string>").alias("signal_types"),
    )


def judged(spark, d):
    return ev.evaluate_policies(scored(spark, d), policies(spark, d), watched(spark, d))


def notifications(spark, d):
    """The managers' notifications after a run over an earlier state."""
    every = judged(spark, d)
    state = every.where("customer_id % 2 = 0").select("rm_id", "alert_id", F.lit("2024-01-15").cast("date").alias("first_seen"), F.lit(True).alias("active"), F.lit(0).alias("position"))
    run = every.where("size(failures) = 0").withColumn("seen", F.lit("2024-02-01").cast("date"))
    return ev.upsert_notifications(state, run)


@query("fact_expected_gate", FACTS + """, x AS (SELECT document_id, unnest(CASE document_id % 3 WHEN 0 THEN ['regulatory_scrutiny', 'jurisdiction_expansion'] WHEN 1 THEN ['new_product', 'commercial_expansion'] ELSE ['risk_rating_review'] END) AS t FROM evidence)
SELECT document_id, fact_type, object FROM facts WHERE (document_id, fact_type) IN (SELECT (document_id, CASE t WHEN 'jurisdiction_expansion' THEN 'new_jurisdiction' WHEN 'commercial_expansion' THEN 'commercial_opportunity' ELSE t END) FROM x)""")
def fact_expected_gate(spark, d):
    arr = lambda *x: F.array(*map(F.lit, x))
    m = F.col("document_id") % 3
    expected = F.when(m == 0, arr("regulatory_scrutiny", "jurisdiction_expansion")).when(m == 1, arr("new_product", "commercial_expansion")).otherwise(arr("risk_rating_review"))
    docs = domain.evidence(spark, d).select("document_id", expected.alias("expected"))
    aliases = {"jurisdiction_expansion": "new_jurisdiction", "commercial_expansion": "commercial_opportunity"}
    return ev.expected_gate(facts(spark, d), docs, aliases).select("document_id", "fact_type", "object")


@query("fact_model_precedence", FACTS + """, m AS (SELECT document_id, fact_type, object || ' (reviewed)' AS object FROM facts WHERE document_id % 2 = 0)
SELECT document_id, fact_type, object, 'model' AS method FROM m UNION ALL SELECT document_id, fact_type, object, 'rule' FROM facts WHERE (document_id, fact_type) NOT IN (SELECT (document_id, fact_type) FROM m)""")
def fact_model_precedence(spark, d):
    every = facts(spark, d).select("document_id", "fact_type", "object")
    model = every.where("document_id % 2 = 0").withColumn("object", F.concat("object", F.lit(" (reviewed)")))
    return ev.model_precedence(model, every)


@query("drift_field_values", DRIFT + "SELECT fact_id, field, array_to_string(candidates, '|') AS candidates FROM each")
def drift_field_values(spark, d):
    known = domain.customers(spark, d).select("customer_id")
    return ev.field_values(facts(spark, d).join(known, "customer_id", "left_semi")).select("fact_id", "field", F.array_join("candidates", "|").alias("candidates"))


@query("drift_compare", DRIFT + "SELECT fact_id, customer_id, array_to_string(changed_fields, '|') AS changed_fields, comparison_reason, predates_baseline, is_new_information, materiality FROM comp")
def drift_compare(spark, d):
    return comparisons(spark, d).select("fact_id", "customer_id", F.array_join("changed_fields", "|").alias("changed_fields"), "comparison_reason", "predates_baseline", "is_new_information", "materiality")


@query("drift_before_after", DRIFT + "SELECT fact_id, field, before, after FROM changed WHERE changed")
def drift_before_after(spark, d):
    return comparisons(spark, d).select("fact_id", F.explode("changes").alias("c")).select("fact_id", "c.field", "c.before", "c.after")


@query("drift_scalar", DRIFT + "SELECT fact_id, before, after FROM changed WHERE field = 'risk_rating'")
def drift_scalar(spark, d):
    return comparisons(spark, d).select("fact_id", F.explode("changes").alias("c")).where("c.field = 'risk_rating'").select("fact_id", "c.before", "c.after")


@query("drift_membership", DRIFT + "SELECT field, count(*) FILTER (changed) AS new, count(*) FILTER (NOT changed) AS known FROM changed WHERE field NOT IN ('risk_rating', 'entity_type') GROUP BY 1")
def drift_membership(spark, d):
    every = ev.field_values(facts(spark, d).join(domain.customers(spark, d).select("customer_id"), "customer_id", "left_semi")).select("fact_id", "field")
    new = comparisons(spark, d).select("fact_id", F.explode("changed_fields").alias("field")).withColumn("new", F.lit(True))
    return every.join(new, ["fact_id", "field"], "left").where("field not in ('risk_rating', 'entity_type')").groupBy("field").agg(F.count("new").alias("new"), F.count_if(F.col("new").isNull()).alias("known"))


@query("drift_dates", DRIFT + "SELECT predates_baseline, published_at IS NULL AS undated, source_quality, count(*) AS facts FROM comp GROUP BY 1, 2, 3")
def drift_dates(spark, d):
    return comparisons(spark, d).groupBy("predates_baseline", F.col("published_at").isNull().alias("undated"), "source_quality").agg(F.count("*").alias("facts"))


@query("drift_materiality", DRIFT + "SELECT fact_type, materiality, count(*) AS facts FROM comp GROUP BY 1, 2")
def drift_materiality(spark, d):
    return comparisons(spark, d).groupBy("fact_type", "materiality").agg(F.count("*").alias("facts"))


_ALERT = "SELECT alert_id, customer_id, signal_type, category, severity, confidence, documents, array_to_string(changed_fields, '|') AS changed_fields, array_to_string(fact_ids, ';') AS fact_ids FROM alerts"


@query("alert_group", ALERTS + _ALERT)
def alert_group(spark, d):
    return alerts(spark, d).select("alert_id", "customer_id", "signal_type", "category", "severity", "confidence", "documents", F.array_join("changed_fields", "|").alias("changed_fields"), F.array_join("fact_ids", ";").alias("fact_ids"))


@query("alert_merge", DRIFT + f""", k AS (SELECT fact_id, comparison_reason, materiality, concat_ws('|', customer_id, fact_type, {_NORM.format('object')}) AS alert_id FROM comp WHERE is_new_information),
v AS (SELECT alert_id, fact_id, field, have, unnest(new) AS value, generate_subscripts(new, 1) AS pos FROM k JOIN changed USING (fact_id) WHERE changed.changed),
u AS (SELECT alert_id, field, value, min((fact_id, pos)) AS sight FROM v GROUP BY 1, 2, 3),
w AS (SELECT alert_id, field, string_agg(value, ';' ORDER BY sight) AS after FROM u GROUP BY 1, 2),
b AS (SELECT alert_id, field, array_to_string(arg_min(have, fact_id), ';') AS before FROM k JOIN changed USING (fact_id) WHERE changed.changed GROUP BY 1, 2),
m AS (SELECT alert_id, string_agg(field, '|' ORDER BY field) AS changed_fields, string_agg(field || '=' || before, '|' ORDER BY field) AS before, string_agg(field || '=' || after, '|' ORDER BY field) AS after FROM b JOIN w USING (alert_id, field) GROUP BY 1),
r AS (SELECT alert_id, string_agg(comparison_reason, ' ' ORDER BY sight) AS comparison_reason FROM (SELECT alert_id, comparison_reason, min(fact_id) AS sight FROM k WHERE comparison_reason <> '' GROUP BY 1, 2) GROUP BY 1)
SELECT alert_id, changed_fields, before, after, comparison_reason, materiality FROM m JOIN r USING (alert_id) JOIN (SELECT alert_id, arg_max(materiality, CASE materiality WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS materiality FROM k GROUP BY 1) USING (alert_id)""")
def alert_merge(spark, d):
    """The merged comparisons of each alert; the two maps as texts, so that any reader can compare them."""
    new = comparisons(spark, d).where("is_new_information")
    keyed = new.withColumn("alert_id", F.concat_ws("|", "customer_id", "fact_type", ev.normalize_name(F.col("object"))))
    told = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";"))), "|").alias(m)
    return ev.merge_comparisons(keyed, ["alert_id"], "fact_id").select("alert_id", F.array_join("changed_fields", "|").alias("changed_fields"), told("before"), told("after"), "comparison_reason", "materiality")


def _histogram(name, column, frame=alerts, prefix=ALERTS, source="alerts"):
    @query(name, prefix + f"SELECT {column}, count(*) AS alerts FROM {source} GROUP BY 1")
    def f(spark, d):
        return frame(spark, d).groupBy(column).agg(F.count("*").alias("alerts"))


_histogram("alert_category", "category")
_histogram("alert_severity", "severity")


@query("alert_confidence", ALERTS + "SELECT alert_id, confidence, round(fact_confidence, 4) AS fact_confidence, round(quality, 4) AS quality FROM alerts")
def alert_confidence(spark, d):
    return alerts(spark, d).select("alert_id", "confidence", F.round("fact_confidence", 4).alias("fact_confidence"), F.round("quality", 4).alias("quality"))


@query("alert_severity_merge", ALERTS + """SELECT alert_id, severity AS rule_severity, CASE customer_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' END AS suggested,
CASE WHEN customer_id % 4 = 0 THEN 'critical' ELSE severity END AS severity FROM alerts""")
def alert_severity_merge(spark, d):
    from driftspark.functions.text import lookup

    rank = lambda c: lookup(c, rules.SEVERITY_RANK, 0)
    suggested = F.when(F.col("customer_id") % 4 == 0, "critical").when(F.col("customer_id") % 4 == 1, "low")
    out = alerts(spark, d).withColumn("suggested", suggested)
    return out.select("alert_id", F.col("severity").alias("rule_severity"), "suggested", F.when(rank("suggested") > rank("severity"), F.col("suggested")).otherwise(F.col("severity")).alias("severity"))


@query("alert_display", ALERTS + """SELECT alert_id, CASE signal_type WHEN 'regulatory_scrutiny' THEN legal_name || ' faces regulatory scrutiny: ' || object WHEN 'risk_rating_review' THEN legal_name || ' risk rating should be reviewed'
WHEN 'new_product' THEN legal_name || ' product signal: ' || object ELSE legal_name || ' signal: ' || object END AS title, documents || CASE WHEN documents = 1 THEN ' document' ELSE ' documents' END || ' and ' || len(changed_fields) || CASE WHEN len(changed_fields) = 1 THEN ' field' ELSE ' fields' END AS summary
FROM alerts JOIN customers USING (customer_id)""")
def alert_display(spark, d):
    name, obj = F.col("legal_name"), F.col("object")
    title = F.when(F.col("signal_type") == "regulatory_scrutiny", F.concat(name, F.lit(" faces regulatory scrutiny: "), obj)).when(F.col("signal_type") == "risk_rating_review", F.concat(name, F.lit(" risk rating should be reviewed")))
    title = title.when(F.col("signal_type") == "new_product", F.concat(name, F.lit(" product signal: "), obj)).otherwise(F.concat(name, F.lit(" signal: "), obj))
    many = lambda n, word: F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))
    joined = alerts(spark, d).join(domain.customers(spark, d).select("customer_id", "legal_name"), "customer_id")
    return joined.select("alert_id", title.alias("title"), F.concat(many(F.col("documents"), "document"), F.lit(" and "), many(F.size("changed_fields"), "field")).alias("summary"))


@query("alert_evidence", SCORED + "SELECT alert_id, document_id, source_quality, source_url FROM ex")
def alert_evidence(spark, d):
    return alerts(spark, d).select("alert_id", F.explode("evidence").alias("e")).select("alert_id", "e.document_id", "e.source_quality", "e.source_url")


@query("alert_suppression_stats", ALERTS + "SELECT (SELECT count(*) FROM comp WHERE predates_baseline AND len(changed_fields) > 0) AS predating, (SELECT coalesce(sum(len(fact_ids) - 1), 0)::BIGINT FROM alerts) AS clustered, (SELECT count(*) FROM alerts) AS alerts")
def alert_suppression_stats(spark, d):
    comp = comparisons(spark, d).agg(F.count_if(F.col("predates_baseline") & (F.size("changes") > 0)).alias("predating"))
    some = alerts(spark, d).agg(F.coalesce(F.sum(F.size("fact_ids") - 1), F.lit(0)).alias("clustered"), F.count("*").alias("alerts"))
    return comp.crossJoin(some)


_MISSING = lambda names: " OR ".join(f"{n} IS NULL" for n in names)


@query("integrity_check", ALERTS + f""", own AS (SELECT count(*) FILTER ({_MISSING(ev.FACT_REQUIRED)}) AS a, count(*) FILTER (coalesce(value, '') = '' AND coalesce(object, '') = '') AS b FROM facts),
said AS (SELECT count(*) FILTER ({_MISSING(ev.ALERT_REQUIRED)}) AS a, count(*) FILTER (coalesce(len(changed_fields), 0) = 0) AS b, count(*) FILTER (coalesce(len(fact_ids), 0) = 0) AS c, count(*) FILTER (coalesce(len(evidence), 0) = 0) AS d FROM alerts)
SELECT 'fact_fields' AS error, a AS rows FROM own UNION ALL SELECT 'fact_content', b FROM own UNION ALL SELECT 'alert_fields', a FROM said UNION ALL SELECT 'empty_fields', b FROM said UNION ALL SELECT 'alert_facts', c FROM said UNION ALL SELECT 'alert_evidence', d FROM said
UNION ALL SELECT 'fact_document', count(*) FROM facts WHERE document_id NOT IN (SELECT document_id FROM evidence) UNION ALL SELECT 'alert_fact', count(*) FROM (SELECT unnest(fact_ids) AS f FROM alerts) WHERE f NOT IN (SELECT fact_id FROM facts)
UNION ALL SELECT 'fact_customer', count(*) FROM facts WHERE customer_id NOT IN (SELECT customer_id FROM customers) UNION ALL SELECT 'alert_document', count(*) FROM (SELECT unnest(evidence).document_id AS e FROM alerts) WHERE e NOT IN (SELECT document_id FROM evidence)""")
def integrity_check(spark, d):
    return ev.integrity(facts(spark, d), alerts(spark, d), domain.evidence(spark, d), domain.customers(spark, d))


@query("run_report", ALERTS + "SELECT category, severity, count(*) AS alerts, round(avg(confidence), 4) AS mean_confidence FROM alerts GROUP BY GROUPING SETS ((category), (severity), ())")
def run_report(spark, d):
    return alerts(spark, d).groupingSets([[F.col("category")], [F.col("severity")], []], "category", "severity").agg(F.count("*").alias("alerts"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


_POINTS = ["freshness_days", "freshness_points", "keyword_points", "impact_points", "source_points", "field_points", "material_score"]


@query("mat_score", SCORED + f"SELECT alert_id, {', '.join(_POINTS)} FROM scored")
def mat_score(spark, d):
    return scored(spark, d).select("alert_id", *_POINTS)


def _column(name, *columns):
    @query(name, SCORED + f"SELECT alert_id, {', '.join(columns)} FROM scored")
    def f(spark, d):
        return scored(spark, d).select("alert_id", *columns)


_column("mat_newest_evidence", "newest")
_column("mat_freshness", "freshness_days", "freshness_points")
_column("mat_keywords", "keyword_points")
_column("mat_business_impact", "impact_points")
_column("mat_source_points", "source_points")
_column("mat_field_points", "field_points")
_column("mat_window", "in_window")
_column("mat_primary_evidence", "primary_url")
_column("mat_review_lane", "lane")


@query("mat_suppress", CLASSIFIED + "SELECT alert_id, material, qualifies, shadowed, array_to_string(reasons, '|') AS reasons FROM classified")
def mat_suppress(spark, d):
    return classified(spark, d).select("alert_id", "material", "qualifies", "shadowed", F.array_join("reasons", "|").alias("reasons"))


@query("mat_risk_shadow", CLASSIFIED + "SELECT customer_id, shadowed, count(*) AS alerts FROM classified GROUP BY 1, 2")
def mat_risk_shadow(spark, d):
    return classified(spark, d).groupBy("customer_id", "shadowed").agg(F.count("*").alias("alerts"))


@query("mat_rank", CLASSIFIED + """SELECT alert_id, customer_id, material_score, row_number() OVER (PARTITION BY customer_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, material_score DESC, confidence DESC,
CASE WHEN coalesce(freshness_days, 0) = 0 THEN 99999 ELSE freshness_days END, alert_id) AS rank_in_customer FROM classified WHERE material""")
def mat_rank(spark, d):
    return ev.rank_material(classified(spark, d)).select("alert_id", "customer_id", "material_score", "rank_in_customer")


@query("mat_summary", CLASSIFIED + "SELECT count(*) AS alerts, count(*) FILTER (in_window) AS in_window, count(*) FILTER (material) AS material, count(*) FILTER (material AND category = 'risk') AS risk, max(material_score) AS best FROM classified")
def mat_summary(spark, d):
    return classified(spark, d).agg(F.count("*").alias("alerts"), F.count_if("in_window").alias("in_window"), F.count_if("material").alias("material"), F.count_if(F.col("material") & (F.col("category") == "risk")).alias("risk"), F.max("material_score").alias("best"))


@query("mat_reason_counts", CLASSIFIED + "SELECT reason, count(*) AS alerts FROM (SELECT unnest(reasons) AS reason FROM classified) GROUP BY 1")
def mat_reason_counts(spark, d):
    return classified(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("alerts"))


@query("policy_evaluate", SCORED + POLICIES + "SELECT rm_id, alert_id, array_to_string(failures, '|') AS failures, policy_rank FROM pr")
def policy_evaluate(spark, d):
    return judged(spark, d).select("rm_id", "alert_id", F.array_join("failures", "|").alias("failures"), F.col("policy_rank"))


@query("policy_summary", SCORED + POLICIES + "SELECT rm_id, count(*) AS alerts, count(*) FILTER (len(failures) = 0) AS qualified, count(*) FILTER (list_contains(failures, 'outside_refresh_window')) AS outside FROM pr GROUP BY 1")
def policy_summary(spark, d):
    return judged(spark, d).groupBy("rm_id").agg(F.count("*").alias("alerts"), F.count_if(F.size("failures") == 0).alias("qualified"), F.count_if(F.array_contains("failures", "outside_refresh_window")).alias("outside"))


@query("notify_upsert", SCORED + POLICIES + """, q AS (SELECT rm_id, alert_id, policy_rank FROM pr WHERE len(failures) = 0), st AS (SELECT rm_id, alert_id, DATE '2024-01-15' AS first_seen, 0 AS position FROM pr WHERE customer_id % 2 = 0)
SELECT rm_id, alert_id, coalesce(first_seen, DATE '2024-02-01') AS first_seen, policy_rank IS NOT NULL AS active, coalesce(policy_rank, position) AS position FROM st FULL JOIN q USING (rm_id, alert_id)""")
def notify_upsert(spark, d):
    return notifications(spark, d)


@query("notify_list", SCORED + POLICIES + "SELECT rm_id, policy_rank, alert_id FROM pr WHERE policy_rank IS NOT NULL")
def notify_list(spark, d):
    """All active rows in rank order."""
    return notifications(spark, d).where("active").select("rm_id", F.col("position").alias("policy_rank"), "alert_id").orderBy("rm_id", "policy_rank")


@query("notify_seed", CLASSIFIED + POLICIES + "SELECT rm_id, alert_id FROM classified JOIN (SELECT rm_id, unnest(watchlist) AS customer_id FROM policies) USING (customer_id) WHERE material")
def notify_seed(spark, d):
    return classified(spark, d).where("material").join(watched(spark, d), "customer_id").select("rm_id", "alert_id")


_SIGNALS = """, sig AS (SELECT customer_id, 'volume_spike' AS signal_id, 0.8 AS confidence FROM (SELECT customer_id, date_trunc('month', booked_on) AS m, CAST(sum(amount) AS DOUBLE) AS v FROM recent GROUP BY 1, 2) JOIN baselines USING (customer_id) WHERE v > expected_monthly_volume * 3 GROUP BY 1
UNION ALL SELECT customer_id, 'new_region', 0.7 FROM recent JOIN baselines USING (customer_id) WHERE NOT list_contains(expected_regions, region) GROUP BY 1)
"""


@query("fuse_alerts", CLASSIFIED + _SIGNALS + """, p AS (SELECT customer_id, sum(confidence) AS c, list_sort(list(signal_id)) AS ids FROM sig GROUP BY 1)
SELECT alert_id, customer_id, CASE WHEN material THEN material_score ELSE 100 END + least(30, CAST(round(c * 15) AS INT)) AS fused_score, array_to_string(ids, '|') AS signal_ids FROM classified JOIN p USING (customer_id)""")
def fuse_alerts(spark, d):
    return fused(spark, d).withColumn("signal_ids", F.array_join("signal_ids", "|"))


def fused(spark, d):
    from driftspark.operators import bank

    txns = store(domain.transactions(spark, d).select("customer_id", "booked_on", "amount", "region"), "transactions")
    base = domain.activity_baselines(txns.withColumn("purpose", F.lit(None).cast("string")))  # no signal asks for expected purposes
    before = F.col("booked_on") < F.lit(domain.BASELINE_UNTIL).cast("date")
    recent = txns.where(~before)
    monthly = recent.groupBy("customer_id", bank.month().alias("m")).agg(F.sum("amount").cast("double").alias("v")).join(base, "customer_id")
    spike = monthly.where("v > expected_monthly_volume * 3").select("customer_id").distinct().select("customer_id", F.lit("volume_spike").alias("signal_id"), F.lit(0.8).alias("confidence"))
    per = txns.groupBy("customer_id", "region").agg(F.bool_or(before).alias("known"), F.bool_or(~before).alias("now"))
    fresh = F.col("now") & ~F.col("known") & F.col("region").isNotNull()
    region = per.groupBy("customer_id").agg(F.bool_or("known").alias("based"), F.bool_or(fresh).alias("fresh")).where("based and fresh").select("customer_id", F.lit("new_region").alias("signal_id"), F.lit(0.7).alias("confidence"))
    some = classified(spark, d).select("alert_id", "customer_id", F.when(F.col("material"), F.col("material_score")).alias("material_score"))
    return bank.fuse(some, spike.unionByName(region))


@query("fused_context", CLASSIFIED + _SIGNALS + "SELECT alert_id, signal_id FROM classified JOIN sig USING (customer_id)")
def fused_context(spark, d):
    return fused(spark, d).select("alert_id", F.explode("signal_ids").alias("signal_id"))


@query("eval_cases", CLASSIFIED + """, l AS (SELECT doc_id AS document_id, toxic FROM labels WHERE toxic IS NOT NULL), h AS (SELECT DISTINCT document_id FROM facts WHERE fact_type IN ('regulatory_scrutiny', 'risk_rating_review'))
SELECT toxic, count(*) AS cases, count(h.document_id) AS hits, round(avg(CASE WHEN (h.document_id IS NOT NULL) = (toxic = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l LEFT JOIN h USING (document_id) GROUP BY 1""")
def eval_cases(spark, d):
    labels = domain.table(spark, d, "labels").where("toxic is not null").select(F.col("doc_id").alias("document_id"), "toxic")
    hit = facts(spark, d).where("fact_type in ('regulatory_scrutiny', 'risk_rating_review')").select("document_id").distinct().withColumn("hit", F.lit(True))
    right = (F.col("hit").isNotNull() == (F.col("toxic") == 1)).cast("double")
    return labels.join(hit, "document_id", "left").groupBy("toxic").agg(F.count("*").alias("cases"), F.count("hit").alias("hits"), F.round(F.avg(right), 6).alias("accuracy"))
