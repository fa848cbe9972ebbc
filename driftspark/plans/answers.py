"""Queries over a model's answers. The answers are written here over the documents, in eleven shapes by the text's length; both sides read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark.functions import rules
from driftspark.operators import model_answers as mo
from driftspark.plans.registry import query
from driftspark.sources import domain

#: The same expressions in Spark SQL and in DuckDB: a candidate and the answer around it, by n, the text's length, and q, words of the text.
_CANDIDATE = """concat('{"signal_type": "', CASE n % 7 WHEN 0 THEN 'Product Launch' WHEN 1 THEN 'negative-news' WHEN 2 THEN 'new_jurisdiction' WHEN 3 THEN 'Market Entry!' WHEN 4 THEN 'weird kind' WHEN 5 THEN 'kyc refresh' ELSE '' END,
  '", "changed_kyc_fields": ', CASE n % 5 WHEN 0 THEN '["products", "Risk Level", "other"]' WHEN 1 THEN '"country"' WHEN 2 THEN '[]' WHEN 3 THEN '["websites", "rating"]' ELSE 'null' END,
  ', "severity_suggestion": ', CASE n % 4 WHEN 0 THEN '"HIGH"' WHEN 1 THEN '"severe"' WHEN 2 THEN 'null' ELSE '"low"' END, ', "confidence": ', CASE n % 6 WHEN 0 THEN '"85%"' WHEN 1 THEN '0.9' WHEN 2 THEN '"none"' WHEN 3 THEN '"140"' WHEN 4 THEN '1.5' ELSE 'null' END,
  ', "verbatim_evidence": "', CASE WHEN n % 3 = 0 OR q = '' THEN 'made up by no one 123' ELSE q END, '", "effective_date": ', CASE WHEN n % 4 = 0 AND published_at IS NOT NULL THEN concat('"', substr(published_at, 1, 10), '"') WHEN n % 4 = 1 THEN '"next week"' WHEN n % 4 = 2 THEN 'null' ELSE '"2020-01-01"' END,
  ', "needs_human_review": ', CASE n % 5 WHEN 0 THEN 'false' WHEN 1 THEN '"Yes"' WHEN 2 THEN '7' ELSE 'true' END, ', "claim": ""}')"""
_ANSWER = """CASE n % 11 WHEN 0 THEN concat('{"relevant": true, "entity_match": "yes", "signal_candidates": [', c, ', ', c, ']}') WHEN 1 THEN concat('{"relevant": "Yes", "entity_match": true, "signals": ', c, '}')
  WHEN 2 THEN concat('{"relevant": true, "entity_match": true, "signal_candidates": [], "candidates": [3, ', c, ']}') WHEN 3 THEN '{"relevant": true, "entity_match": true, "signal_candidate": "see above"}'
  WHEN 4 THEN concat('[', c, ']') WHEN 5 THEN concat('```json', chr(10), '{"signal_candidates": [', c, ']}', chr(10), '```') WHEN 6 THEN concat('Here it is: {"relevant": 7, "entity_match": null, "signals": [', c, ']} as asked.')
  WHEN 7 THEN concat('{"relevant": true, "signals": [', substr(c, 1, 40)) WHEN 8 THEN '{"signal_candidates": [], "no_signal_reason": "nothing  new"}' WHEN 9 THEN concat('{"relevant": "no", "entity_match": true, "signals": [', c, ']}') ELSE concat('{"candidates": [', c, '], "entity_match": "FALSE"}') END"""
_EXPECTED = "CASE source_type WHEN 'regulator' THEN ['made_up', 'regulatory_scrutiny'] WHEN 'blog' THEN ['new_product'] END"
_TARGETED = "CASE WHEN source_type = 'sec_filing' THEN ['business_model', 'risk'] END"


def _map(values):
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


_TYPES = _map({t: "['" + "', '".join(sorted(fs)) + "']" for t, fs in rules.SIGNAL_FIELDS.items()})
_FIELDS = "['" + "', '".join(sorted({f for fs in rules.SIGNAL_FIELDS.values() for f in fs})) + "']"
_ALIASES, _FIELD_ALIASES = (_map({k: f"'{v}'" for k, v in m.items()}) for m in (rules.SIGNAL_TYPE_ALIASES, rules.FIELD_ALIASES))
_FALSY = "('\"\"', '[]', '{}', '0', 'false', 'null')"


def _slug(x):
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


def _flag(x):
    return f"CASE WHEN json_type({x}) IN ('BOOLEAN', 'VARCHAR') THEN CASE WHEN lower(trim(json_extract_string({x}, '$'))) IN ('true', 'yes') THEN true WHEN lower(trim(json_extract_string({x}, '$'))) IN ('false', 'no') THEN false END END"


def _text(key):
    return f"CASE WHEN CAST(json_extract(c, '$.{key}') AS VARCHAR) IN {_FALSY} THEN '' ELSE coalesce(trim(regexp_replace(json_extract_string(c, '$.{key}'), '\\s+', ' ', 'g')), '') END"


def _fold(x):
    return f"trim(regexp_replace(translate(lower({x}), '‘’“”–—', '''''\"\"--'), '\\s+', ' ', 'g'))"


READ = f""", m0 AS (SELECT e.*, c.customer_id IS NOT NULL AS known, length(coalesce(raw_text, '')) AS n, coalesce(regexp_extract(raw_text, '[A-Za-z ,.]{{20,60}}'), '') AS q,
    {_EXPECTED} AS expected, {_TARGETED} AS targeted, trim(regexp_replace(concat_ws(' ', title, evidence_excerpt, raw_text), '[\\s\\p{{Z}}]+', ' ', 'g')) AS t FROM evidence e LEFT JOIN customers c USING (customer_id)),
m1 AS (SELECT *, {_ANSWER} AS raw FROM (SELECT *, {_CANDIDATE} AS c FROM m0)),
m2 AS (SELECT * EXCLUDE (c), trim(regexp_replace(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '(?i)^```(json)?', ''), '```$', '')) AS bare FROM m1),
m3 AS (SELECT *, CASE WHEN json_valid(bare) THEN CASE WHEN json_type(bare) = 'OBJECT' THEN bare END WHEN json_valid(regexp_extract(bare, '\\{{.*\\}}')) THEN regexp_extract(bare, '\\{{.*\\}}') END AS payload FROM m2),
m4 AS (SELECT *, coalesce({', '.join(f"CASE WHEN CAST(json_extract(payload, '$.{k}') AS VARCHAR) NOT IN {_FALSY} THEN json_extract(payload, '$.{k}') END" for k in mo.CANDIDATE_KEYS)}) AS found FROM m3),
m5 AS (SELECT *, CASE json_type(found) WHEN 'OBJECT' THEN [found] WHEN 'ARRAY' THEN json_extract(found, '$[*]') ELSE [] END AS listed, {_flag("json_extract(payload, '$.relevant')")} AS r, {_flag("json_extract(payload, '$.entity_match')")} AS e FROM m4),
m6 AS (SELECT *, coalesce(r, len(listed) > 0) AS relevant, coalesce(e, len(listed) > 0) AS entity_match FROM m5),
m7 AS (SELECT *, CASE WHEN relevant AND entity_match THEN list_filter(listed, lambda x: json_type(x) = 'OBJECT') ELSE [] END AS cands,
  CAST(json_type(found) NOT IN ('OBJECT', 'ARRAY') AS INT) AS e0, CAST(r IS NULL AS INT) + CAST(e IS NULL AS INT) AS e1, CASE WHEN relevant AND entity_match THEN len(list_filter(listed, lambda x: json_type(x) <> 'OBJECT')) ELSE 0 END AS e2 FROM m6),
analyses AS MATERIALIZED (SELECT *, CASE WHEN NOT known THEN 'skipped_missing_baseline' WHEN n % 13 = 5 THEN 'api_error' WHEN payload IS NULL THEN 'invalid_model_output' WHEN len(cands) > 0 THEN 'validated' ELSE 'no_signal' END AS status, coalesce(e0, 0) + e1 + e2 AS n_errors FROM m7),
k0 AS (SELECT document_id, published_at, title, evidence_excerpt, t, expected, targeted, n_errors, unnest(range(len(cands))) AS pos, unnest(cands) AS c FROM analyses WHERE status = 'validated'),
k1 AS (SELECT *, {_text('signal_type')} AS type_said, {_text('verbatim_evidence')} AS quote, lower({_text('severity_suggestion')}) AS sev, json_extract(c, '$.confidence') AS conf, {_text('effective_date')} AS day, json_extract(c, '$.changed_kyc_fields') AS fj, {_flag("json_extract(c, '$.needs_human_review')")} AS review FROM k0),
k2 AS (SELECT *, coalesce({_ALIASES}[{_slug('type_said')}], {_slug('type_said')}) AS named, CASE WHEN json_type(fj) = 'ARRAY' THEN json_extract_string(fj, '$[*]') ELSE [coalesce(json_extract_string(fj, '$'), '')] END AS fields_said FROM k1),
k3 AS (SELECT *, {_TYPES}[named] IS NOT NULL AS type_known, coalesce(CASE WHEN {_TYPES}[named] IS NOT NULL THEN named END, list_filter(expected, lambda x: {_TYPES}[x] IS NOT NULL)[1], 'business_activity_change') AS signal_type,
  list_transform(fields_said, lambda f: coalesce({_FIELD_ALIASES}[{_slug('f')}], {_slug('f')})) AS fields_named, list_transform(targeted, lambda f: coalesce({_FIELD_ALIASES}[{_slug('f')}], {_slug('f')})) AS fields_targeted FROM k2),
k4 AS (SELECT *, {_TYPES}[signal_type] AS allowed, CASE WHEN json_type(conf) = 'VARCHAR' THEN CASE WHEN TRY_CAST(replace(json_extract_string(conf, '$'), '%', '') AS DOUBLE) > 1 THEN TRY_CAST(replace(json_extract_string(conf, '$'), '%', '') AS DOUBLE) / 100 ELSE TRY_CAST(replace(json_extract_string(conf, '$'), '%', '') AS DOUBLE) END
    WHEN json_type(conf) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(conf AS DOUBLE) END AS value, {_fold('quote')} <> '' AND contains({_fold('t')}, {_fold('quote')}) AS stands, regexp_extract(t, '^.*?[.!?] ') AS sentence FROM k3),
k5 AS (SELECT *, list_filter(fields_named, lambda f: list_contains(allowed, f)) AS kept, list_filter(fields_named, lambda f: NOT list_contains(allowed, f) AND list_contains({_FIELDS}, f)) AS alien, list_filter(fields_targeted, lambda f: list_contains(allowed, f)) AS meant,
  CASE WHEN day = '' THEN 'null' WHEN NOT regexp_full_match(day, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'invalid_model_date_normalized_to_null' WHEN day = coalesce(published_at, '') THEN 'document_published_at' WHEN contains(t, day) THEN 'document_text' ELSE 'model_supplied_date_not_in_source_normalized_to_null' END AS origin FROM k4),
candidates AS (SELECT document_id, pos, signal_type, list_sort(list_distinct(CASE WHEN len(kept) > 0 THEN kept WHEN len(meant) > 0 THEN meant ELSE allowed[1:1] END)) AS fields, CASE WHEN sev IN ('low', 'medium', 'high', 'critical') THEN sev ELSE 'medium' END AS severity, round(greatest(0, least(1, coalesce(value, 0.7))), 2) AS confidence,
  CASE WHEN trim(title) <> '' THEN trim(regexp_replace(title, '\\s+', ' ', 'g')) ELSE signal_type || ' signal detected' END AS claim,
  CASE WHEN stands THEN quote WHEN trim(evidence_excerpt) <> '' THEN trim(regexp_replace(evidence_excerpt, '\\s+', ' ', 'g')) WHEN sentence <> '' THEN substr(rtrim(sentence), 1, 500) ELSE substr(t, 1, 500) END AS evidence, stands, CASE WHEN origin IN ('document_published_at', 'document_text') THEN day END AS effective_date, origin AS effective_date_source, type_known,
  CAST(NOT type_known AS INT) + len(alien) + CAST(len(kept) = 0 AND coalesce(len(meant), 0) = 0 AS INT) + CAST(sev NOT IN ('low', 'medium', 'high', 'critical') AS INT) + CAST(value IS NULL OR value < 0 OR value > 1 AS INT) + CAST(NOT stands AS INT) + CAST(origin LIKE '%normalized%' AS INT) + CAST(review IS NULL OR NOT review AS INT) AS n_warnings, n_errors, review FROM k5)
"""


def raw_answers(spark, d):
    """Documents with what an analysis needs, and an answer or an error for each."""
    e = domain.evidence(spark, d)
    expected = F.when(F.col("source_type") == "regulator", F.array(F.lit("made_up"), F.lit("regulatory_scrutiny"))).when(F.col("source_type") == "blog", F.array(F.lit("new_product")))
    targeted = F.when(F.col("source_type") == "sec_filing", F.array(F.lit("business_model"), F.lit("risk")))
    docs = e.select("document_id", "customer_id", "source_type", "published_at", "title", "evidence_excerpt", "raw_text", expected.alias("expected"), targeted.alias("targeted"))
    n = docs.select("document_id", "published_at", F.length(F.coalesce("raw_text", F.lit(""))).alias("n"), F.coalesce(F.regexp_extract("raw_text", "[A-Za-z ,.]{20,60}", 0), F.lit("")).alias("q"))
    raw = n.withColumn("c", F.expr(_CANDIDATE)).select("document_id", F.expr(_ANSWER).alias("raw"), F.when(F.col("n") % 13 == 5, "TimeoutError: no answer").alias("error"))
    return docs, raw


def analyses(spark, d, mode="live"):
    docs, raw = raw_answers(spark, d)
    return mo.analyse(docs, domain.customers(spark, d).select("customer_id"), raw, mode)


def _candidates(spark, d):
    docs, raw = raw_answers(spark, d)
    return mo.validated_candidates(docs, domain.customers(spark, d).select("customer_id"), raw, "m-1")


@query("model_json_parse", READ + "SELECT document_id, payload IS NOT NULL AS valid, CAST(len(json_keys(payload)) AS INT) AS keys FROM m3")
def model_json_parse(spark, d):
    _, raw = raw_answers(spark, d)
    keys = F.size(F.map_keys(F.try_variant_get("payload", "$", "map<string,variant>")))
    return mo.parse(raw).select("document_id", F.col("payload").isNotNull().alias("valid"), F.when(F.col("payload").isNotNull(), keys).alias("keys"))


@query("cand_explode", READ + "SELECT document_id, pos, n_errors FROM candidates")
def cand_explode(spark, d):
    return _candidates(spark, d).select("document_id", "pos", (F.size("all_warnings") - F.size("warnings")).alias("n_errors"))


@query("cand_signal_type", READ + "SELECT document_id, pos, signal_type, NOT type_known AS warned FROM candidates")
def cand_signal_type(spark, d):
    return _candidates(spark, d).select("document_id", "pos", "signal_type", F.exists("warnings", lambda w: w.startswith("Unsupported signal_type")).alias("warned"))


@query("cand_fields", READ + "SELECT document_id, pos, array_to_string(fields, '|') AS fields FROM candidates")
def cand_fields(spark, d):
    return _candidates(spark, d).select("document_id", "pos", F.array_join("fields", "|").alias("fields"))


@query("cand_severity", READ + "SELECT document_id, pos, severity FROM candidates")
def cand_severity(spark, d):
    return _candidates(spark, d).select("document_id", "pos", "severity")


@query("cand_confidence", READ + "SELECT document_id, pos, confidence FROM candidates")
def cand_confidence(spark, d):
    return _candidates(spark, d).select("document_id", "pos", "confidence")


@query("cand_evidence", READ + "SELECT document_id, pos, evidence, NOT stands AS replaced FROM candidates")
def cand_evidence(spark, d):
    return _candidates(spark, d).select("document_id", "pos", "evidence", F.exists("warnings", lambda w: w.startswith("Quote was not exact")).alias("replaced"))


@query("cand_effective_date", READ + "SELECT document_id, pos, effective_date, effective_date_source FROM candidates")
def cand_effective_date(spark, d):
    return _candidates(spark, d).select("document_id", "pos", "effective_date", "effective_date_source")


@query("cand_flags", READ + "SELECT document_id, relevant, entity_match, coalesce(len(list_filter(cands, lambda c: true)), 0) AS candidates FROM analyses WHERE status IN ('validated', 'no_signal')")
def cand_flags(spark, d):
    answered = analyses(spark, d).where("status in ('validated', 'no_signal')")
    return answered.select("document_id", "relevant", "entity_match", F.col("n_candidates").cast("long").alias("candidates"))


@query("analysis_status", READ + "SELECT status, count(*) AS documents FROM analyses GROUP BY 1 UNION ALL SELECT CASE WHEN NOT known THEN 'off: skipped_missing_baseline' ELSE 'off: skipped_ai_disabled' END, count(*) FROM analyses GROUP BY 1 UNION ALL SELECT CASE WHEN NOT known THEN 'mock: skipped_missing_baseline' ELSE 'mock: mock_fixture_no_signal' END, count(*) FROM analyses GROUP BY 1")
def analysis_status(spark, d):
    each = [analyses(spark, d, m).groupBy(F.concat(F.lit("" if m == "live" else f"{m}: "), "status").alias("status")).agg(F.count("*").alias("documents")) for m in ("live", "off", "mock")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("analysis_candidates", READ + "SELECT concat('ai-', document_id) AS analysis_id, pos, 'm-1' AS model, claim, n_warnings + n_errors AS n_warnings, true AS needs_human_review FROM candidates")
def analysis_candidates(spark, d):
    return _candidates(spark, d).select("analysis_id", "pos", "model", "claim", F.size("all_warnings").cast("long").alias("n_warnings"), "needs_human_review")
