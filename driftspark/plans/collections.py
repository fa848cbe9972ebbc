"""Queries over sources, sinks and the steps between landed feeds and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftspark.functions import rules
from driftspark.functions import text as tx
from driftspark.operators import discovery as disc
from driftspark.operators import evidence as ev
from driftspark.plans import evidence as ep
from driftspark.plans.discovery import PAGES, pruned, sql_date
from driftspark.plans.evidence import ALERTS, FACTS, POLICIES
from driftspark.plans.registry import query
from driftspark.sources import domain, readers


def _folder(spark, name):
    return (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


@query("src_customers", "SELECT customer_id, legal_name, segment FROM customers")
def src_customers(spark, d):
    """Customers of Europe from lines of single objects, the others from objects by id, of a hundred customers at most."""
    every = domain.customers(spark, d)
    rows = every.select("customer_id", "legal_name", "segment")
    plain, keyed = _folder(spark, "customers"), _folder(spark, "customers-keyed")
    every.where("region = 'EUROPE'").select(rows.columns).write.json(plain)
    entry = F.struct(F.col("customer_id").cast("string"), F.struct(*rows.columns))
    every.where("region <> 'EUROPE'").groupBy(F.floor(F.col("customer_id") / 100)).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value").write.text(keyed)
    return readers.collection(spark, plain, rows.schema, lines=True).unionByName(readers.collection(spark, keyed, rows.schema, keyed=True, lines=True))


@query("src_documents", "SELECT document_id, language, length(raw_text) AS chars FROM evidence")
def src_documents(spark, d):
    rows = domain.evidence(spark, d).select("document_id", "language", "raw_text")
    path = _folder(spark, "documents")
    rows.write.json(path)
    return readers.collection(spark, path, rows.schema, lines=True).select("document_id", "language", F.length("raw_text").cast("long").alias("chars"))


@query("src_collection_registry", "SELECT 'customers' AS collection, count(*) AS rows FROM customers UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'events', count(*) FROM ev")
def src_collection_registry(spark, d):
    every = {"customers": domain.customers(spark, d), "evidence": domain.evidence(spark, d), "events": domain.events(spark, d)}
    counts = [df.agg(F.lit(name).alias("collection"), F.count("*").alias("rows")) for name, df in every.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("src_artifacts", "SELECT concat('d', doc_id, CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.json' ELSE '.txt' END) AS name, CASE lang WHEN 'en' THEN 'text/markdown' WHEN 'de' THEN 'application/json' ELSE 'text/plain' END AS media_type, length(text) AS chars FROM documents")
def src_artifacts(spark, d):
    """Each document as an artifact of the name that its language gives it; here the files are rows, as they come from a reader of whole files."""
    name = F.concat(F.lit("d"), "doc_id", F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".json").otherwise(".txt"))
    files = domain.table(spark, d, "documents").select(F.concat(F.lit("artifacts/"), "source", F.lit("/"), name).alias("path"), F.col("text").alias("value"))
    return readers.described(files).select("name", "media_type", F.length("text").cast("long").alias("chars"))


@query("src_filings_feed", "SELECT o_custkey AS company, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filed, o_orderkey AS accession FROM orders")
def src_filings_feed(spark, d):
    o = domain.table(spark, d, "orders")
    row = F.struct("o_orderkey", F.col("o_orderpriority").alias("form"), F.col("o_orderdate").cast("date").alias("filed"))
    feed = o.groupBy(F.col("o_custkey").alias("company")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    feed = feed.select("company", F.col("rows.form").alias("form"), F.col("rows.filed").alias("filed"), F.col("rows.o_orderkey").alias("accession"))
    return readers.filings(feed)


@query("src_registry_records", "SELECT s_name AS domain, concat('H', s_suppkey) AS handle, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '2020-01-01' END AS changed, lower(s_name) || '.ns' AS servers, s_suppkey % 2 = 0 AS redacted FROM supplier")
def src_registry_records(spark, d):
    s = domain.table(spark, d, "supplier")
    action = F.when(F.col("s_suppkey") % 3 == 0, "registration").otherwise("last changed")
    record = F.to_json(F.struct(F.concat(F.lit("H"), "s_suppkey").alias("handle"), F.array(F.struct(action.alias("eventAction"), F.lit("2020-01-01").alias("eventDate"))).alias("events"), F.array(F.struct(F.concat("s_name", F.lit(".NS")).alias("ldhName"))).alias("nameservers"), F.array(F.struct(F.when(F.col("s_suppkey") % 2 == 0, "REDACTED for privacy").otherwise("none").alias("title"))).alias("remarks")))
    return readers.registry_records(s.select(F.col("s_name").alias("domain"), record.alias("record")))


@query("src_news_feed", "SELECT source_url AS url, title, published_at AS seen FROM evidence WHERE source_type = 'reputable_news'")
def src_news_feed(spark, d):
    e = domain.evidence(spark, d).where("source_type = 'reputable_news'")
    feed = e.groupBy("source_name").agg(F.collect_list(F.struct(F.col("source_url").alias("url"), "title", F.col("published_at").alias("seen"))).alias("articles"))
    return readers.articles(feed)


@query("sink_overwrite", "SELECT customer_id, risk_rating, NULL AS rejected FROM customers WHERE risk_rating <> 'low' UNION ALL SELECT NULL, NULL, concat('[', customer_id, ']') FROM customers WHERE risk_rating = 'low'")
def sink_overwrite(spark, d):
    """A collection whose lines are lists for customers of low risk: those are rejected, the others replace the version published before."""
    root, path = _folder(spark, "sink"), _folder(spark, "lines")
    rows = domain.customers(spark, d).select("customer_id", "risk_rating")
    readers.publish(rows, root)
    rows.select(F.when(F.col("risk_rating") == "low", F.format_string("[%d]", "customer_id")).otherwise(F.to_json(F.struct(*rows.columns)))).write.text(path)
    found = readers.checked(spark, path, rows.schema)
    readers.publish(found.where("row is not null").select("row.*"), root)
    kept = readers.published(spark, root, rows.schema).withColumn("rejected", F.lit(None).cast("string"))
    return kept.unionByName(found.where("rejected is not null").select("rejected"), allowMissingColumns=True)


@query("sink_by_pipeline", "SELECT source_type, count(*) AS documents FROM evidence GROUP BY 1")
def sink_by_pipeline(spark, d):
    rows = domain.evidence(spark, d).select("document_id", "source_type")
    return readers.overwrite(rows, _folder(spark, "sink"), ["source_type"]).groupBy("source_type").agg(F.count("*").alias("documents"))


# ---------------------------------------------------------------- between feeds and documents


@query("disc_news", "SELECT customer_id, document_id, nth FROM (SELECT customer_id, document_id, row_number() OVER (PARTITION BY customer_id ORDER BY document_id) AS nth FROM evidence WHERE (published_at IS NULL OR CAST(substr(published_at, 1, 10) AS DATE) >= DATE '2023-09-01') AND source_name IN ('src1', 'src2', 'src3', 'src4')) WHERE nth <= 2")
def disc_news(spark, d):
    host = F.parse_url("source_url", F.lit("HOST"))
    trusted = F.exists(F.array(*[F.lit(f"src{i}.example.com") for i in range(1, 5)]), lambda t: (host == t) | F.endswith(host, F.concat(F.lit("."), t)))
    fresh = F.coalesce(F.to_date(F.substring("published_at", 1, 10)) >= F.lit("2023-09-01").cast("date"), F.lit(True))
    return disc.top_per_key(domain.evidence(spark, d).where(fresh & trusted).select("customer_id", "document_id"), ["customer_id"], [F.asc("document_id")], 2)


@query("disc_regulator", "SELECT document_id, CASE WHEN contains(lower(raw_text), 'license') THEN 'selected' ELSE 'skipped' END AS status FROM evidence WHERE source_type = 'regulator'")
def disc_regulator(spark, d):
    score = tx.term_score(F.col("raw_text"), ["license"])
    return domain.evidence(spark, d).where("source_type = 'regulator'").select("document_id", F.when(score >= 1, "selected").otherwise("skipped").alias("status"))


@query("date_multi_format", "SELECT event_id, CASE event_id % 7 WHEN 1 THEN date_trunc('minute', ts) WHEN 4 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 5 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE WHEN 6 THEN NULL ELSE date_trunc('second', ts) END AS seen FROM ev")
def date_multi_format(spark, d):
    """The events' times as feeds write them, in seven forms, read back."""
    t = F.col("ts").cast("timestamp")
    forms = ["yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'+02:30'", "EEEE"]
    said = F.element_at(F.array(*[F.date_format(t, f) for f in forms]), (F.col("event_id") % 7 + 1).cast("int"))
    return domain.events(spark, d).select("event_id", tx.seen_at(said).cast("timestamp_ntz").alias("seen"))


@query("disc_registry_match", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'skipped' ELSE 'matched' END AS status FROM supplier")
def disc_registry_match(spark, d):
    s = domain.table(spark, d, "supplier").withColumn("registrant", F.when(F.col("s_suppkey") % 4 == 0, "Privacy service").otherwise(F.concat(F.upper("s_name"), F.lit(" Ltd"))))
    a, b = tx.normalize_name(F.col("registrant")), tx.normalize_name(F.col("s_name"))
    return s.select("s_suppkey", F.when(F.contains(a, b) | F.contains(b, a), "matched").otherwise("skipped").alias("status"))


@query("registry_jurisdiction", "SELECT page_id, CASE WHEN contains(url, '.example.com') THEN 'Commercial' WHEN contains(url, '.example.net') THEN 'Network' ELSE 'Unknown' END AS place FROM pages")
def registry_jurisdiction(spark, d):
    host = F.parse_url("url", F.lit("HOST"))
    return domain.table(spark, d, "pages").select("page_id", F.when(host.endswith(".com"), "Commercial").when(host.endswith(".net"), "Network").otherwise("Unknown").alias("place"))


@query("registry_summary", "SELECT s_suppkey, s_name || ' is registered in ' || n_name || ', last changed ' || CASE WHEN s_suppkey % 3 = 0 THEN 'not public' ELSE '2020-01-01' END AS summary FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def registry_summary(spark, d):
    s = domain.table(spark, d, "supplier").join(domain.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    changed = F.when(F.col("s_suppkey") % 3 != 0, "2020-01-01")
    return s.select("s_suppkey", F.concat("s_name", F.lit(" is registered in "), "n_name", F.lit(", last changed "), F.coalesce(changed, F.lit("not public"))).alias("summary"))


@query("registry_cache_fallback", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 1 THEN 'live' WHEN s_suppkey % 3 = 0 THEN 'cached' ELSE 'failed' END AS status FROM supplier")
def registry_cache_fallback(spark, d):
    s = domain.table(spark, d, "supplier").select("s_suppkey")
    live = s.where("s_suppkey % 4 <> 1").withColumn("live", F.lit(True))
    cached = s.where("s_suppkey % 3 = 0").withColumn("cached", F.lit(True))
    status = F.when(F.col("live"), "live").when(F.col("cached"), "cached").otherwise("failed")
    return s.join(live, "s_suppkey", "left").join(cached, "s_suppkey", "left").select("s_suppkey", status.alias("status"))


@query("pages_prune_html", f"SELECT page_id, length(h) AS chars, sha256(h) AS sha FROM (SELECT page_id, {pruned('html')} AS h FROM pages)")
def pages_prune_html(spark, d):
    return domain.table(spark, d, "pages").select("page_id", tx.prune_html(F.col("html")).alias("h")).select("page_id", F.length("h").cast("long").alias("chars"), F.sha2("h", 256).alias("sha"))


_META = [sql_date("regexp_extract(html, '" + p.removeprefix("(?i)").replace("'", "''") + "', 1, 'i')") for p in disc.META_DATES]


@query("pages_published_at", PAGES + f"SELECT page_id, coalesce({', '.join(_META)}, {sql_date('substr(text, 1, 2000)')}) AS day FROM pages JOIN vis USING (page_id)")
def pages_published_at(spark, d):
    # a generated column, so that the text is made once and not in every place that date_only reads it
    pages = domain.table(spark, d, "pages").select("page_id", "html", F.explode(F.array(tx.visible_text(F.col("html")))).alias("shown"))
    return pages.select("page_id", disc.published_at(F.col("html"), F.col("shown")).alias("day"))


@query("text_first_sentence_with", r""", s AS (SELECT document_id, list_filter(list_transform(string_split(regexp_replace(raw_text, '([.!?])\s+([A-Z0-9"''$])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda s: trim(s)), lambda s: length(s) >= 30) AS l, title FROM evidence)
SELECT document_id, substr(coalesce(list_filter(l, lambda x: contains(lower(x), 'license'))[1], title), 1, 450) AS sentence FROM s""")
def text_first_sentence_with(spark, d):
    hit = F.filter(tx.sentences(F.col("raw_text")), lambda s: F.contains(F.lower(s), F.lit("license")))
    return domain.evidence(spark, d).select("document_id", F.substring(F.coalesce(F.get(hit, F.lit(0)), F.col("title")), 1, 450).alias("sentence"))


@query("term_unique", "SELECT n_nationkey, n_name || '|other' AS terms FROM nation")
def term_unique(spark, d):
    rows = domain.table(spark, d, "nation").select("n_nationkey", F.posexplode(F.array("n_name", F.lower("n_name"), F.lit("other"), F.lit("x"), F.lit("OTHER"))).alias("pos", "term")).where("length(term) >= 2")
    first = disc.first_per_key(rows.withColumn("low", F.lower("term")), ["n_nationkey", "low"], [F.asc("pos")])
    kept = first.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return kept.select("n_nationkey", F.array_join(F.transform("t", lambda x: x["term"]), "|").alias("terms"))


@query("text_encoding_repair", "SELECT doc_id, sha256(text) AS sha FROM documents")
def text_encoding_repair(spark, d):
    """Every text in the reading of its bytes that is least broken."""
    return domain.table(spark, d, "documents").select("doc_id", F.sha2(tx.decoded(F.col("text")), 256).alias("sha"))


@query("field_inference", FACTS + "SELECT document_id, fact_type, CASE WHEN fact_type IN ('regulatory_scrutiny') THEN 'websites|risk_rating|business_area' ELSE 'websites' END AS fields FROM facts WHERE fact_type IN ('regulatory_scrutiny')")
def field_inference(spark, d):
    allowed = F.create_map(*[x for t, fs in rules.SIGNAL_FIELDS.items() for x in (F.lit(t), F.array(*map(F.lit, fs)))])
    found = ep.facts(spark, d).where("fact_type = 'regulatory_scrutiny'")
    return found.select("document_id", "fact_type", F.array_join(F.array_distinct(F.concat(F.array(F.lit("websites")), allowed[F.col("fact_type")])), "|").alias("fields"))


@query("sentence_quality", """SELECT document_id, CASE WHEN length(title) >= 160 THEN 3 WHEN length(title) >= 90 THEN 2 ELSE 0 END - CASE WHEN contains(title, '|') AND length(title) < 220 THEN 3 ELSE 0 END
+ CASE WHEN regexp_matches(lower(title), 'announced|entered into|has closed|has blocked access|investigates whether|operating without|disclosed|ha publicado|ha emitido|is currently available|is a global|is natively issued|redeemable') THEN 3 ELSE 0 END
- CASE WHEN regexp_matches(lower(title), 'skip to main content|ir al contenido|search / search|securities registered pursuant|pre-commencement communications|check the appropriate box| [|] (the guardian|el pa|cadena ser|actualidad|economia)') THEN 6 ELSE 0 END AS quality FROM evidence""")
def sentence_quality(spark, d):
    return domain.evidence(spark, d).select("document_id", ev.sentence_quality(F.col("title")).alias("quality"))


@query("document_build", "SELECT document_id, CASE WHEN length(raw_text) < 50 THEN 'failed' WHEN source_type = 'sec_filing' AND NOT contains(lower(raw_text), 'tion') THEN 'skipped' ELSE 'ok' END AS status FROM evidence")
def document_build(spark, d):
    short = F.length("raw_text") < 50
    weak = (F.col("source_type") == "sec_filing") & (tx.term_score(F.col("raw_text"), ["tion"]) < 1)
    return domain.evidence(spark, d).select("document_id", F.when(short, "failed").when(weak, "skipped").otherwise("ok").alias("status"))


@query("prompt_payload", """SELECT document_id, legal_name, length(substr(raw_text, 1, 7000)) AS chars FROM evidence JOIN customers USING (customer_id)""")
def prompt_payload(spark, d):
    c = domain.customers(spark, d).select("customer_id", "legal_name", "risk_rating")
    body = F.to_json(F.struct("document_id", "title", F.substring("raw_text", 1, 7000).alias("article"), F.struct("legal_name", "risk_rating").alias("baseline"), F.array(*map(F.lit, rules.SIGNAL_FIELDS)).alias("allowed")))
    sent = domain.evidence(spark, d).join(c, "customer_id").select("document_id", body.alias("payload"))
    return sent.select("document_id", F.get_json_object("payload", "$.baseline.legal_name").alias("legal_name"), F.length(F.get_json_object("payload", "$.article")).cast("long").alias("chars"))


@query("alert_provenance", ALERTS + "SELECT alert_id, fact_ids[1] AS first_fact, official FROM alerts")
def alert_provenance(spark, d):
    return ep.alerts(spark, d).select("alert_id", F.get("fact_ids", F.lit(0)).alias("first_fact"), "official")


@query("alert_order_ids", ALERTS + "SELECT alert_id, customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY signal_type, alert_id) AS number FROM alerts")
def alert_order_ids(spark, d):
    return ep.alerts(spark, d).select("alert_id", "customer_id", F.row_number().over(Window.partitionBy("customer_id").orderBy("signal_type", "alert_id")).alias("number"))


@query("policy_defaults", "SELECT n_name AS rm_id, CASE WHEN n_nationkey % 2 = 0 THEN 24 ELSE 48 END AS lookback_hours, CASE WHEN n_nationkey % 3 = 0 THEN 0.8 ELSE 0.7 END::DOUBLE AS minimum_confidence FROM nation")
def policy_defaults(spark, d):
    n = domain.table(spark, d, "nation")
    stored = n.select(F.col("n_name").alias("rm_id"), F.when(F.col("n_nationkey") % 2 == 1, 48).alias("hours"), F.when(F.col("n_nationkey") % 3 == 0, 0.8).alias("least"))
    return n.select(F.col("n_name").alias("rm_id")).join(stored, "rm_id", "left").select("rm_id", F.coalesce("hours", F.lit(24)).alias("lookback_hours"), F.coalesce("least", F.lit(0.7)).alias("minimum_confidence"))


@query("policy_validate", POLICIES.split("pe AS")[0].rstrip().rstrip(",") + " SELECT rm_id, CASE WHEN minimum_material_score > 120 THEN 'score_out_of_range' ELSE '' END AS errors FROM policies")
def policy_validate(spark, d):
    p = ep.policies(spark, d)
    known = F.array(*map(F.lit, rules.CATEGORY_POINTS))
    errors = F.array_compact(F.array(F.when(~F.col("minimum_confidence").between(0, 1), "confidence_out_of_range"), F.when(~F.col("minimum_material_score").between(0, 120), "score_out_of_range"), F.when(F.size(F.array_except("categories", known)) > 0, "unknown_category")))
    return p.select("rm_id", F.array_join(errors, "|").alias("errors"))


@query("own_curated", "SELECT s_suppkey, s_name AS holder, CASE WHEN s_suppkey % 2 = 0 THEN 'investor' ELSE 'unknown' END AS role, CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM supplier")
def own_curated(spark, d):
    s = domain.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("holder"), F.when(F.col("s_suppkey") % 2 == 0, "investor").alias("role"), F.when(F.col("s_suppkey") % 3 == 0, 0.5).alias("confidence"))
    return s.select("s_suppkey", "holder", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("confidence", F.lit(0.6)).alias("confidence"))


@query("play_content_diff", """, n AS (SELECT document_id, raw_text, CASE WHEN document_id % 3 = 0 THEN raw_text || chr(10) || 'A new worthless line' WHEN document_id % 3 = 1 THEN raw_text || chr(10) || 'A new line' ELSE raw_text END AS new FROM evidence)
SELECT document_id, len(list_filter(list_distinct(string_split(new, chr(10))), lambda l: NOT list_contains(string_split(raw_text, chr(10)), l))) AS lines, document_id % 3 = 0 AS material FROM n WHERE document_id % 3 <> 2""")
def play_content_diff(spark, d):
    added = F.when(F.col("document_id") % 3 == 0, "\nA new worthless line").when(F.col("document_id") % 3 == 1, "\nA new line").otherwise("")
    e = domain.evidence(spark, d).select("document_id", F.split("raw_text", "\n").alias("old"), F.split(F.concat("raw_text", added), "\n").alias("new"))
    changed = e.withColumn("changed", F.array_except("new", "old")).where("size(changed) > 0")
    return changed.select("document_id", F.size("changed").cast("long").alias("lines"), F.exists("changed", lambda x: F.contains(F.lower(x), F.lit("worthless"))).alias("material"))


@query("play_business_pivot", FACTS + "SELECT DISTINCT f.customer_id, 'MACHINERY' AS area FROM facts f JOIN customers c USING (customer_id) WHERE fact_type = 'business_activity_change' AND segment <> 'MACHINERY'")
def play_business_pivot(spark, d):
    found = ep.facts(spark, d).where("fact_type = 'business_activity_change'").select("customer_id", F.get(tx.split_values(F.col("object")), F.lit(0)).alias("area"))
    c = domain.customers(spark, d)
    return found.join(c.select("customer_id"), "customer_id", "left_semi").join(c.select("customer_id", F.col("segment").alias("area")), ["customer_id", "area"], "left_anti").distinct()
