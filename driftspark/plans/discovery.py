"""Queries over pages, documents and candidate sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark.functions import text as tx
from driftspark.operators import dictionaries
from driftspark.operators import discovery as disc
from driftspark.plans.registry import query
from driftspark.sources import domain

QUERY_TERMS, RULE_TERMS = ["tion", "ment", "achlich"], ["license", "worthless", "idiot"]
_WS = r"[\s\x{00A0}\x{0085}\x0b\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Elements that the given pages may hide; a regular expression without back-references names each.
_HIDDEN = "div span p section table ul li a"


def pruned(html):
    out = html
    for tag in ("ix:header", "ix:hidden"):
        out = rf"regexp_replace({out}, '<{tag}\b.*?</{tag}>', ' ', 'gsi')"
    for tag in _HIDDEN.split():
        out = rf"""regexp_replace({out}, '<{tag}\b[^>]*style=["''][^"'']*display\s*:\s*none[^"'']*["''][^>]*>.*?</{tag}>', ' ', 'gsi')"""
    return out


def sql_date(c):
    """date_only in SQL."""
    months = tx.MONTHS.split()
    named = rf"'({'|'.join(months)})\s+(\d{{1,2}}),\s+(\d{{4}})'"
    at = lambda i: f"regexp_extract({c}, {named}, {i}, 'i')"
    month = "CASE lower(" + at(1) + ") " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate(months, 1)) + " END"
    us = r"'\b(\d{1,2})/(\d{1,2})/(\d{4})\b'"
    n = lambda i: f"regexp_extract({c}, {us}, {i})"
    return rf"""coalesce(nullif(regexp_extract({c}, '\d{{4}}-\d{{2}}-\d{{2}}'), ''), CASE WHEN {at(3)} <> '' THEN {at(3)} || '-' || {month} || '-' || lpad({at(2)}, 2, '0') END,
CASE WHEN {n(3)} <> '' THEN {n(3)} || '-' || lpad({n(1)}, 2, '0') || '-' || lpad({n(2)}, 2, '0') END)"""


def _visible(html):
    out = rf"regexp_replace({pruned(html)}, '<!--.*?-->', '', 'gs')"
    for tag in tx.SKIP_TAGS:
        out = rf"regexp_replace({out}, '<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'gsi')"
    out = rf"regexp_replace({out}, '</?({'|'.join(tx.BLOCK_TAGS)})\b[^>]*>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'gs')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


PAGES = rf""", lines AS (SELECT page_id, url, list_filter(list_transform(string_split({_visible('html')}, chr(10)), lambda x: trim(regexp_replace(x, '{_WS}', ' ', 'g'))), lambda x: x <> '') AS l FROM pages),
vis AS (SELECT page_id, url, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)) AS text FROM lines)
"""
_TERM = lambda c, terms: " + ".join(f"CAST((length(lower({c})) - length(replace(lower({c}), '{t}', ''))) / {len(t)} AS INT) * {3 if ' ' in t or len(t) > 8 else 1}" for t in terms)
SENTENCES = r""", sen AS (SELECT document_id, unnest(list_filter(list_transform(string_split(regexp_replace(raw_text, '([.!?])\s+([A-Z0-9"''$])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda s: trim(s)), lambda s: length(s) >= 30)) AS sentence,
  generate_subscripts(list_filter(list_transform(string_split(regexp_replace(raw_text, '([.!?])\s+([A-Z0-9"''$])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda s: trim(s)), lambda s: length(s) >= 30), 1) - 1 AS pos FROM evidence)
"""


@query("pages_visible_text", PAGES + "SELECT page_id, length(text) AS chars, sha256(text) AS sha FROM vis")
def pages_visible_text(spark, d):
    text = tx.visible_text(F.col("html"))
    return domain.table(spark, d, "pages").select("page_id", text.alias("text")).select("page_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"))


@query("pages_title", PAGES + r"""SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(regexp_extract(html, '<title\b[^>]*>(.*?)</title>', 1, 'si'), '<[^>]*>', '', 'g')), 1, 180), ''),
nullif(substr(trim(regexp_replace(regexp_extract(html, '<h1\b[^>]*>(.*?)</h1>', 1, 'si'), '<[^>]*>', '', 'g')), 1, 180), ''), nullif(substr(text, 1, 90), ''), 'Untitled source') AS title FROM pages JOIN vis USING (page_id)""")
def pages_title(spark, d):
    return domain.table(spark, d, "pages").select("page_id", disc.title(F.col("html")).alias("title"))


LINKS = r""", a AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a\b[^>]*href="[^"#]*"[^>]*>.*?</a>', 0, 'si')) AS a FROM pages),
l AS (SELECT page_id, page_url, regexp_extract(a, 'href="([^"#]*)"', 1, 'si') AS h, trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS anchor FROM a),
links AS (SELECT page_id, page_url, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '/') THEN regexp_extract(page_url, '^(https?://[^/]+)', 1) || h END AS url, anchor FROM l)
"""


@query("pages_links", LINKS + "SELECT page_id, url, anchor, count(*) AS n FROM links WHERE url IS NOT NULL GROUP BY 1, 2, 3")
def pages_links(spark, d):
    return disc.links(domain.table(spark, d, "pages")).groupBy("page_id", "url", "anchor").agg(F.count("*").alias("n"))


@query("disc_site_links", LINKS + """, s AS (SELECT page_id, url, (length(lower(anchor)) - length(replace(lower(anchor), 'th', ''))) // 2 AS score FROM links WHERE url IS NOT NULL), b AS (SELECT page_id, url, max(score) AS score FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS nth FROM b WHERE score >= 1) SELECT page_id, url, CAST(score AS INT) AS score, nth FROM r WHERE nth <= 3""")
def disc_site_links(spark, d):
    every = disc.links(domain.table(spark, d, "pages")).withColumn("score", tx.term_score(F.col("anchor"), ["th"]))
    best = every.groupBy("page_id", "url").agg(F.max("score").alias("score")).where("score >= 1")
    return disc.top_per_key(best, ["page_id"], [F.desc("score"), F.asc("url")], 3)


@query("disc_page_changes", PAGES + ", st AS (SELECT url, CASE WHEN page_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS sha FROM vis WHERE page_id % 5 <> 0) SELECT v.url, sha256(text) AS sha256, st.sha IS NULL AS first_seen FROM vis v LEFT JOIN st USING (url) WHERE st.sha IS DISTINCT FROM sha256(text)")
def disc_page_changes(spark, d):
    pages = domain.table(spark, d, "pages")
    state = pages.where("page_id % 5 <> 0").select("url", F.when(F.col("page_id") % 4 == 0, "old").otherwise(F.sha2(tx.visible_text(F.col("html")), 256)).alias("sha256"))
    return disc.page_changes(pages, state)[0]


@query("text_normalize", rf"SELECT doc_id, length(n) AS chars, sha256(n) AS sha FROM (SELECT doc_id, trim(regexp_replace(replace(replace(text, '&nbsp;', ' '), '&amp;', '&'), '{_WS}', ' ', 'g')) AS n FROM documents)")
def text_normalize(spark, d):
    plain = domain.table(spark, d, "documents").select("doc_id", tx.normalize_space(F.col("text")).alias("n"))
    return plain.select("doc_id", F.length("n").cast("long").alias("chars"), F.sha2("n", 256).alias("sha"))


@query("text_sentences", SENTENCES + "SELECT document_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM sen GROUP BY 1")
def text_sentences(spark, d):
    each = domain.evidence(spark, d).select("document_id", F.explode(tx.sentences(F.col("raw_text"))).alias("s"))
    return each.groupBy("document_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


@query("term_score", f"SELECT doc_id, {_TERM('text', QUERY_TERMS + RULE_TERMS)} AS score FROM documents")
def term_score(spark, d):
    return domain.table(spark, d, "documents").select("doc_id", tx.term_score(F.col("text"), QUERY_TERMS + RULE_TERMS).alias("score"))


@query("evidence_rank", SENTENCES + f""", sc AS (SELECT *, 3 * ({_TERM('sentence', QUERY_TERMS)}) + {_TERM('sentence', RULE_TERMS)} AS signal, CASE WHEN length(sentence) >= 160 THEN 3 WHEN length(sentence) >= 90 THEN 2 ELSE 0 END - CASE WHEN contains(sentence, '|') AND length(sentence) < 220 THEN 3 ELSE 0 END AS quality,
  lag(sentence) OVER w AS before, lead(sentence) OVER w AS after FROM sen WINDOW w AS (PARTITION BY document_id ORDER BY pos)),
r AS (SELECT *, signal * 3 + quality AS total, row_number() OVER (PARTITION BY document_id ORDER BY signal * 3 + quality DESC, signal DESC, quality DESC, length(sentence) DESC, pos DESC) AS nth FROM sc)
SELECT document_id, CAST(pos AS INT) AS pos, total, CASE WHEN length(sentence) > 520 THEN substr(sentence, 1, 517) || '...' ELSE sentence END AS excerpt, CASE WHEN length(concat_ws(' ', before, sentence, after)) > 1600 THEN substr(concat_ws(' ', before, sentence, after), 1, 1597) || '...' ELSE concat_ws(' ', before, sentence, after) END AS context FROM r WHERE nth = 1""")
def evidence_rank(spark, d):
    return disc.rank_evidence(domain.evidence(spark, d), QUERY_TERMS, RULE_TERMS)


@query("date_normalize", f"SELECT doc_id, {sql_date('text')} AS day FROM documents")
def date_normalize(spark, d):
    return domain.table(spark, d, "documents").select("doc_id", tx.date_only(F.col("text")).alias("day"))


@query("name_normalize", r"SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || ' and sons' AS plain FROM customer")
def name_normalize(spark, d):
    return domain.table(spark, d, "customer").select("c_custkey", tx.normalize_name(F.concat(F.lit("The "), "c_name", F.lit(" & Sons, Pte. Ltd. Group"))).alias("plain"))


@query("name_normalize_plain", r"SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS plain FROM supplier")
def name_normalize_plain(spark, d):
    return domain.table(spark, d, "supplier").select("s_suppkey", tx.normalize_name(F.col("s_name"), ()).alias("plain"))


@query("fuzzy_member", "SELECT customer_id, contains(lower(domicile), 'nation 1') OR starts_with(domicile, 'NATION_1') AS member FROM customers")
def fuzzy_member(spark, d):
    return domain.customers(spark, d).select("customer_id", tx.fuzzy_member(F.lit("nation-1"), F.array("domicile", "segment")).alias("member"))


@query("value_split", "SELECT n_nationkey, n_name || '|' || 'x y' AS parts FROM nation")
def value_split(spark, d):
    return domain.table(spark, d, "nation").select("n_nationkey", F.array_join(tx.split_values(F.concat("n_name", F.lit(" ;; | x y ;"))), "|").alias("parts"))


@query("watch_terms", "SELECT customer_id, term FROM (SELECT customer_id, unnest([legal_name, domicile || ' ' || segment]) AS term FROM customers)")
def watch_terms(spark, d):
    return domain.customers(spark, d).select("customer_id", F.explode(F.array("legal_name", F.concat_ws(" ", "domicile", "segment"))).alias("term"))


@query("entity_match", f"SELECT document_id, {_TERM('raw_text', ['tion', 'license'])} + CASE WHEN contains(split_part(split_part(source_url, '//', 2), '/', 1), source_name) THEN 3 ELSE 0 END AS score FROM evidence")
def entity_match(spark, d):
    host = F.when(F.contains(F.parse_url("source_url", F.lit("HOST")), F.col("source_name")), 3).otherwise(0)
    return domain.evidence(spark, d).select("document_id", (tx.term_score(F.col("raw_text"), ["tion", "license"]) + host).alias("score"))


@query("confidence_hint", f"""SELECT document_id, CASE WHEN source_quality IN ('A', 'B') AND m >= 3 AND r >= 6 THEN 'high' WHEN source_quality IN ('A', 'B', 'C') AND (m >= 1 OR r >= 3) THEN 'medium' ELSE 'low' END AS hint
FROM (SELECT *, {_TERM('raw_text', ['license'])} AS m, {_TERM('raw_text', ['tion'])} AS r FROM evidence)""")
def confidence_hint(spark, d):
    e = domain.evidence(spark, d).withColumns({"entity_match": tx.term_score(F.col("raw_text"), ["license"]), "retrieval": tx.term_score(F.col("raw_text"), ["tion"])})
    return e.select("document_id", disc.confidence_hint().alias("hint"))


@query("quote_grounding", r"""SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(trim(regexp_replace(lower(documents.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(benchmark.text), '\s+', ' ', 'g')))""")
def quote_grounding(spark, d):
    return disc.grounded_pairs(domain.table(spark, d, "documents").select("doc_id", "text"), domain.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))).select("doc_id", "item_id")


@query("jurisdiction_extract", """, names AS (SELECT r_regionkey AS position, r_name AS label FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation)
SELECT customer_id, string_agg(label, '|' ORDER BY position) AS found FROM customers LEFT JOIN names ON regexp_matches(concat_ws(', ', legal_name, region, domicile), '(^|[^A-Za-z0-9])' || label || '($|[^A-Za-z0-9])') GROUP BY 1""")
def jurisdiction_extract(spark, d):
    """Regions and nations named in a customer's record, by the dictionary of all their names in the order of the tables; null where there is none."""
    region, nation = domain.table(spark, d, "region"), domain.table(spark, d, "nation")
    names = region.select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("label")).unionByName(nation.select((F.col("n_nationkey") + 100).alias("position"), F.col("n_name").alias("label")))
    texts = domain.customers(spark, d).select("customer_id", F.concat_ws(", ", "legal_name", "region", "domicile").alias("text"))
    found = dictionaries.labels_found(texts, "customer_id", "text", names.withColumn("phrase", F.col("label")))
    return texts.select("customer_id").join(found, "customer_id", "left").select("customer_id", F.array_join("found", "|").alias("found"))


@query("source_dedupe", "SELECT source_name, source_type, min(document_id) AS document_id FROM evidence GROUP BY 1, 2")
def source_dedupe(spark, d):
    return disc.first_per_key(domain.evidence(spark, d), ["source_name", "source_type"], [F.asc("document_id")]).select("source_name", "source_type", "document_id")


@query("source_merge", "SELECT document_id, min(o) AS pipeline FROM (SELECT document_id, 1 AS o FROM evidence WHERE source_quality = 'A' UNION ALL SELECT document_id, 2 FROM evidence WHERE source_type = 'regulator' UNION ALL SELECT document_id, 3 FROM evidence WHERE document_id % 3 = 0) GROUP BY 1")
def source_merge(spark, d):
    e = domain.evidence(spark, d)
    parts = [e.where("source_quality = 'A'"), e.where("source_type = 'regulator'"), e.where("document_id % 3 = 0")]
    every = [p.select("document_id", F.lit(i + 1).alias("pipeline")) for i, p in enumerate(parts)]
    return disc.first_per_key(every[0].unionByName(every[1]).unionByName(every[2]), ["document_id"], [F.asc("pipeline")])


@query("disc_filings", "SELECT customer_id, document_id, nth FROM (SELECT customer_id, document_id, row_number() OVER (PARTITION BY customer_id ORDER BY document_id) AS nth FROM evidence JOIN customers USING (customer_id) WHERE source_type IN ('sec_filing', 'regulator') AND CAST(substr(published_at, 1, 10) AS DATE) >= last_reviewed_at AND document_id % 11 <> 0) WHERE nth <= 2")
def disc_filings(spark, d):
    e = domain.evidence(spark, d)
    seen = e.where("document_id % 11 = 0").select("source_url")
    fresh = e.join(domain.customers(spark, d).select("customer_id", "last_reviewed_at"), "customer_id").where(F.col("source_type").isin("sec_filing", "regulator") & (F.to_date(F.substring("published_at", 1, 10)) >= F.col("last_reviewed_at")))
    return disc.top_per_key(fresh.join(seen, "source_url", "left_anti").select("customer_id", "document_id"), ["customer_id"], [F.asc("document_id")], 2)


@query("disc_direct", "SELECT document_id, source_url FROM evidence WHERE document_id % 11 <> 0 AND source_quality = 'B'")
def disc_direct(spark, d):
    e = domain.evidence(spark, d)
    return e.where("source_quality = 'B'").join(e.where("document_id % 11 = 0").select("source_url"), "source_url", "left_anti").select("document_id", "source_url")


@query("collect_join", "SELECT document_id, CASE WHEN c.customer_id IS NULL THEN 'failed' ELSE 'ok' END AS status FROM evidence e LEFT JOIN customers c ON c.customer_id = e.customer_id AND c.customer_id % 4 <> 0")
def collect_join(spark, d):
    known = domain.customers(spark, d).where("customer_id % 4 <> 0").select("customer_id", F.lit("ok").alias("found"))
    return domain.evidence(spark, d).join(known, "customer_id", "left").select("document_id", F.coalesce("found", F.lit("failed")).alias("status"))


@query("trace_summary", "SELECT customer_id, count(*) AS documents, count(*) FILTER (source_quality IN ('A', 'B')) AS good, count(DISTINCT source_type) AS types, array_to_string(list_sort(list(DISTINCT source_quality)), '|') AS qualities FROM evidence GROUP BY 1")
def trace_summary(spark, d):
    return domain.evidence(spark, d).groupBy("customer_id").agg(F.count("*").alias("documents"), F.count_if(F.col("source_quality").isin("A", "B")).alias("good"), F.count_distinct("source_type").alias("types"), F.array_join(F.array_sort(F.collect_set("source_quality")), "|").alias("qualities"))


@query("sink_replace_by_key", "SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM evidence")
def sink_replace_by_key(spark, d):
    e = domain.evidence(spark, d).select("document_id", "source_url")
    new = e.where("document_id % 3 = 0").withColumn("version", F.lit("new"))
    return disc.replace_by_key(e.withColumn("version", F.lit("old")), new, "source_url").select("document_id", "version")
