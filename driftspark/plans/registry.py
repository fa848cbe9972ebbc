"""Registered queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The domain views of driftspark.sources.domain in SQL; each query's SQL selects from them.
VIEWS = r"""WITH customers AS (
  SELECT c_custkey AS customer_id, c_name AS legal_name, n_name AS domicile, r_name AS region, c_mktsegment AS segment,
    CASE WHEN c_acctbal < 0 THEN 'high' WHEN c_acctbal < 5000 THEN 'medium' ELSE 'low' END AS risk_rating, DATE '2023-06-01' AS last_reviewed_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
txns AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS transaction_id, o_custkey AS customer_id, CAST(l_shipdate AS DATE) AS booked_on,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_linestatus = 'O' THEN 'out' ELSE 'in' END AS direction,
    s_suppkey AS counterparty_id, s_name AS counterparty, n_name AS country, r_name AS region, o_orderpriority AS rail, p_type AS purpose, p_brand AS asset
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
baselines AS (
  SELECT customer_id, CAST(sum(amount) AS DOUBLE) / count(DISTINCT date_trunc('month', booked_on)) AS expected_monthly_volume,
    count(*) / count(DISTINCT date_trunc('month', booked_on)) AS expected_monthly_count,
    list_sort(list(DISTINCT region)) AS expected_regions, list_sort(list(DISTINCT purpose)) AS expected_purposes, max(amount) AS single_payment,
    2 AS new_region_monthly_count, 1.5 AS volume_spike_multiplier
  FROM txns WHERE booked_on < DATE '1998-01-01' GROUP BY customer_id),
recent AS (SELECT * FROM txns WHERE booked_on >= DATE '1998-01-01'),
evidence AS (
  SELECT doc_id AS document_id, doc_id % (SELECT greatest(count(*) // 10, 1) FROM customer) AS customer_id, ['A','B','C','D'][doc_id % 4 + 1] AS source_quality,
    ['regulator','reputable_news','company_newsroom','blog','sec_filing'][doc_id % 5 + 1] AS source_type, source AS source_name,
    concat('https://', source, '.example.com/', doc_id) AS source_url,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN strftime(DATE '2023-03-01' + CAST(doc_id % 400 AS INT), '%Y-%m-%d')
      ELSE strftime(DATE '2023-03-01' + CAST(doc_id % 400 AS INT), '%Y-%m-%d') || 'T12:00:00Z' END AS published_at,
    '2024-01-31T18:00:00Z' AS collected_at, lang AS language, substr(split_part(text, chr(10), 1), 1, 180) AS title, substr(split_part(text, chr(10), 2), 1, 300) AS evidence_excerpt, text AS raw_text
  FROM documents),
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
"""


def query(name: str, sql: str | None = None, views: str = VIEWS):
    """Register a function of (spark, sf_dir); sql continues the views' WITH clause (', x AS (...) SELECT') or is a SELECT."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = views + sql
        return f

    return add
