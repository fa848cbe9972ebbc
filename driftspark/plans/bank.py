"""Queries over the customers' transactions and the transfer graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftspark.operators import bank, chain
from driftspark.plans.evidence import _NORM
from driftspark.plans.registry import query
from driftspark.sources import domain
from driftspark.sources.tables import store


def _txns(spark, d):
    return domain.transactions(spark, d)


def _recent(spark, d):
    return _txns(spark, d).where(F.col("booked_on") >= F.lit(domain.BASELINE_UNTIL).cast("date"))


def _base(spark, d):
    return domain.activity_baselines(_txns(spark, d))


@query("txn_observed_vs_expected", """SELECT customer_id, observed, round(observed / months, 2) AS observed_monthly, round(expected_monthly_volume, 2) AS expected_monthly_volume, round(observed / months / expected_monthly_volume, 6) AS ratio
FROM (SELECT customer_id, CAST(sum(amount) AS DOUBLE) AS observed, count(DISTINCT date_trunc('month', booked_on)) AS months FROM recent GROUP BY 1) JOIN baselines USING (customer_id)""")
def txn_observed_vs_expected(spark, d):
    out = bank.observed_vs_expected(_recent(spark, d), _base(spark, d))
    return out.withColumns({"observed_monthly": F.round("observed_monthly", 2), "expected_monthly_volume": F.round("expected_monthly_volume", 2), "ratio": F.round("ratio", 6)})


@query("sig_volume_spike", """SELECT customer_id, CAST(month AS DATE) AS month, volume, volume > expected_monthly_volume * 1.5 AS by_volume, largest > single_payment AS by_payment
FROM (SELECT customer_id, date_trunc('month', booked_on) AS month, CAST(sum(amount) AS DOUBLE) AS volume, max(amount) AS largest FROM recent GROUP BY 1, 2) JOIN baselines USING (customer_id)
WHERE volume > expected_monthly_volume * 1.5 OR largest > single_payment""")
def sig_volume_spike(spark, d):
    return bank.volume_spikes(_recent(spark, d), _base(spark, d))


@query("sig_new_region", """SELECT customer_id, region, CAST(date_trunc('month', booked_on) AS DATE) AS month, count(*) AS payments FROM recent JOIN baselines USING (customer_id)
WHERE NOT list_contains(expected_regions, region) GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def sig_new_region(spark, d):
    return bank.new_regions(_recent(spark, d), _base(spark, d))


@query("sig_profile_mismatch", """SELECT customer_id, purpose, count(*) AS payments, CAST(sum(amount) AS DOUBLE) AS volume FROM recent JOIN baselines USING (customer_id)
WHERE NOT list_contains(expected_purposes, purpose) GROUP BY 1, 2""")
def sig_profile_mismatch(spark, d):
    return bank.profile_mismatch(_recent(spark, d), _base(spark, d))


def _watch(spark, d):
    names = domain.table(spark, d, "supplier").where("s_suppkey % 50 = 7").select(F.lit("name").alias("kind"), F.col("s_name").alias("value"))
    return names.unionByName(domain.table(spark, d, "nation").where("n_nationkey in (3, 11)").select(F.lit("country").alias("kind"), F.col("n_name").alias("value")))


@query("sig_screening_review", """, hits AS (SELECT customer_id, 'name' AS hit, amount FROM recent WHERE counterparty_id % 50 = 7
UNION ALL SELECT customer_id, 'country', amount FROM recent WHERE country IN ('NATION_3', 'NATION_11'))
SELECT customer_id, hit, count(*) AS payments, CAST(sum(amount) AS DOUBLE) AS volume FROM hits GROUP BY 1, 2""")
def sig_screening_review(spark, d):
    return bank.screening(_recent(spark, d), _watch(spark, d))


@query("sig_linked_entity_flow", """, own AS (SELECT DISTINCT c_custkey AS customer_id, s_suppkey FROM customer JOIN supplier ON s_suppkey % 20 = c_custkey % 20)
SELECT customer_id, trim(regexp_replace(lower(counterparty), '[^a-z0-9]+', ' ', 'g')) AS party, direction, count(*) AS payments, CAST(sum(amount) AS DOUBLE) AS volume
FROM recent WHERE counterparty_id % 20 = customer_id % 20 GROUP BY 1, 2, 3""")
def sig_linked_entity_flow(spark, d):
    firms = domain.table(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("group"), F.upper("s_name").alias("entity"))
    groups = domain.table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 20).alias("group"))
    return bank.linked_entity_flow(_recent(spark, d), firms, groups)


@query("sig_dormancy_break", """, daily AS (SELECT customer_id, booked_on, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS volume FROM txns GROUP BY 1, 2),
m AS (SELECT customer_id, booked_on, date_diff('day', lag(booked_on) OVER w, booked_on) AS gap, sum(n) OVER (w RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAYS FOLLOWING) AS burst,
  sum(volume) OVER (w RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAYS FOLLOWING) AS burst_volume FROM daily WINDOW w AS (PARTITION BY customer_id ORDER BY booked_on))
SELECT customer_id, booked_on, CAST(gap AS INT) AS gap, CAST(burst AS BIGINT) AS burst, round(burst_volume, 2) AS burst_volume FROM m WHERE gap >= 120 AND burst >= 2""")
def sig_dormancy_break(spark, d):
    return bank.dormancy_breaks(_txns(spark, d), 120, 30, 2).withColumn("burst_volume", F.round("burst_volume", 2))


@query("play_negative_news_spike", """, e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts)) AS s FROM ev WHERE event_type = 'error'),
w AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS last_day,
  count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 2678399 PRECEDING AND 86400 PRECEDING) AS before FROM e)
SELECT user_id, event_id, last_day, before FROM w WHERE last_day >= 2 AND last_day > before / 30 * 3""")
def play_negative_news_spike(spark, d):
    bad = domain.events(spark, d).where("event_type = 'error'")
    return bank.adverse_spikes(bad, "user_id", "ts", 3.0, 2).select("user_id", "event_id", "last_day", "before")


@query("play_cross_border_high_value", """SELECT r.customer_id, country, rail, count(*) AS payments, CAST(max(amount) AS DOUBLE) AS largest FROM recent r JOIN baselines USING (customer_id) JOIN customers c USING (customer_id)
WHERE country <> domicile AND amount >= CAST(single_payment AS DOUBLE) * 0.9 GROUP BY 1, 2, 3""")
def play_cross_border_high_value(spark, d):
    home = domain.customers(spark, d).select("customer_id", "domicile").join(_base(spark, d).select("customer_id", F.col("single_payment").cast("double").alias("single_payment")), "customer_id")
    return bank.high_value_cross_border(_recent(spark, d), home, 0.9)


@query("play_linked_cluster", """, paid AS (SELECT DISTINCT counterparty_id, customer_id, booked_on FROM recent r WHERE
(SELECT count(*) FROM txns t WHERE t.customer_id = r.customer_id AND t.booked_on < r.booked_on AND t.booked_on >= r.booked_on - INTERVAL 90 DAYS) <= 3)
SELECT a.counterparty_id, a.booked_on, count(DISTINCT b.customer_id) AS customers FROM (SELECT DISTINCT counterparty_id, booked_on FROM paid) a JOIN paid b ON a.counterparty_id = b.counterparty_id
AND abs(date_diff('day', a.booked_on, b.booked_on)) <= 2 GROUP BY 1, 2 HAVING count(DISTINCT b.customer_id) >= 2""")
def play_linked_cluster(spark, d):
    """Clusters of payments by customers with at most three payments of any kind in the 90 days before."""
    # no payment looks back further than 90 days before the first of the recent ones
    past = _txns(spark, d).where(F.col("booked_on") >= F.date_sub(F.lit(domain.BASELINE_UNTIL).cast("date"), 90))
    return bank.linked_clusters(_recent(spark, d), 2, 2, past, 90, 3)


@query("play_identity_change", """, n AS (SELECT *, CASE WHEN customer_id % 10 = 0 THEN legal_name || ' AG' ELSE legal_name END AS nn, CASE WHEN customer_id % 15 = 0 THEN NULL ELSE domicile END AS nd FROM customers)
SELECT customer_id, 'legal_name' AS field, legal_name AS before, nn AS after FROM n WHERE legal_name IS DISTINCT FROM nn UNION ALL SELECT customer_id, 'domicile', domicile, nd FROM n WHERE domicile IS DISTINCT FROM nd""")
def play_identity_change(spark, d):
    old = domain.customers(spark, d)
    renamed = F.when(F.col("customer_id") % 10 == 0, F.concat("legal_name", F.lit(" AG"))).otherwise(F.col("legal_name"))
    new = old.withColumns({"legal_name": renamed, "domicile": F.when(F.col("customer_id") % 15 == 0, None).otherwise(F.col("domicile"))})
    return bank.identity_changes(old, new, "customer_id", ["legal_name", "domicile"])


_HOLD = "SELECT DISTINCT customer_id, counterparty AS holder FROM txns WHERE amount > 90000 AND booked_on {} DATE '1998-01-01'"


@query("play_ownership_change", f""", o AS ({_HOLD.format('<')}), n AS ({_HOLD.format('>=')})
SELECT *, 'added' AS change FROM (FROM n EXCEPT FROM o) UNION ALL SELECT *, 'removed' FROM (FROM o EXCEPT FROM n)""")
def play_ownership_change(spark, d):
    big = _txns(spark, d).where("amount > 90000").select("customer_id", F.col("counterparty").alias("holder"), "booked_on")
    cut = F.lit(domain.BASELINE_UNTIL).cast("date")
    part = lambda c: big.where(c).drop("booked_on").distinct()
    return bank.holder_changes(part(F.col("booked_on") < cut), part(F.col("booked_on") >= cut))


@query("play_scale_change", """, q AS (SELECT customer_id, CAST(date_trunc('quarter', booked_on) AS DATE) AS quarter, CAST(sum(amount) AS DOUBLE) AS volume, count(DISTINCT region) AS regions FROM recent GROUP BY 1, 2),
w AS (SELECT *, lag(volume) OVER w AS before, regions - lag(regions) OVER w AS new_regions FROM q WINDOW w AS (PARTITION BY customer_id ORDER BY quarter))
SELECT customer_id, quarter, volume, before, new_regions FROM w WHERE volume >= before * 3""")
def play_scale_change(spark, d):
    return bank.scale_changes(_recent(spark, d), 3.0)


@query("expanded_profile", """, s AS (SELECT customer_id, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(amount AS DOUBLE), 0.95) AS p95, CAST(sum(amount) AS DOUBLE) AS observed FROM recent GROUP BY 1)
SELECT customer_id, round(expected_monthly_volume, 2) AS expected_monthly_volume, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p95 * 1.25, 2) AS review_threshold, coalesce(observed, 0.0) AS observed FROM baselines LEFT JOIN s USING (customer_id)""")
def expanded_profile(spark, d):
    out = bank.expanded_profile(_recent(spark, d), _base(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in ("p50", "p95")} | {"expected_monthly_volume": F.round("expected_monthly_volume", 2), "review_threshold": F.round("review_threshold", 2)})


_BLOCK = "list_sort(list_transform(list_filter(string_split(" + _NORM + ", ' '), lambda w: w <> ''), lambda w: {{'n': -length(w), 'w': w}}))[1].w"


@query("resolution_score", f"""SELECT s_suppkey, c.customer_id, round(least(1.0, 1 - levenshtein(replace(s_name, 'Supplier', 'Customer'), legal_name) / greatest(length(replace(s_name, 'Supplier', 'Customer')), length(legal_name)) + CASE WHEN n_name = domicile THEN 0.1 ELSE 0.0 END), 4) AS score,
CASE WHEN score >= 0.9 THEN 'high_confidence_review' WHEN score >= 0.75 THEN 'medium_confidence_review' ELSE 'rejected_weak_match' END AS status
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customers c ON {_BLOCK.format('s_name')} = {_BLOCK.format('legal_name')}""")
def resolution_score(spark, d):
    firms = domain.table(spark, d, "supplier").join(domain.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    firms = firms.select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"), F.col("n_name").alias("place"), bank.name_block(F.col("s_name")).alias("block"))
    known = domain.customers(spark, d).select("customer_id", F.col("legal_name").alias("known_name"), F.col("domicile").alias("known_place"), bank.name_block(F.col("legal_name")).alias("block"))
    return bank.resolution_scores(firms, known).select("s_suppkey", "customer_id", "score", "status")


@query("watchlist_screen", f""", w AS (SELECT s_name AS entry, CASE WHEN s_acctbal < 0 THEN 'sanctions' ELSE 'exposed' END AS list_name, unnest([{{'known': s_name, 'kind': 'exact'}}, {{'known': replace(s_name, 'Supplier', 'The Customer') || ' Ltd', 'kind': 'alias'}}]) AS s FROM supplier WHERE s_suppkey % 25 = 4),
listed AS (SELECT DISTINCT entry, list_name, s.kind AS kind, {_NORM.format('s.known')} AS known_key, {_BLOCK.format('s.known')} AS block FROM w),
parties AS (SELECT customer_id, 'customer' AS party, legal_name AS name, 0 AS payments FROM customers UNION ALL SELECT customer_id, 'counterparty', counterparty, count(*) FROM recent GROUP BY customer_id, counterparty),
keyed AS (SELECT *, {_NORM.format('name')} AS party_key, {_BLOCK.format('name')} AS block FROM parties),
found AS (SELECT k.*, entry, list_name, CASE WHEN party_key = known_key THEN kind ELSE 'near' END AS reason, CASE WHEN party_key = known_key THEN CASE kind WHEN 'exact' THEN 1.0 ELSE 0.95 END ELSE round(1 - levenshtein(party_key, known_key) / greatest(length(party_key), length(known_key)), 4) END::DOUBLE AS score FROM keyed k JOIN listed l ON k.block = l.block OR (k.block IS NOT NULL AND l.block IS NOT NULL AND levenshtein(party_key, known_key) <= 2))
SELECT customer_id, party, payments, entry, list_name, reason, score FROM found WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY customer_id, party, name, entry, list_name ORDER BY score DESC, reason DESC) = 1""")
def watchlist_screen(spark, d):
    """Customers' own names and the parties they paid or were paid by, against entries of two lists, each with an alias."""
    listed = F.when(F.col("s_acctbal") < 0, "sanctions").otherwise("exposed")
    alias = F.concat(F.replace("s_name", F.lit("Supplier"), F.lit("The Customer")), F.lit(" Ltd"))
    entries = domain.table(spark, d, "supplier").where("s_suppkey % 25 = 4").select(F.col("s_name").alias("entry"), listed.alias("list_name"), F.array(alias).alias("aliases"))
    own = domain.customers(spark, d).select("customer_id", F.lit("customer").alias("party"), F.col("legal_name").alias("name"), F.lit(0).cast("long").alias("payments"))
    others = _recent(spark, d).groupBy("customer_id", F.lit("counterparty").alias("party"), F.col("counterparty").alias("name")).agg(F.count("*").alias("payments"))
    return bank.screen_names(store(own.unionByName(others), "parties"), entries).drop("name")


# ---------------------------------------------------------------- transfers

_TRANSFERS = """, t AS (SELECT booked_on AS ts, customer_id AS sender, 1000000 + counterparty_id AS receiver, asset, region AS chain, amount FROM txns)
"""


def _transfers(spark, d):
    return _txns(spark, d).select(F.col("booked_on").alias("ts"), F.col("customer_id").alias("sender"), (F.lit(1_000_000) + F.col("counterparty_id")).alias("receiver"), "asset", F.col("region").alias("chain"), "amount")


def _listed(spark, d, condition):
    return domain.table(spark, d, "supplier").where(condition).select((F.lit(1_000_000) + F.col("s_suppkey")).alias("address"))


@query("chain_sanctioned", _TRANSFERS + "SELECT sender, 'receiver' AS side, count(*) AS transfers, CAST(sum(amount) AS DOUBLE) AS volume FROM t WHERE (receiver - 1000000) % 40 = 1 GROUP BY 1")
def chain_sanctioned(spark, d):
    hit = chain.touching(_transfers(spark, d), _listed(spark, d, "s_suppkey % 40 = 1"))
    return hit.groupBy("sender", "side").agg(F.count("*").alias("transfers"), F.sum("amount").cast("double").alias("volume"))


@query("chain_mixer", _TRANSFERS + """, b AS (SELECT sender, CAST(ts AS DATE) AS window_start, count(*) OVER w AS transfers, CAST(sum(amount) OVER w AS DOUBLE) AS volume FROM t WHERE amount < 50000 AND receiver % 5 = 0
WINDOW w AS (PARTITION BY sender ORDER BY CAST(ts AS DATE) RANGE BETWEEN CURRENT ROW AND INTERVAL 89 DAYS FOLLOWING)) SELECT DISTINCT sender, window_start, transfers, volume FROM b WHERE transfers >= 2""")
def chain_mixer(spark, d):
    return chain.structuring(_transfers(spark, d), _listed(spark, d, "s_suppkey % 5 = 0"), 50_000, 90, 2)


@query("chain_bridge", _TRANSFERS + """SELECT a.sender AS address, a.chain AS in_chain, b.chain AS out_chain, count(*) AS crossings FROM t a JOIN t b ON a.sender = b.sender AND a.chain <> b.chain
AND date_diff('day', a.ts, b.ts) BETWEEN 0 AND 30 AND abs(CAST(b.amount AS DOUBLE) - CAST(a.amount AS DOUBLE)) <= CAST(a.amount AS DOUBLE) * 0.2 GROUP BY 1, 2, 3""")
def chain_bridge(spark, d):
    return chain.bridges(_transfers(spark, d).withColumn("amount", F.col("amount").cast("double")), 30, 0.2)


@query("chain_unusual_volume", _TRANSFERS + """, w AS (SELECT sender, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(sum(amount) AS DOUBLE) AS volume FROM t GROUP BY 1, 2),
s AS (SELECT *, avg(volume) OVER p AS mean, stddev_samp(volume) OVER p AS sd, count(*) OVER p AS n FROM w WINDOW p AS (PARTITION BY sender ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
m AS (SELECT sender AS address, asset, CAST(ts AS DATE) AS day, -amount AS amount FROM t UNION ALL SELECT receiver, asset, CAST(ts AS DATE), amount FROM t),
d AS (SELECT address, asset, day, sum(amount) AS amount FROM m GROUP BY 1, 2, 3 HAVING sum(amount) <> 0),
b AS (SELECT address, asset, day, sum(amount) OVER (PARTITION BY address, asset ORDER BY day) AS balance, lead(day) OVER (PARTITION BY address, asset ORDER BY day) AS until FROM d),
h AS (SELECT x.address, x.asset, x.day, x.balance, sum(y.balance) AS total FROM b x JOIN b y ON x.asset = y.asset AND y.balance > 0 AND y.day <= x.day AND (y.until IS NULL OR y.until > x.day) GROUP BY 1, 2, 3, 4)
SELECT 'weekly_spike' AS pattern, sender AS address, NULL AS asset, week AS day, volume AS amount, round((volume - mean) / sd, 3) AS measure FROM s WHERE n >= 3 AND sd > 0 AND volume > mean + 2.5 * sd
UNION ALL SELECT 'large_holder', address, asset, day, CAST(balance AS DOUBLE), round(CAST(balance AS DOUBLE) / CAST(total AS DOUBLE), 6) FROM h WHERE CAST(balance AS DOUBLE) / CAST(total AS DOUBLE) >= 0.1
UNION ALL SELECT 'busy_day', sender, NULL, CAST(ts AS DATE), CAST(sum(amount) AS DOUBLE), count(*) FROM t GROUP BY 2, 4 HAVING count(*) >= 3 OR sum(amount) >= 150000""")
def chain_unusual_volume(spark, d):
    """Three patterns: weeks far over the sender's mean (measure: z), holders of a tenth of an asset (the share), days of many or large transfers (their number)."""
    transfers = store(_transfers(spark, d).drop("chain"), "transfers")
    row = lambda df, pattern, address, asset, day, amount, measure: df.select(F.lit(pattern).alias("pattern"), F.col(address).alias("address"), asset.alias("asset"), F.col(day).alias("day"), F.col(amount).cast("double").alias("amount"), measure.cast("double").alias("measure"))
    none = F.lit(None).cast("string")
    spikes = row(chain.unusual_volume(transfers, 8, 2.5), "weekly_spike", "sender", none, "week", "volume", F.round("z", 3))
    holders = row(chain.large_holders(transfers, 0.1), "large_holder", "address", F.col("asset"), "day", "balance", F.round("share", 6))
    return spikes.unionByName(holders).unionByName(row(chain.frequent_days(transfers, 3, 150_000), "busy_day", "sender", none, "day", "volume", F.col("transfers")))


@query("chain_privacy_asset", _TRANSFERS + "SELECT asset, count(*) AS transfers, count(DISTINCT sender) AS senders FROM t WHERE asset IN ('Brand#1', 'Brand#7', 'Brand#13') GROUP BY 1")
def chain_privacy_asset(spark, d):
    return _transfers(spark, d).where(F.col("asset").isin("Brand#1", "Brand#7", "Brand#13")).groupBy("asset").agg(F.count("*").alias("transfers"), F.count_distinct("sender").alias("senders"))


@query("chain_contract_abuse", _TRANSFERS + """, b AS (SELECT sender, receiver, CAST(ts AS DATE) AS window_start, count(*) OVER (PARTITION BY sender, receiver ORDER BY CAST(ts AS DATE) RANGE BETWEEN CURRENT ROW AND INTERVAL 364 DAYS FOLLOWING) AS calls FROM t),
f AS (SELECT transaction_id, customer_id AS sender, 1000000 + counterparty_id AS receiver, CAST(booked_on AS DATE) AS day, CAST(amount AS DOUBLE) AS amount, direction FROM txns)
SELECT DISTINCT 'repeated_calls' AS pattern, sender, receiver, window_start, calls FROM b WHERE calls >= 2
UNION ALL SELECT 'borrow_repay', i.sender, i.receiver, i.day, count(*) FROM f i JOIN f o ON i.sender = o.sender AND i.receiver = o.receiver AND i.direction = 'in' AND o.direction = 'out'
AND date_diff('day', i.day, o.day) BETWEEN 0 AND 365 AND abs(o.amount - i.amount) <= i.amount * 0.25 GROUP BY i.sender, i.receiver, i.day""")
def chain_contract_abuse(spark, d):
    flow = _txns(spark, d).select(F.col("booked_on").alias("ts"), F.col("customer_id").alias("sender"), (F.lit(1_000_000) + F.col("counterparty_id")).alias("receiver"), F.col("amount").cast("double").alias("amount"), "direction")
    flow = store(flow, "flow")
    calls = chain.repeated_calls(flow, 365, 2).withColumn("pattern", F.lit("repeated_calls"))
    loans = chain.repaid_loans(flow.where("direction = 'in'"), flow.where("direction = 'out'"), 365, 0.25)
    return calls.unionByName(loans.withColumnRenamed("repayments", "calls").withColumn("pattern", F.lit("borrow_repay")))


@query("chain_high_risk_link", _TRANSFERS + """, l AS (SELECT 1000000 + s_suppkey AS a FROM supplier WHERE s_suppkey % 40 = 1),
h1 AS (SELECT DISTINCT sender AS a FROM t WHERE receiver IN (FROM l)),
h2 AS (SELECT DISTINCT receiver AS a FROM t WHERE sender IN (FROM h1) AND receiver NOT IN (FROM l))
SELECT a AS address, 0 AS hops FROM l UNION ALL SELECT a, 1 FROM h1 UNION ALL SELECT a, 2 FROM h2""")
def chain_high_risk_link(spark, d):
    return chain.within_hops(_transfers(spark, d), _listed(spark, d, "s_suppkey % 40 = 1"), 2)


@query("chain_flash_loan", _TRANSFERS + "SELECT sender, receiver, CAST(amount AS DOUBLE) AS amount, ts FROM t WHERE amount > 95000 AND receiver % 3 = 0")
def chain_flash_loan(spark, d):
    big = _transfers(spark, d).where("amount > 95000").join(_listed(spark, d, "(s_suppkey + 1000000) % 3 = 0").withColumnRenamed("address", "receiver"), "receiver", "left_semi")
    return big.select("sender", "receiver", F.col("amount").cast("double").alias("amount"), "ts")
