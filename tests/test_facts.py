"""The fact ladders on planted sentences: each row once, in order, and what confidence and numbering say."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftspark.functions import ladders
from driftspark.operators import facts

# (fact type, number of the row that must hold, text, title, source type); a text has what its row needs and nothing of the rows before it.
PLANTED = [
    ("ownership_change", 1, "The acquisition of Bitstamp has closed."),
    ("ownership_change", 2, "An agreement to acquire NinjaTrader was signed."),
    ("ownership_change", 3, "It will acquire  Northern Light & Power, Inc... and so on"),
    ("new_subsidiary", 1, "See the list of Bitstamp Legal Entities below."),
    ("new_jurisdiction", 1, "Bitstamp is licensed in Luxembourg, the BVI and the UK."),
    ("new_jurisdiction", 2, "xStocks are issued in Jersey to non-U.S. persons under a Bermuda licence."),
    ("new_jurisdiction", 3, "Garantex works in Russia."),
    ("new_jurisdiction", 4, "British American Tobacco sold to the DPRK."),
    ("new_jurisdiction", 5, "coinbase.au: trademark owner is a company", "", "domain_rdap"),
    ("business_activity_change", 1, "A prediction market opened."),
    ("business_activity_change", 2, "It buys a global cryptocurrency exchange."),
    ("business_activity_change", 3, "It buys a futures trading platform."),
    ("business_activity_change", 4, "Garantex is a virtual currency exchange."),
    ("business_activity_change", 5, "British American Tobacco and North Korea."),
    ("business_activity_change", 6, "coinbase.au has a trademark owner", "", "domain_rdap"),
    ("business_activity_change", 7, "Alphabet expands its AI infrastructure."),
    ("digital_asset_activity", 1, "Nothing in the text.", "Purchase of Bitcoin announced"),
    ("digital_asset_activity", 2, "Bitcoin as a treasury reserve asset."),
    ("digital_asset_activity", 3, "It pledged portion of its digital assets as collateral."),
    ("digital_asset_activity", 4, "Bitcoin and other crypto holdings face regulatory uncertainty."),
    ("digital_asset_activity", 5, "Tokenized equities trade there."),
    ("digital_asset_activity", 6, "It settles with stablecoins like USDC and EURC."),
    ("digital_asset_activity", 7, "USDC is for global payments."),
    ("digital_asset_activity", 8, "Circle Mint opens."),
    ("digital_asset_activity", 9, "It offers crypto-assets services."),
    ("digital_asset_activity", 10, "Garantex deals in virtual currencies."),
    ("treasury_policy_change", 1, "Bitcoin is a treasury reserve asset now."),
    ("treasury_policy_change", 2, "It purchased 4,710 Bitcoin."),
    ("treasury_policy_change", 3, "A covered-call strategy was begun."),
    ("regulatory_scrutiny", 1, "Garantex was sanctioned."),
    ("regulatory_scrutiny", 2, "British American Tobacco reached a settlement about North Korea."),
    ("regulatory_scrutiny", 3, "The CFTC issued an order."),
    ("regulatory_scrutiny", 4, "Un expediente sancionador."),
    ("jurisdiction_restriction", 1, "Garantex is in the Russian Federation under E.O. 14024."),
    ("jurisdiction_restriction", 2, "British American Tobacco in North Korea."),
    ("jurisdiction_restriction", 3, "It runs without a gambling licence."),
    ("new_product", 1, "The Circle Payments Network is live."),
    ("new_product", 2, "Circle Mint is live."),
    ("new_product", 3, "Nothing in the text.", "USDC news"),
    ("new_product", 4, "xStocks are live."),
    ("new_product", 5, "Google sells the AI chip."),
    ("public_listing", 1, "Investor relations of Circle Internet Group."),
    ("commercial_opportunity", 1, "Bitcoin as treasury reserve asset."),
    ("commercial_opportunity", 2, "The Circle Payments Network grows."),
    ("commercial_opportunity", 3, "Circle Mint grows."),
    ("commercial_opportunity", 4, "USDC global payments grow."),
    ("commercial_opportunity", 5, "Google Cloud grows."),
    ("domain_registration", 1, "coinbase.au: Registrant name Coinbase", "", "domain_rdap"),
    ("risk_rating_review", 1, "coinbase.au: trademark owner", "", "domain_rdap"),
    ("risk_rating_review", 2, "Garantex and ransomware."),
    ("risk_rating_review", 3, "British American Tobacco and WMD."),
    ("risk_rating_review", 4, "Increased regulatory scrutiny is likely."),
    ("risk_rating_review", 5, "A covered-call strategy on digital assets."),
]
DOCUMENT = "document_id long, customer_id long, source_quality string, source_type string, source_name string, source_url string, published_at string, title string, evidence_excerpt string, raw_text string"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([(1, "Acme Corp", ["Acme", ""]), (2, None, None)], "customer_id long, legal_name string, aliases array<string>")


def test_each_row_of_each_ladder_holds_in_order(spark, profiles):
    sizes = Counter(r.fact_type for r in ladders.FACT_LADDERS)
    assert [(k, n) for k, n, *_ in PLANTED] == [(k, n) for k, size in sizes.items() for n in range(1, size + 1)]
    rows = [(i, 1, "A", (*p, "", "blog")[4] if len(p) > 4 else "blog", "s", "u", "2024-01-01", p[3] if len(p) > 3 else "", ".", p[2]) for i, p in enumerate(PLANTED)]
    found = {(r.document_id, r.fact_type): r for r in facts.ladder_facts(documents(spark, rows), profiles).collect()}
    for i, (kind, nth, *_) in enumerate(PLANTED):
        assert (i, kind) in found, PLANTED[i]
        row, rule = found[i, kind], [r for r in ladders.FACT_LADDERS if r.fact_type == kind][nth - 1]
        assert row.rule == nth and row.subject == "Acme Corp", PLANTED[i]
        if "{object}" not in rule.object:
            assert (row.object, row.value, row.jurisdiction) == (rule.object, rule.value, rule.jurisdiction)
    text = lambda kind, nth: found[[p[:2] for p in PLANTED].index((kind, nth)), kind]
    caught = text("ownership_change", 3)
    assert caught.object == "Northern Light & Power, Inc... and so on" and caught.ambiguous == 1
    assert caught.value == "Acme Corp announced an acquisition involving Northern Light & Power, Inc... and so on."
    assert text("new_jurisdiction", 1).jurisdiction == text("new_jurisdiction", 1).object == "United Kingdom; Luxembourg; British Virgin Islands"
    assert text("new_jurisdiction", 2).object == "Bermuda; Jersey; non-U.S. clients"
    assert text("new_jurisdiction", 5).fields == ["known_jurisdictions", "risk_rating"]


def test_a_row_that_finds_nothing_gives_way_to_the_next(spark, profiles):
    rows = [(1, 1, "A", "blog", "s", "u", None, None, "x", "Bitstamp; the BERMUDA office; Garantex in russia"), (2, 1, "A", "blog", "s", "u", None, None, "x", "bitstamp alone; Garantex in russia"), (3, 1, "A", "blog", "s", "u", None, None, "x", "coinbase.au trademark owner")]
    found = {r.document_id: r.object for r in facts.ladder_facts(documents(spark, rows), profiles).where("fact_type = 'new_jurisdiction'").collect()}
    assert found == {1: "Bermuda", 2: "Russia"}  # and a guard on the source keeps the third out


def test_confidence_and_what_is_kept(spark, profiles):
    text = "The Circle Mint by ACME"
    rows = [
        (1, 1, "A", "blog", "s", "u", "2024-01-01", "Acme news", "about acme corp", text),
        (2, 1, "A", "reputable_news", "s", "u", None, "Acme news", "about others", text),
        (3, 2, "D", "reputable_news", "s", "u", "2024-01-01", "t", "e", text),
        (4, 1, "A", "blog", "s", "u", "2024-01-01", "t", "  ", text),
        (5, 9, "A", "blog", "s", "u", "2024-01-01", "t", "e", text),
        (6, 1, None, "blog", "s", "u", "", None, None, None),
    ]
    found = {r.document_id: (float(r.confidence), r.kept) for r in facts.ladder_facts(documents(spark, rows), profiles).where("fact_type = 'new_product'").collect()}
    assert found == {1: (0.95, True), 2: (0.77, True), 3: (0.30, False), 4: (0.90, False)}


def test_numbers_have_no_gap_and_follow_the_order(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("a"), (F.col("id") % 3).alias("b")).repartition(7)
    got = facts.numbered(rows, ["b", "a"]).collect()
    assert [(r.b, r.a) for r in sorted(got, key=lambda r: r.number)] == sorted((r.b, r.a) for r in got)
    assert sorted(r.number for r in got) == list(range(1, 5001))
    assert facts.numbered(rows.limit(0), ["b", "a"]).collect() == []


def test_ladders_over_another_vocabulary():
    rule = ladders.FactRule("t", (("a", "title:a", "source:a"),), "o", "v", added=(("a", "shown"),))
    assert ladders.with_terms([rule], {"a": "b", "t": "z"}) == [rule._replace(when=(("b", "title:b", "source:b"),), added=(("b", "shown"),))]
