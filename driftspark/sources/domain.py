"""Domain views over the driver's star schema: customers, transactions, activity baselines, evidence documents, actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Transactions before this day make up a customer's expected activity.
BASELINE_UNTIL = "1998-01-01"
#: The clock of the evidence feed and the customers' last review.
NOW, LAST_REVIEW = "2024-02-01 00:00:00", "2023-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        t("customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("legal_name"),
            F.col("n_name").alias("domicile"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.when(F.col("c_acctbal") < 0, "high").when(F.col("c_acctbal") < 5000, "medium").otherwise("low").alias("risk_rating"),
            F.lit(LAST_REVIEW).cast("date").alias("last_reviewed_at"),
        )
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line of an order. The large tables are joined first, while rows are narrow; suppliers and places, whose names are long, come last.

    Suppliers and places are joined one by one: Spark takes two joined tables for as large as their product and wouldn't broadcast them.
    """
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return (
        t("lineitem")
        .join(t("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_shipdate").cast("date").alias("booked_on"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
            F.when(F.col("l_linestatus") == "O", "out").otherwise("in").alias("direction"),
            F.col("s_suppkey").alias("counterparty_id"),
            F.col("s_name").alias("counterparty"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
            F.col("o_orderpriority").alias("rail"),
            F.col("p_type").alias("purpose"),
            F.col("p_brand").alias("asset"),
        )
    )


def activity_baselines(txns: DataFrame, until: str = BASELINE_UNTIL) -> DataFrame:
    """Per customer, from the transactions before a day: monthly volume and count, regions, purposes, largest payment."""
    before = txns.where(F.col("booked_on") < F.lit(until).cast("date"))
    return (
        before.groupBy("customer_id")
        .agg(
            F.sum("amount").alias("volume"),
            F.count("*").alias("payments"),
            F.count_distinct(F.trunc("booked_on", "month")).alias("months"),
            F.array_sort(F.collect_set("region")).alias("expected_regions"),
            F.array_sort(F.collect_set("purpose")).alias("expected_purposes"),
            F.max("amount").alias("single_payment"),
        )
        .select(
            "customer_id",
            (F.col("volume").cast("double") / F.col("months")).alias("expected_monthly_volume"),
            (F.col("payments") / F.col("months")).alias("expected_monthly_count"),
            "expected_regions",
            "expected_purposes",
            "single_payment",
            F.lit(2).alias("new_region_monthly_count"),
            F.lit(1.5).alias("volume_spike_multiplier"),
        )
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence documents: customer, source, dates (a date, an instant or neither, as text) and text."""
    every = table(spark, sf_dir, "customer").agg(F.greatest(F.floor(F.count("*") / 10), F.lit(1)).alias("spread"))
    d = F.date_format(F.date_add(F.lit("2023-03-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd")
    return (
        table(spark, sf_dir, "documents")
        .crossJoin(F.broadcast(every))
        .select(
            F.col("doc_id").alias("document_id"),
            (F.col("doc_id") % F.col("spread")).cast("long").alias("customer_id"),
            F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("doc_id") % 4 + 1).cast("int")).alias("source_quality"),
            F.element_at(F.array(*map(F.lit, ["regulator", "reputable_news", "company_newsroom", "blog", "sec_filing"])), (F.col("doc_id") % 5 + 1).cast("int")).alias("source_type"),
            F.col("source").alias("source_name"),
            F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id")).alias("source_url"),
            F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 2 == 0, d).otherwise(F.concat(d, F.lit("T12:00:00Z"))).alias("published_at"),
            F.lit("2024-01-31T18:00:00Z").alias("collected_at"),
            F.col("lang").alias("language"),
            F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 180).alias("title"),
            F.substring(F.split_part("text", F.lit("\n"), F.lit(2)), 1, 300).alias("evidence_excerpt"),
            F.col("text").alias("raw_text"),
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
