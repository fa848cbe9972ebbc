"""Ownership records and the public profile that rolls everything up per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ownership_records(*parts: DataFrame) -> DataFrame:
    """Records(customer_id, holder, role, impact, percent, confidence) of several origins, numbered within the customer."""
    out = parts[0].withColumn("origin", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("origin", F.lit(i)), allowMissingColumns=True)
    w = Window.partitionBy("customer_id").orderBy("origin", "holder", "role")
    return out.withColumn("confidence", F.round("confidence", 2)).withColumn("number", F.row_number().over(w))


def ownership_summary(records: DataFrame) -> DataFrame:
    """Per customer: records, those with control, those without a stated stake, and by impact."""
    n = lambda c: F.count_if(c)
    return records.groupBy("customer_id").agg(
        F.count("*").alias("records"), n(F.col("role") == "owner").alias("controlling"), n(F.col("percent").isNull()).alias("unknown_stake"), n(F.col("impact") == "high").alias("high_impact")
    )


def questions(records: DataFrame) -> DataFrame:
    """Up to four questions of a customer, from any-match conditions, else a default one."""
    cases = [(F.bool_or(F.col("percent").isNull()), "What is the stake?"), (F.bool_or(F.col("impact") == "high"), "Who has control?"), (F.bool_or(F.col("role") == "lender"), "What are the terms?")]
    asked = records.groupBy("customer_id").agg(*[c.alias(f"q{i}") for i, (c, _) in enumerate(cases)])
    found = F.slice(F.array_compact(F.array(*[F.when(F.col(f"q{i}"), q) for i, (_, q) in enumerate(cases)])), 1, 4)
    return asked.select("customer_id", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Any change in holders?"))).alias("questions"))


def rollup(watch: DataFrame, records: DataFrame) -> DataFrame:
    """Every watched customer with its summary and nested records, also those without any."""
    nested = records.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("number", "holder", "role"))).alias("holders"))
    out = watch.join(ownership_summary(records), "customer_id", "left").join(nested, "customer_id", "left")
    return out.fillna(0, ["records", "controlling", "unknown_stake", "high_impact"])


def completeness(profile: DataFrame, sections: list[str]) -> DataFrame:
    """Share of non-empty sections, with the missing ones."""
    filled = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    missing = F.array_compact(F.array(*[F.when(~filled(c), c) for c in sections]))
    return profile.withColumn("missing", missing).withColumn("completeness", F.round(1 - F.size("missing") / len(sections), 4))
