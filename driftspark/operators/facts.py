"""Facts of documents from ladders of rules, their confidence, and their numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions import ladders, rules
from driftspark.sources.tables import store

def named_jurisdictions(text: Column, names: tuple[str, ...], patterns: dict[str, tuple[str, ...]]) -> Column:
    """Those of the names whose patterns a text has, whatever the case, in the patterns' order. Words end where Unicode's do, on every JVM: \\b isn't inside "dieß"."""
    each = [F.when(text.rlike("(?iU)" + "|".join(p)), name) for name, p in patterns.items() if name in names]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def _has(term: str) -> Column:
    if term.startswith("source:"):
        return F.coalesce(F.col("source_type") == term.removeprefix("source:"), F.lit(False))
    if term.startswith("title:"):
        return F.contains(F.col("_title"), F.lit(term.removeprefix("title:").lower()))
    return F.contains(F.col("_low"), F.lit(term.lower()))


def _filled(template: str, obj: Column) -> Column:
    out = F.replace(F.lit(template), F.lit("{object}"), obj) if "{object}" in template else F.lit(template)
    return F.replace(out, F.lit("{name}"), F.coalesce("legal_name", F.lit(""))) if "{name}" in template else out


def _row(rule: ladders.FactRule, nth: int, patterns: dict) -> Column:
    """A rule as an expression: its fact where it holds, else null."""
    holds = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(_has, clause)) for clause in rule.when])
    obj, where = F.lit(rule.object), F.lit(rule.jurisdiction).cast("string")
    if rule.capture:
        holds = holds & F.col("_text").rlike(rule.capture)
        obj = F.regexp_replace(F.trim(F.regexp_extract("_text", rule.capture, 1)), r"\.+$", "")
    if rule.among:
        found = [named_jurisdictions(F.col("_text"), rule.among, patterns), *[F.array_compact(F.array(F.when(_has(t), v))) for t, v in rule.added]]
        found = F.array_distinct(F.concat(*found))
        holds = holds & (F.size(found) > 0)
        obj = where = F.array_join(found, "; ")
    fields = F.array(*map(F.lit, rule.fields or rules.SIGNAL_FIELDS[rule.fact_type]))
    flags = [F.lit(v).alias(n) for n, v in (("direct", int(rule.direct)), ("ambiguous", int(rule.ambiguous)), ("derived", int(rule.derived)), ("rule", nth))]
    return F.when(holds, F.struct(F.lit(rule.fact_type).alias("fact_type"), obj.alias("object"), _filled(rule.value, obj).alias("value"), where.alias("jurisdiction"), fields.alias("fields"), *flags))


def confidence() -> Column:
    """A rule fact's confidence, in decimals: its source's quality and what speaks for it and against."""
    dec = lambda x: F.lit(x).cast("decimal(4,2)")
    points = lambda c, x: F.when(c, dec(x)).otherwise(dec("0"))
    quality = F.create_map(*[x for k, v in rules.FACT_QUALITY.items() for x in (F.lit(k), dec(v))])
    named = lambda c: F.exists("_names", lambda n: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), n))
    total = F.coalesce(F.try_element_at(quality, F.col("source_quality")), dec("0.35")) + points(named("title") & named("evidence_excerpt"), "0.05") + F.col("direct") * dec("0.05")
    total = total - points(F.col("source_type") == "reputable_news", "0.10") - F.col("ambiguous") * dec("0.15") - F.col("derived") * dec("0.06") - points(F.coalesce("published_at", F.lit("")) == "", "0.03")
    return F.greatest(dec("0"), F.least(dec("1"), total)).cast("decimal(4,2)")


#: What a document needs for a rule fact to be kept.
LEAST_CONFIDENCE = 0.45


def ladder_facts(documents: DataFrame, profiles: DataFrame, rule_rows: list[ladders.FactRule] = ladders.FACT_LADDERS, patterns: dict = ladders.JURISDICTIONS) -> DataFrame:
    """Facts of documents with a profile: for each fact type the first row of its ladder that holds. ``kept`` is false without an excerpt or enough confidence.

    documents(document_id, customer_id, source_quality, source_type, source_name, source_url, published_at, title, evidence_excerpt, raw_text),
    profiles(customer_id, legal_name, aliases), one row a customer. The text is title, excerpt and raw text with white space folded. All ladders
    are one expression over it, made once a document, whatever the number of rules; ``rule`` is the row's number in its ladder, from 1.
    """
    kinds: dict[str, list[Column]] = {}
    for rule in rule_rows:
        rungs = kinds.setdefault(rule.fact_type, [])
        rungs.append(_row(rule, len(rungs) + 1, patterns))
    first = [F.coalesce(*rungs) for rungs in kinds.values()]
    names = F.filter(F.transform(F.concat(F.array("legal_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: F.lower(n)), lambda n: n != "")
    with_names = documents.join(profiles.select("customer_id", "legal_name", names.alias("_names")), "customer_id")
    text = F.trim(F.regexp_replace(F.concat_ws(" ", "title", "evidence_excerpt", "raw_text"), r"(?U)\s+", " "))
    read = with_names.withColumn("_text", text).withColumns({"_low": F.lower("_text"), "_title": F.lower(F.coalesce("title", F.lit("")))})
    found = read.withColumn("f", F.explode(F.array_compact(F.array(*first))))
    about = ["document_id", "customer_id", "source_quality", "source_type", "source_name", "source_url", "published_at", "title", "evidence_excerpt"]
    out = found.select(*about, F.col("legal_name").alias("subject"), "_names", "f.*").withColumn("confidence", confidence()).drop("_names")
    return out.withColumn("kept", (F.trim(F.coalesce("evidence_excerpt", F.lit(""))) != "") & (F.col("confidence") >= LEAST_CONFIDENCE))


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with their place, from 1 without gaps, in a total order. No task sees more than a range of the rows.

    Rows are dealt by ranges of the order and sorted inside them; each range's rows are numbered from the sum of the ranges before it.
    The order should be unique: ties are numbered in any order.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id()
    dealt = store(dealt.select("*", F.shiftright(inside, 33).cast("int").alias("_range"), inside.bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")), "numbered")
    # one row for each range, as many as there are shuffle partitions
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = sizes.select("_range", F.expr("coalesce(sum(_rows) over (order by _range rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    return dealt.join(before, "_range").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_range", "_nth", "_before")
