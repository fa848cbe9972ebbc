"""Documents to facts, facts against the baseline, and the alerts that come of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions import rules
from driftspark.functions.text import any_of, fuzzy_member, lookup, normalize_name, split_values


def rule_facts(documents: DataFrame, rule_rows: list[tuple] = rules.FACT_RULES) -> DataFrame:
    """Facts of documents: for each fact type the first rule by priority whose words a document has. The ladder is one expression, without a join."""
    low = F.lower(F.concat_ws(" ", "title", "raw_text"))
    ladders: dict[str, Column] = {}
    for kind, priority, some, none, obj, value, where, direct, ambiguous, derived in sorted(rule_rows, key=lambda r: (r[0], -r[1])):
        fact = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in (("fact_type", kind, "string"), ("priority", priority, "int"), ("object", obj, "string"), ("value", value, "string"), ("jurisdiction", where, "string"), ("direct", direct, "int"), ("ambiguous", ambiguous, "int"), ("derived", derived, "int"))])
        hit = any_of(F.col("_low"), some) & ~any_of(F.col("_low"), none)
        ladders[kind] = F.when(hit, fact).otherwise(ladders[kind]) if kind in ladders else F.when(hit, fact)
    found = documents.withColumn("_low", low).withColumn("f", F.explode(F.array_compact(F.array(*ladders.values())))).drop("_low")
    return with_confidence(found.select("document_id", "customer_id", "source_quality", "source_type", "source_name", "source_url", "published_at", "collected_at", "title", "f.*"))


def with_confidence(facts: DataFrame) -> DataFrame:
    """Extraction confidence from the source's quality and the fact's flags, in decimals, and a key of the business columns."""
    dec = lambda x: F.lit(x).cast("decimal(4,2)")
    base = dec("0.35")
    for k, v in rules.FACT_QUALITY.items():
        base = F.when(F.col("source_quality") == k, dec(v)).otherwise(base)
    score = base + F.col("direct") * dec("0.05")
    score = score - F.when(F.col("source_type") == "reputable_news", dec("0.10")).otherwise(dec("0")) - F.col("ambiguous") * dec("0.15") - F.col("derived") * dec("0.06")
    score = score - F.when(F.col("published_at").isNull(), dec("0.03")).otherwise(dec("0"))
    score = F.greatest(dec("0"), F.least(dec("1"), score)).cast("decimal(4,2)")
    return facts.withColumns({"confidence": score, "fact_id": F.concat_ws("|", "document_id", "fact_type")})


def expected_gate(facts: DataFrame, documents: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Facts whose type their document expects, after aliases."""
    wanted = documents.select("document_id", F.explode("expected").alias("t")).withColumn("fact_type", F.coalesce(lookup("t", aliases), F.col("t"))).select("document_id", "fact_type").distinct()
    return facts.join(wanted, ["document_id", "fact_type"], "left_semi")


def model_precedence(model_facts: DataFrame, rule_facts_: DataFrame) -> DataFrame:
    """Model facts, and the rules' of types the model didn't find in a document."""
    rest = rule_facts_.join(model_facts.select("document_id", "fact_type").distinct(), ["document_id", "fact_type"], "left_anti")
    return model_facts.withColumn("method", F.lit("model")).unionByName(rest.withColumn("method", F.lit("rule")), allowMissingColumns=True)


def field_values(facts: DataFrame) -> DataFrame:
    """One row per fact and field with the candidate values."""
    fields = F.array()
    for kind, names in rules.SIGNAL_FIELDS.items():
        fields = F.when(F.col("fact_type") == kind, F.array(*map(F.lit, names))).otherwise(fields)
    each = facts.withColumn("field", F.explode(fields))
    review = F.array(F.concat(F.lit("Review due to "), F.col("object")))
    values = F.when(F.col("field") == "known_jurisdictions", split_values(F.coalesce("jurisdiction", "object"))).when(F.col("field") == "risk_rating", review).when(F.col("field") == "entity_type", F.array("object")).otherwise(split_values(F.col("object")))
    return each.withColumn("candidates", values)


def materiality() -> Column:
    t, low = F.col("fact_type"), F.lower("object")
    high = t.isin("regulatory_scrutiny", "jurisdiction_restriction", "ownership_change", "risk_rating_review") | ((t == "treasury_policy_change") & F.contains(low, F.lit("bitcoin")))
    return F.when(high, "high").when(t.isin("commercial_opportunity", "public_listing"), "low").otherwise("medium")


def compare(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Facts against profiles(customer_id, last_reviewed_at, baseline: map field -> values): changed fields, values, flags.

    A scalar field always asks for a review; of a list field the candidates that fuzzy membership doesn't find are new.
    """
    each = field_values(facts).join(profiles, "customer_id")
    have = F.coalesce(F.try_element_at("baseline", F.col("field")), F.array().cast("array<string>"))
    scalar = F.col("field").isin(*rules.SCALAR_FIELDS)
    new = F.when(scalar, F.slice("candidates", 1, 1)).otherwise(F.filter("candidates", lambda c: ~fuzzy_member(c, F.col("have"))))
    each = each.withColumn("have", have).withColumn("new", new).withColumn("changed", scalar | (F.size("new") > 0))
    kept = [c for c in facts.columns if c != "fact_id"]
    change = F.when(F.col("changed"), F.struct("field", F.array_join("have", "; ").alias("before"), F.array_join("new", "; ").alias("after"), F.col("have").alias("before_values"), F.col("new").alias("after_values")))
    reason = F.when(F.col("changed"), F.concat(F.array_join("new", ", "), F.lit(" is not in "), F.col("field")))
    out = each.groupBy("fact_id").agg(
        *[F.first(c).alias(c) for c in kept], F.first("last_reviewed_at").alias("last_reviewed_at"), F.array_sort(F.collect_list(change)).alias("changes"), F.array_join(F.array_sort(F.collect_list(reason)), ". ").alias("comparison_reason")
    )
    published = F.to_date(F.substring("published_at", 1, 10))
    predates = F.coalesce(published <= F.col("last_reviewed_at"), F.lit(False))
    return out.withColumns(
        {
            "changed_fields": F.transform("changes", lambda c: c["field"]),
            "predates_baseline": predates,
            "is_new_information": (F.size("changes") > 0) & ~predates,
            "materiality": materiality(),
        }
    )


def sentence_quality(text: Column) -> Column:
    """Points of a sentence as evidence: its length, words of the body, page furniture, and bars in a short one; a null has none."""
    n, low = F.length(text), F.lower(text)
    points = lambda hit, value: F.when(hit, value).otherwise(0)
    return points(n >= 90, 2) + points(n >= 160, 1) + points(any_of(low, list(rules.BODY_MARKERS)), 3) - points(any_of(low, list(rules.JUNK_MARKERS)), 6) - points(F.contains(text, F.lit("|")) & (n < 220), 3)


def has_any(text: Column, words: str) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), words.split("|"))


def severity() -> Column:
    """Rule severity of an alert from its object, type, materiality and category; the order of the cases matters."""
    t, o = F.col("signal_type"), F.col("object")
    return (
        F.when(has_any(o, "ofac|sanction|north korea|dprk|ransomware|darknet"), "critical")
        .when(t.isin("regulatory_scrutiny", "jurisdiction_restriction", "risk_rating_review") & has_any(o, "russia|aml|cftc|gambling|blocked"), "high")
        .when(F.col("materiality") == "high", "high")
        .when((t == "new_jurisdiction") & has_any(o, "bermuda|british virgin islands|russia|north korea"), "high")
        .when((t == "digital_asset_activity") & has_any(o, "bitcoin|collateral"), "medium")
        .when(F.col("category") == "opportunity", "medium")
        .when(F.col("materiality") == "low", "low")
        .otherwise("medium")
    )


def merge_comparisons(comparisons: DataFrame, key: list[str], order: str) -> DataFrame:
    """comparisons(key, order, changes, comparison_reason, materiality) merged by key, in their order.

    Gives changed_fields sorted, before (map of field -> values, of the first comparison that has the field), after (map of field -> distinct
    values by first sight), comparison_reason (distinct reasons by first sight, joined by a blank) and the highest materiality. A null or empty
    reason adds nothing; without changes the maps are empty. The order must be unique within a key for a defined result.

    Values and reasons are reduced to their first sight before any list is made, so a key's lists are as long as its distinct values, not
    its comparisons, and partial sums spare a busy key's shuffle.
    """
    rank = F.create_map(*[F.lit(x) for kv in rules.MATERIALITY_RANK.items() for x in kv])
    changes = comparisons.select(*key, F.col(order).alias("_o"), F.explode("changes").alias("c")).select(*key, "_o", F.col("c.field").alias("field"), F.col("c.before_values").alias("before"), F.posexplode_outer("c.after_values").alias("_p", "value"))
    sight = F.struct("_o", "_p")
    values = changes.groupBy(*key, "field", "value").agg(F.min(sight).alias("_at"), F.min_by("before", sight).alias("before"))
    fields = values.groupBy(*key, "field").agg(F.min_by("before", "_at").alias("before"), F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("_at", "value")))).alias("after"))
    one = F.struct("field", "before", F.transform("after", lambda x: x["value"]).alias("after"))
    maps = fields.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("_f"))
    pairs = lambda name: F.map_from_entries(F.transform("_f", lambda x: F.struct(x["field"], x[name])))
    maps = maps.select(*key, F.transform("_f", lambda x: x["field"]).alias("changed_fields"), pairs("before").alias("before"), pairs("after").alias("after"))
    told = comparisons.groupBy(*key, "comparison_reason").agg(F.min(order).alias("_o"), F.max(rank[F.col("materiality")]).alias("_m"))
    told = told.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("comparison_reason") != "", F.struct("_o", "comparison_reason")))).alias("_r"), F.max("_m").alias("_m"))
    names = F.create_map(*[F.lit(x) for k, v in rules.MATERIALITY_RANK.items() for x in (v, k)])
    told = told.select(*key, F.array_join(F.transform("_r", lambda x: x["comparison_reason"]), " ").alias("comparison_reason"), F.coalesce(names[F.col("_m")], F.lit("low")).alias("materiality"))
    empty = F.create_map().cast("map<string,array<string>>")
    both = told.alias("t").join(maps.alias("m"), F.expr(" and ".join(f"t.{k} <=> m.{k}" for k in key)), "left")
    return both.select(*[F.col(f"t.{k}").alias(k) for k in key], F.coalesce("changed_fields", F.array().cast("array<string>")).alias("changed_fields"), F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"), "comparison_reason", "materiality")


def make_alerts(comparisons: DataFrame) -> DataFrame:
    """New-information facts grouped by customer, type and normalised object into scored, evidence-backed alerts."""
    new = comparisons.where("is_new_information").withColumn("object_key", normalize_name(F.col("object")))
    dec = lambda x: F.lit(x).cast("decimal(6,4)")
    quality = dec("0.30")
    for k, v in rules.ALERT_QUALITY.items():
        quality = F.when(F.col("source_quality") == k, dec(v)).otherwise(quality)
    new = new.withColumns({"quality": quality, "official": F.col("source_type").isin(*rules.OFFICIAL)})
    evidence = F.struct("document_id", "source_name", "source_url", "source_quality", "source_type", "published_at", "collected_at", "title")
    rank = F.create_map(*[F.lit(x) for kv in {"low": 1, "medium": 2, "high": 3}.items() for x in kv])
    grouped = new.groupBy("customer_id", F.col("fact_type").alias("signal_type"), "object_key").agg(
        F.min_by("object", "fact_id").alias("object"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("changed_fields")))).alias("changed_fields"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("changes")))).alias("changes"),
        F.max_by("materiality", rank[F.col("materiality")]).alias("materiality"),
        F.array_sort(F.collect_set(evidence)).alias("evidence"),
        F.array_sort(F.collect_list("fact_id")).alias("fact_ids"),
        F.count_distinct("document_id").alias("documents"),
        F.avg(F.col("confidence").cast("double")).alias("fact_confidence"),
        F.avg(F.col("quality").cast("double")).alias("quality"),
        F.max("official").alias("official"),
        F.array_join(F.array_sort(F.collect_set("comparison_reason")), " ").alias("comparison_reason"),
    )
    clarity = F.when(F.size(F.array_except("changed_fields", F.array(F.lit("risk_rating")))) == 0, 0.75).otherwise(0.95)
    backing = F.when(F.col("documents") >= 2, 1.0).when(F.col("official"), 0.85).otherwise(0.65)
    confidence = F.round(F.lit(0.45) * F.col("fact_confidence") + F.lit(0.25) * F.col("quality") + F.lit(0.2) * clarity + F.lit(0.1) * backing + F.lit(1e-9), 2)
    out = grouped.withColumns({"category": F.coalesce(lookup("signal_type", rules.CATEGORY), F.lit("mixed")), "confidence": confidence})
    return out.withColumn("severity", severity()).withColumn("alert_id", F.concat_ws("|", "customer_id", "signal_type", "object_key"))


# ---------------------------------------------------------------- materiality


#: Columns that a fact and an alert must have a value in.
FACT_REQUIRED = ("fact_id", "customer_id", "document_id", "fact_type", "source_quality", "confidence")
ALERT_REQUIRED = ("alert_id", "customer_id", "category", "signal_type", "object", "changed_fields", "severity", "confidence", "evidence", "fact_ids")


def integrity(facts: DataFrame, alerts: DataFrame, documents: DataFrame, customers: DataFrame) -> DataFrame:
    """(error, rows) of required fields without a value, facts and alerts that say or cite nothing, and references to unknown rows."""
    lacks = lambda names: F.exists(F.array(*[F.col(n).isNull() for n in names]), lambda x: x)
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    own = facts.agg(F.count_if(lacks(FACT_REQUIRED)).alias("fact_fields"), F.count_if(blank("value") & blank("object")).alias("fact_content"))
    said = alerts.agg(F.count_if(lacks(ALERT_REQUIRED)).alias("alert_fields"), F.count_if(none("changed_fields")).alias("empty_fields"), F.count_if(none("fact_ids")).alias("alert_facts"), F.count_if(none("evidence")).alias("alert_evidence"))
    out = None
    for counts in (own, said):
        rows = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("error"), F.col(c).alias("rows")) for c in counts.columns])))
        out = rows if out is None else out.unionByName(rows)
    cited = alerts.select(F.explode("evidence").alias("e")).select("e.document_id")
    references = [
        ("fact_document", facts, documents, "document_id"),
        ("fact_customer", facts, customers, "customer_id"),
        ("alert_fact", alerts.select(F.explode("fact_ids").alias("fact_id")), facts, "fact_id"),
        ("alert_document", cited, documents, "document_id"),
    ]
    for name, rows, known, key in references:
        out = out.unionByName(rows.join(known.select(key), key, "left_anti").agg(F.lit(name).alias("error"), F.count("*").alias("rows")))
    return out


def instant(text: Column) -> Column:
    """A date or an instant as a timestamp; null where it can't be read."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def in_window(text: Column, now: str, hours: int) -> Column:
    """Whether a date (by calendar days) or an instant (exactly) lies in the hours before now, ends included."""
    end = F.lit(now).cast("timestamp")
    start = end - F.expr(f"interval {hours} hours")
    t = instant(text)
    by_day = (F.to_date(t) >= F.to_date(start)) & (F.to_date(t) <= F.to_date(end))
    return F.coalesce(F.when(F.length(text) == 10, by_day).otherwise((t >= start) & (t <= end)), F.lit(False))


def alert_text() -> Column:
    each = F.transform("evidence", lambda e: F.concat_ws(" ", e["title"], e["source_name"]))
    return F.lower(F.concat_ws(" ", "object", "comparison_reason", F.array_join(each, " ")))


def keyword_sum(text: Column, weights: dict[str, int]) -> Column:
    out = F.lit(0)
    for word, points in weights.items():
        out = out + F.when(F.contains(text, F.lit(word)), points).otherwise(0)
    return out


def score(alerts: DataFrame, now: str, hours: int, collected: bool = False, undated: bool = True, keywords: dict[str, int] = rules.MATERIAL_KEYWORDS, impact_keywords: dict[str, int] = rules.BUSINESS_IMPACT_KEYWORDS) -> DataFrame:
    """Alerts with freshness, material score, window, primary evidence and review lane."""
    end = F.lit(now).cast("timestamp")
    newest = F.array_max(F.transform("evidence", lambda e: instant(e["published_at"])))
    age = F.floor((F.unix_timestamp(end) - F.unix_timestamp("newest")) / 86400).cast("int")
    days = F.when(age.isNotNull(), F.greatest(F.lit(0), age))  # greatest() alone would make an unknown age 0
    risky = (F.col("category") == "risk") | F.col("signal_type").isin("regulatory_scrutiny", "jurisdiction_restriction")
    d = F.col("freshness_days")
    fresh = F.when(d.isNull(), -3).when(d <= 30, 12).when(d <= 180, 8).when(d <= 365, 5).when(risky, 4).otherwise(-6)
    source = F.array_max(F.transform("evidence", lambda e: lookup(e["source_quality"], rules.SOURCE_POINTS, 0)))
    fields = F.least(F.lit(28), F.aggregate("changed_fields", F.lit(0), lambda a, f: a + lookup(f, rules.FIELD_POINTS, 0)))
    t = F.col("signal_type")
    impact = F.when(F.col("category") == "risk", 18).otherwise(0) + F.when(t.isin("regulatory_scrutiny", "jurisdiction_restriction", "risk_rating_review"), 18).otherwise(0)
    impact = impact + F.when(t.isin("ownership_change", "new_subsidiary"), 12).otherwise(0) + F.when(t.isin("domain_registration", "new_jurisdiction"), 8).otherwise(0)
    impact = F.least(F.lit(110), impact + keyword_sum(F.col("text"), impact_keywords))
    seen = F.exists(
        "evidence",
        lambda e: in_window(e["published_at"], now, hours) | (F.lit(collected) & in_window(e["collected_at"], now, hours)) | (F.lit(undated) & e["published_at"].isNull() & in_window(e["collected_at"], now, hours)),
    )
    best = F.array_max(F.transform("evidence", lambda e: F.struct(lookup(e["source_quality"], rules.SOURCE_POINTS, 0).alias("q"), F.coalesce(instant(e["published_at"]), instant(e["collected_at"])).alias("t"), (-e["document_id"]).alias("o"), e["source_url"].alias("url"))))
    lane = (
        F.when((F.col("category") == "risk") | F.col("severity").isin("critical", "high"), "Compliance review")
        .when(t.isin("ownership_change", "new_subsidiary", "new_jurisdiction", "domain_registration"), "KYC update")
        .when(F.col("category") == "opportunity", "RM opportunity")
        .otherwise("RM review")
    )
    out = alerts.withColumns({"text": alert_text(), "newest": newest}).withColumn("freshness_days", days)
    out = out.withColumns({"freshness_points": fresh, "keyword_points": F.least(F.lit(26), keyword_sum(F.col("text"), keywords)), "impact_points": impact, "source_points": source, "field_points": fields, "in_window": seen, "primary_url": best["url"], "lane": lane})
    total = lookup("severity", rules.SEVERITY_POINTS, 0) + lookup("category", rules.CATEGORY_POINTS, 0) + F.round(F.col("confidence") * 20, 0).cast("int") + lookup("signal_type", rules.SIGNAL_POINTS, 0)
    total = total + F.col("source_points") + F.col("field_points") + F.col("freshness_points") + F.col("keyword_points") + F.col("impact_points")
    return out.withColumn("material_score", total.cast("int"))


def classify(scored: DataFrame, watch: Column, threshold: int = 100) -> DataFrame:
    """Scored alerts with their suppression reasons and whether they are material. watch: condition of the watched customers."""
    shadow = F.max(F.col("in_window") & (F.col("category") == "risk") & (F.col("material_score") >= threshold)).over(Window.partitionBy("customer_id"))
    high = F.col("severity").isin("critical", "high")
    opportunity = F.col("category") == "opportunity"
    no_url = ~F.exists(F.coalesce("evidence", F.array()), lambda e: F.coalesce(e["source_url"] != "", F.lit(False)))
    cases = [
        (~watch, "outside_watchlist"),
        (~F.col("in_window"), "outside_window"),
        (no_url, "no_source_url"),
        ((F.col("confidence") < 0.70) & ~high, "low_confidence"),
        (opportunity & F.col("shadowed") & (F.col("material_score") < 120), "shadowed"),
        (F.col("signal_type").isin("commercial_opportunity", "new_product", "public_listing") & opportunity & (F.col("material_score") < 115), "generic_opportunity"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, n) for c, n in cases]))
    qualifies = (F.col("material_score") >= threshold) | (high & (F.col("confidence") >= 0.65)) | (F.col("category").isin("risk", "ownership_control") & (F.col("confidence") >= 0.72))
    out = scored.withColumn("shadowed", shadow).withColumns({"reasons": reasons, "qualifies": qualifies})
    out = out.withColumn("material", F.col("qualifies") & (F.size("reasons") == 0))
    return out.withColumn("reasons", F.when((F.size("reasons") == 0) & ~F.col("qualifies"), F.array(F.lit("below_threshold"))).otherwise(F.col("reasons")))


def rank_material(classified: DataFrame) -> DataFrame:
    """Material alerts ranked by severity, score, confidence and freshness; an age of 0 days ranks last among ties, as in the specification."""
    stale = F.when(F.coalesce("freshness_days", F.lit(0)) == 0, 99999).otherwise(F.col("freshness_days"))
    order = [F.desc("sp"), F.desc("material_score"), F.desc("confidence"), F.asc("stale"), F.asc("alert_id")]
    out = classified.where("material").withColumns({"sp": lookup("severity", rules.SEVERITY_POINTS, 0), "stale": stale})
    return out.withColumn("rank_in_customer", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order))).drop("sp", "stale")


def evaluate_policies(scored: DataFrame, policies: DataFrame, watched: DataFrame) -> DataFrame:
    """(rm_id, alert) rows with the failures of the manager's policy; rows without failures are ranked within the manager.

    policies(rm_id, minimum_material_score, minimum_confidence, categories, severities, signal_types), one a manager;
    watched(rm_id, customer_id), as many as there are customers, meets the alerts in an equi join; other alerts fail by their watch list alone.
    """
    both = scored.join(watched, "customer_id").join(policies, "rm_id")
    cited = F.exists(F.coalesce("evidence", F.array()), lambda e: F.coalesce(e["source_url"] != "", F.lit(False)))
    cases = [
        (~F.col("in_window"), "outside_refresh_window"),
        (~cited, "missing_source_url"),
        (F.col("confidence") < F.col("minimum_confidence"), "below_minimum_confidence"),
        (F.col("material_score") < F.col("minimum_material_score"), "below_minimum_material_score"),
        (~F.array_contains("categories", F.col("category")), "category_disabled"),
        (~F.array_contains("severities", F.col("severity")), "severity_disabled"),
        ((F.size("signal_types") > 0) & ~F.array_contains("signal_types", F.col("signal_type")), "signal_type_disabled"),
    ]
    out = both.withColumn("failures", F.array_compact(F.array(*[F.when(c, n) for c, n in cases])))
    order = [F.desc(lookup("severity", rules.SEVERITY_RANK, 0)), F.desc("material_score"), F.desc("confidence"), F.asc("alert_id")]
    ok = F.size("failures") == 0
    rank = F.row_number().over(Window.partitionBy("rm_id", ok).orderBy(*order))
    return out.withColumn("policy_rank", F.when(ok, rank))


def upsert_notifications(state: DataFrame, qualified: DataFrame) -> DataFrame:
    """state(rm_id, alert_id, first_seen, active, position) after a run: rows of the run active with their first sight kept, others inactive."""
    new = qualified.select("rm_id", "alert_id", F.col("seen").alias("_seen"), F.col("policy_rank").alias("_rank"), F.lit(True).alias("_now"))
    return state.join(new, ["rm_id", "alert_id"], "full_outer").select("rm_id", "alert_id", F.coalesce("first_seen", "_seen").alias("first_seen"), F.coalesce("_now", F.lit(False)).alias("active"), F.coalesce("_rank", "position").alias("position"))
