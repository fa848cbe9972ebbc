"""Internal bank intelligence: what customers' transactions say against their expected activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.text import normalize_name
from driftspark.sources.tables import store


def month(day: str = "booked_on") -> Column:
    return F.trunc(day, "month")


def observed_vs_expected(txns: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per customer: observed volume, its mean by active month, the expected monthly volume and their ratio."""
    seen = txns.groupBy("customer_id").agg(F.sum("amount").cast("double").alias("observed"), F.count_distinct(month()).alias("months"))
    return seen.join(baselines, "customer_id").select(
        "customer_id", "observed", (F.col("observed") / F.col("months")).alias("observed_monthly"), "expected_monthly_volume", (F.col("observed") / F.col("months") / F.col("expected_monthly_volume")).alias("ratio")
    )


def volume_spikes(txns: DataFrame, baselines: DataFrame) -> DataFrame:
    """Months whose volume exceeds the expected one by the multiplier, or that hold a payment above the single-payment mark."""
    monthly = txns.groupBy("customer_id", month().alias("month")).agg(F.sum("amount").cast("double").alias("volume"), F.max("amount").alias("largest"))
    by_volume = F.col("volume") > F.col("expected_monthly_volume") * F.col("volume_spike_multiplier")
    by_payment = F.col("largest") > F.col("single_payment")
    return monthly.join(baselines, "customer_id").where(by_volume | by_payment).select("customer_id", "month", "volume", by_volume.alias("by_volume"), by_payment.alias("by_payment"))


def new_regions(txns: DataFrame, baselines: DataFrame) -> DataFrame:
    """Months with at least the set number of payments to a region outside the expected ones."""
    outside = txns.join(baselines, "customer_id").where(~F.array_contains("expected_regions", F.col("region")))
    counted = outside.groupBy("customer_id", "region", month().alias("month")).agg(F.count("*").alias("payments"), F.max("new_region_monthly_count").alias("least"))
    return counted.where("payments >= least").drop("least")


def profile_mismatch(txns: DataFrame, baselines: DataFrame) -> DataFrame:
    """Payments for purposes outside the expected ones, summed per customer and purpose."""
    expected = baselines.select("customer_id", F.explode("expected_purposes").alias("purpose"))
    known = txns.join(baselines.select("customer_id"), "customer_id", "left_semi")
    return known.join(expected, ["customer_id", "purpose"], "left_anti").groupBy("customer_id", "purpose").agg(F.count("*").alias("payments"), F.sum("amount").cast("double").alias("volume"))


def screening(txns: DataFrame, watch: DataFrame) -> DataFrame:
    """Payments whose counterparty or its country is on a watch list(kind: 'name' or 'country', value), each side an equi join."""
    name = txns.join(watch.where("kind = 'name'").select(F.col("value").alias("counterparty")), "counterparty").withColumn("hit", F.lit("name"))
    country = txns.join(watch.where("kind = 'country'").select(F.col("value").alias("country")), "country").withColumn("hit", F.lit("country"))
    return name.unionByName(country).groupBy("customer_id", "hit").agg(F.count("*").alias("payments"), F.sum("amount").cast("double").alias("volume"))


def linked_entity_flow(txns: DataFrame, entities: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Flows between a customer and its own entities(customer_id, entity), by normalised name.

    With groups(customer_id, group), entities are (group, entity) and belong to each customer of the group: a customer's group is joined to its
    payments, and the customers of a group are never paired with its entities.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    owner = "customer_id" if groups is None else "group"
    own = entities.select(owner, plain(F.col("entity")).alias("party")).distinct()
    paid = txns.select("customer_id", plain(F.col("counterparty")).alias("party"), "direction", "amount")
    if groups is not None:
        paid = paid.join(groups.select("customer_id", "group").distinct(), "customer_id")
    flows = paid.join(own, [owner, "party"]).groupBy(*dict.fromkeys(["customer_id", owner]), "party", "direction").agg(F.count("*").alias("payments"), F.sum("amount").cast("double").alias("volume")).drop("group")
    return flows if groups is None else flows.dropDuplicates(["customer_id", "party", "direction"])  # an entity of several of a customer's groups counts once


def dormancy_breaks(txns: DataFrame, days: int, burst_days: int, least: int) -> DataFrame:
    """Days on which a customer is active again after a gap, with the payments of the following burst."""
    daily = txns.groupBy("customer_id", "booked_on").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("volume"))
    order = Window.partitionBy("customer_id").orderBy(F.unix_date("booked_on"))
    ahead = order.rangeBetween(0, burst_days)
    marked = daily.withColumns({"gap": F.datediff("booked_on", F.lag("booked_on").over(order)), "burst": F.sum("n").over(ahead), "burst_volume": F.sum("volume").over(ahead)})
    return marked.where((F.col("gap") >= days) & (F.col("burst") >= least)).select("customer_id", "booked_on", "gap", "burst", "burst_volume")


def adverse_spikes(items: DataFrame, key: str, at: str, factor: float, least: int) -> DataFrame:
    """Items after which the last 24 hours hold more than factor times the daily mean of the 30 days before."""
    order = Window.partitionBy(key).orderBy("second")
    day = 86400
    out = items.withColumn("second", F.unix_timestamp(at)).withColumns({"last_day": F.count("*").over(order.rangeBetween(-day + 1, 0)), "before": F.count("*").over(order.rangeBetween(-31 * day + 1, -day))})
    return out.where((F.col("last_day") >= least) & (F.col("last_day") > F.col("before") / 30 * factor))


def high_value_cross_border(txns: DataFrame, customers: DataFrame, share: float) -> DataFrame:
    """Payments to another country at or above a share of the customer's largest payment in the baseline."""
    home = customers.select("customer_id", "domicile", "single_payment")
    hit = txns.join(home, "customer_id").where((F.col("country") != F.col("domicile")) & (F.col("amount") >= F.col("single_payment") * share))
    return hit.groupBy("customer_id", "country", "rail").agg(F.count("*").alias("payments"), F.max("amount").cast("double").alias("largest"))


def quiet_days(payments: DataFrame, activity: DataFrame, days: int, most: int) -> DataFrame:
    """(customer_id, booked_on) of the days of payments before which, over so many days, the customer has at most so many rows in activity.

    An as-of join by union: both sides are counted by customer and day, and one range window looks back over them. It holds at most one row
    a day for a customer, however busy, and a payment finds its past even on days without any activity. Both need customer_id and booked_on;
    rows where either is null don't take part, and a customer without activity is quiet. The day itself isn't its own past.
    """
    counted = lambda df, n, paid: df.where("customer_id is not null and booked_on is not null").groupBy("customer_id", "booked_on").agg(n.alias("n"), F.lit(paid).alias("paid"))
    both = counted(activity, F.count("*"), False).unionByName(counted(payments, F.lit(0).cast("long"), True))
    daily = both.groupBy("customer_id", "booked_on").agg(F.sum("n").alias("n"), F.bool_or("paid").alias("paid"))
    past = Window.partitionBy("customer_id").orderBy(F.unix_date("booked_on")).rangeBetween(-days, -1)
    return daily.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0))).where(F.col("paid") & (F.col("before") <= most)).select("customer_id", "booked_on")


def linked_clusters(txns: DataFrame, days: int, least: int, activity: DataFrame | None = None, quiet: int = 90, most: int = 0) -> DataFrame:
    """(counterparty_id, booked_on, customers): days with a payment around which, within some days, several customers pay a counterparty.

    With activity, only payments after low activity count: by customers with at most ``most`` rows in it over the ``quiet`` days before.

    A payment counts towards each day it is near to, 2 * days + 1 of them, so no two payments are paired and a busy counterparty's
    days are spread over tasks.
    """
    near = F.explode(F.sequence(F.lit(-days), F.lit(days)))
    paid = txns.select("counterparty_id", "customer_id", "booked_on").distinct()
    if activity is not None:
        paid = paid.join(quiet_days(paid, activity, quiet, most), ["customer_id", "booked_on"])
    paid = paid.select("counterparty_id", "customer_id", "booked_on", near.alias("off"))
    per = paid.groupBy("counterparty_id", F.date_add("booked_on", F.col("off")).alias("booked_on"), "customer_id").agg(F.bool_or(F.col("off") == 0).alias("on"))
    counted = per.groupBy("counterparty_id", "booked_on").agg(F.count("*").alias("customers"), F.bool_or("on").alias("on"))
    return counted.where(F.col("on") & (F.col("customers") >= least)).drop("on")


def identity_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that differ between two snapshots, null-safe: one row per change."""
    both = old.alias("o").join(new.alias("n"), key)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("before"), F.col(f"n.{f}").cast("string").alias("after")) for f in fields])
    return both.select(key, F.explode(each).alias("c")).select(key, "c.*").where(~F.col("before").eqNullSafe(F.col("after")))


def holder_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows(customer_id, holder) in one snapshot only, with which."""
    keys = ["customer_id", "holder"]
    return new.join(old, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, keys, "left_anti").withColumn("change", F.lit("removed"))).distinct()


def scale_changes(txns: DataFrame, factor: float) -> DataFrame:
    """Quarters whose volume is at least factor times the quarter before, with the growth in regions."""
    quarter = F.trunc("booked_on", "quarter")
    per = txns.groupBy("customer_id", quarter.alias("quarter")).agg(F.sum("amount").cast("double").alias("volume"), F.count_distinct("region").alias("regions"))
    order = Window.partitionBy("customer_id").orderBy("quarter")
    out = per.withColumns({"before": F.lag("volume").over(order), "new_regions": F.col("regions") - F.lag("regions").over(order)})
    return out.where(F.col("volume") >= F.col("before") * factor).select("customer_id", "quarter", "volume", "before", "new_regions")


def fuse(alerts: DataFrame, signals: DataFrame) -> DataFrame:
    """Alerts(alert_id, customer_id, material_score) with their customer's signals: score, number and ids; an alert without signals stays out.

    The score is the material one (100 where there is none) plus 15 times the signals' confidence, at most 30.
    """
    per = signals.groupBy("customer_id").agg(F.sum("confidence").alias("confidence"), F.array_sort(F.collect_list("signal_id")).alias("signal_ids"))
    extra = F.least(F.lit(30), F.round(F.col("confidence") * 15, 0).cast("int"))
    return alerts.join(per, "customer_id").select("alert_id", "customer_id", (F.coalesce("material_score", F.lit(100)) + extra).alias("fused_score"), "signal_ids")


def expanded_profile(txns: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per customer: median and 95th percentile of payments, review threshold, observed total."""
    seen = txns.groupBy("customer_id").agg(F.percentile("amount", F.lit(0.5)).alias("p50"), F.percentile("amount", F.lit(0.95)).alias("p95"), F.sum("amount").cast("double").alias("observed"))
    return baselines.join(seen, "customer_id", "left").select("customer_id", "expected_monthly_volume", "p50", "p95", (F.col("p95") * 1.25).alias("review_threshold"), F.coalesce("observed", F.lit(0.0)).alias("observed"))


def name_block(name: Column) -> Column:
    """The longest word of a normalised name, of equally long ones the first in order; null without words."""
    words = F.filter(F.split(normalize_name(name), " "), lambda w: w != "")
    return F.array_min(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]


def similarity(a: str, b: str) -> Column:
    """1 less the edit distance of two names as a share of the longer one."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def without_letters(name: Column, edits: int) -> Column:
    """The name and what is left of it without up to so many characters, distinct."""
    shorter = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    out = last = F.array(name)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def _name_keys(df: DataFrame, c: str, lengths: DataFrame, left: bool) -> DataFrame:
    """(c, key, way, i, j) of distinct names: what two names within two edits have in common, for each way in which they can be so.

    way 0: equally long, up to two characters replaced; 1: one dropped and one added; 2 and 3: the left name is shorter, or longer, by one and
    one character replaced; 4 and 5: shorter, or longer, by two. lengths holds the lengths of the other side's names: ways that none of
    these fits get no keys. Replaced characters keep their place in the key, so that all that share a key of way 0 are within two edits.
    """
    n, way, form, i, j = map(F.col, ("n", "way", "form", "i", "j"))
    sign = 1 if left else -1
    fits = lambda way, more: F.when(F.array_contains("lengths", n + more * sign), F.lit(way))
    ways = F.array_compact(F.array(fits(0, 0), F.when(n > 0, fits(1, 0)), fits(2, 1), fits(3, -1), fits(4, 2), fits(5, -2)))
    # what this side does: replaces two, drops one, replaces one, drops one and replaces one, nothing, drops two
    forms = F.element_at(F.array(*map(F.lit, "AB" + ("CDEF" if left else "DCFE"))), way + 1)
    last_i = F.when(form == "A", F.greatest(n - 1, F.lit(1))).when(form.isin("B", "D"), n).when(form == "C", F.greatest(n, F.lit(1))).when(form == "F", n - 1).otherwise(1)
    first_j = F.when(form.isin("A", "F"), i + 1).otherwise(1)
    last_j = F.when(form == "A", F.greatest(n, i + 1)).when(form == "D", F.greatest(n - 1, F.lit(1))).when(form == "F", n).otherwise(1)
    part = lambda w, lo, hi: F.substr(w, lo, hi - lo + 1)
    name = F.col(c)
    rest = F.concat(part(name, F.lit(1), i - 1), part(name, i + 1, n))
    words = {
        "A": (i, j, n, part(name, F.lit(1), i - 1), part(name, i + 1, j - 1), part(name, j + 1, n)),
        "B": (F.lit(0), F.lit(0), n, rest, F.lit(""), F.lit("")),
        "C": (i, F.lit(0), n, part(name, F.lit(1), i - 1), part(name, i + 1, n), F.lit("")),
        "D": (j, F.lit(0), n - 1, part(rest, F.lit(1), j - 1), part(rest, j + 1, n - 1), F.lit("")),
        "E": (F.lit(0), F.lit(0), n, name, F.lit(""), F.lit("")),
        "F": (F.lit(0), F.lit(0), n - 2, F.concat(part(name, F.lit(1), i - 1), part(name, i + 1, j - 1), part(name, j + 1, n)), F.lit(""), F.lit("")),
    }
    key = F.coalesce(*[F.when(form == f, F.xxhash64(way, *of)) for f, of in words.items()])
    # of equal characters in a row only the first is dropped
    once = form.isin("A", "C", "E") | (i == 1) | (part(name, i, i) != part(name, i - 1, i - 1))
    # names are few bytes and their keys many: told how many, Spark doesn't make a single task of them
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.where(name.isNotNull()).select(c).distinct().repartition(tasks, F.xxhash64(c)).withColumn("n", F.length(c)).crossJoin(F.broadcast(lengths))
    each = named.select(c, "n", F.explode(ways).alias("way")).withColumn("form", forms)
    each = each.withColumn("i", F.explode(F.sequence(F.lit(1), last_i))).where(once).withColumn("j", F.explode(F.sequence(first_j, last_j)))
    return each.select(c, key.alias("key"), "way", "i", "j") if left else each.select(c, key.alias("key"))


def _near_pairs(left: DataFrame, right: DataFrame, edits: int = 2) -> DataFrame:
    """``near_names`` for at most two edits, where a pair may come more than once."""
    lengths = lambda df, c: df.where(F.col(c).isNotNull()).agg(F.collect_set(F.length(c)).alias("lengths"))
    pairs = _name_keys(left, "name", lengths(right, "known"), True).join(_name_keys(right, "known", lengths(left, "name"), False), "key")
    differ = lambda at: F.substr("name", at, F.lit(1)) != F.substr("known", at, F.lit(1))
    i, j = F.col("i"), F.col("j")
    # of the keys that two names of equal length share, one stands for them: the one whose places differ, or begin with the first
    one = (F.col("way") != 0) | (differ(i) & differ(j)) | ((i == 1) & ((j == 2) | differ(j)))
    return pairs.where(one).select("name", "known", F.levenshtein("name", "known", edits).alias("distance")).where(F.col("distance").between(0, edits))


def near_names(left: DataFrame, right: DataFrame, edits: int = 2) -> DataFrame:
    """(name, known, distance) of all distinct names of left(name) and right(known) at most so many edits apart. None is missed.

    Names meet in an equi join on hashes of what they have in common: up to two edits by ``_name_keys``, where hardly a key is shared by names further
    apart. For more, two names within d edits have a common remainder after dropping at most d characters of each; such a key is shared by names
    within 2 * d edits. No block grows with the tables unless like names do; the distance decides. Nulls meet nothing. A name of n
    characters has about n ** d / d! keys, so edits should stay small.
    """
    if edits <= 2:
        return _near_pairs(left, right, edits).distinct()
    keyed = lambda df, c: df.where(F.col(c).isNotNull()).select(c).distinct().select(c, F.explode(F.array_distinct(F.transform(without_letters(F.col(c), edits), lambda w: F.xxhash64(w)))).alias("key"))
    pairs = keyed(left, "name").join(keyed(right, "known"), "key").select("name", "known").distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "known", edits)).where(F.col("distance").between(0, edits))


def resolution_scores(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate names against known ones that share a block: edit similarity plus a bonus for equal places, with a review status."""
    score = F.least(F.lit(1.0), similarity("name", "known_name") + F.when(F.col("place") == F.col("known_place"), 0.1).otherwise(0.0))
    status = F.when(F.col("score") >= 0.9, "high_confidence_review").when(F.col("score") >= 0.75, "medium_confidence_review").otherwise("rejected_weak_match")
    return candidates.join(known, "block").withColumn("score", F.round(score, 4)).withColumn("status", status)


def screen_names(parties: DataFrame, entries: DataFrame, least: float = 0.75, edits: int = 2) -> DataFrame:
    """parties(name, ...) against entries(entry, list_name, aliases): each party's columns, entry, list_name, reason and score.

    Reasons, of which the best stays: ``exact`` (equal normalised names, 1), ``alias`` (equal to an alias, 0.95) and ``near`` (edit
    similarity of at least ``least`` to the name or an alias; both share their longest word or are at most ``edits`` edits apart). Each
    distinct name is compared once, however many parties bear it; a name that is null or has no words matches nothing.
    """
    # stored, so that what is asked of a normalised name is asked once a distinct name and not of each row
    names = store(parties.where(F.col("name").isNotNull()).select("name").distinct().select("name", normalize_name(F.col("name")).alias("party_key"), name_block(F.col("name")).alias("block")), "names")
    spelt = F.explode(F.concat(F.array(F.struct(F.col("entry").alias("known"), F.lit("exact").alias("kind"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("known"), F.lit("alias").alias("kind")))))
    listed = entries.select("entry", "list_name", spelt.alias("s")).select("entry", "list_name", "s.kind", normalize_name(F.col("s.known")).alias("known_key"), name_block(F.col("s.known")).alias("block")).distinct()
    same = F.col("party_key") == F.col("known_key")
    score = F.when(same & (F.col("kind") == "exact"), 1.0).when(same, 0.95).otherwise(F.round(similarity("party_key", "known_key"), 4))
    worded = lambda df, c: df.where(F.col("block").isNotNull()).select(c)
    near = _near_pairs if edits <= 2 else near_names
    close = near(worded(names, "party_key").withColumnRenamed("party_key", "name"), worded(listed, "known_key").withColumnRenamed("known_key", "known"), edits)
    pairs = names.select("party_key", "block").distinct().join(listed.select("block", "known_key"), "block").select("party_key", "known_key").unionByName(close.select(F.col("name").alias("party_key"), F.col("known").alias("known_key")))  # repeated pairs end in the grouping
    found = pairs.join(listed.drop("block"), "known_key").withColumns({"score": score, "reason": F.when(same, F.col("kind")).otherwise("near")}).where(F.col("score") >= least)
    best = found.groupBy("party_key", "entry", "list_name").agg(F.max(F.struct("score", "reason")).alias("best"))
    hits = best.join(names.select("name", "party_key"), "party_key").select(F.col("name").alias("_name"), "entry", "list_name", "best.reason", "best.score")
    return parties.join(hits, F.col("name") == F.col("_name")).drop("_name")
