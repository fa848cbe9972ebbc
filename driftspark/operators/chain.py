"""Signals over transfers(ts, sender, receiver, asset, chain, amount)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.sources.tables import store


def touching(transfers: DataFrame, listed: DataFrame) -> DataFrame:
    """Transfers of which either side is listed(address), with the side. The transfers are read once, each as a row for either side."""
    sides = F.explode(F.array(*[F.struct(F.col(c).alias("address"), F.lit(c).alias("side")) for c in ("sender", "receiver")]))
    each = transfers.withColumn("_of", sides).select("*", "_of.*").drop("_of")
    return each.join(listed.select("address"), "address").drop("address")


def structuring(transfers: DataFrame, mixers: DataFrame, below: float, days: int, least: int) -> DataFrame:
    """Senders with many small transfers to listed receivers inside a span of days, for each span that begins with one."""
    small = transfers.where(F.col("amount") < below).join(mixers.withColumnRenamed("address", "receiver"), "receiver", "left_semi")
    return _bursts(small, ["sender"], days, least, "transfers", F.sum("amount").alias("volume")).withColumn("volume", F.col("volume").cast("double"))


def _bursts(rows: DataFrame, by: list[str], days: int, least: int, count: str, *sums: Column) -> DataFrame:
    """(by, window_start, counts and sums) of every span of days that begins with a row and holds at least so many.

    Rows are summed by key and day first, so a window holds at most one row a day, however many rows a key has.
    """
    daily = rows.groupBy(*by, F.to_date("ts").alias("window_start")).agg(F.count("*").alias(count), *sums)
    ahead = Window.partitionBy(*by).orderBy(F.unix_date("window_start")).rangeBetween(0, days - 1)
    added = [c for c in daily.columns if c not in (*by, "window_start")]
    return daily.select(*by, "window_start", *[F.sum(c).over(ahead).alias(c) for c in added]).where(F.col(count) >= least)


def bridges(transfers: DataFrame, days: int, band: float) -> DataFrame:
    """Deposits followed within days by a withdrawal of the same address on another chain for nearly the amount.

    The transfers are stored once for both sides of the join. Buckets are two spans wide, so that half the deposits lie in one bucket alone.
    """
    transfers = store(transfers.select("sender", "ts", "chain", "amount"), "bridges")
    at = lambda ahead: F.floor((F.unix_date("ts") + ahead) / (2 * (days + 1)))
    bucket = at(0)
    ins = transfers.select(F.col("sender").alias("address"), F.col("ts").alias("in_ts"), F.col("chain").alias("in_chain"), F.col("amount").alias("in_amount"), F.explode(F.array_distinct(F.array(bucket, at(days)))).alias("bucket"))
    outs = transfers.select(F.col("sender").alias("address"), F.col("ts").alias("out_ts"), F.col("chain").alias("out_chain"), F.col("amount").alias("out_amount"), bucket.alias("bucket"))
    gap = F.datediff("out_ts", "in_ts")
    near = F.abs(F.col("out_amount") - F.col("in_amount")) <= F.col("in_amount") * band
    pairs = ins.join(outs, ["address", "bucket"]).where((gap >= 0) & (gap <= days) & (F.col("in_chain") != F.col("out_chain")) & near)
    return pairs.groupBy("address", "in_chain", "out_chain").agg(F.count("*").alias("crossings"))


def unusual_volume(transfers: DataFrame, weeks: int, z: float) -> DataFrame:
    """Weeks whose volume lies z standard deviations over the mean of the weeks before."""
    weekly = transfers.groupBy("sender", F.trunc("ts", "week").alias("week")).agg(F.sum("amount").alias("volume")).withColumn("volume", F.col("volume").cast("double"))
    before = Window.partitionBy("sender").orderBy("week").rowsBetween(-weeks, -1)
    out = weekly.withColumns({"mean": F.avg("volume").over(before), "sd": F.stddev_samp("volume").over(before), "n": F.count("*").over(before)})
    return out.where((F.col("n") >= 3) & (F.col("sd") > 0) & (F.col("volume") > F.col("mean") + z * F.col("sd"))).select("sender", "week", "volume", ((F.col("volume") - F.col("mean")) / F.col("sd")).alias("z"))


def holdings(transfers: DataFrame) -> DataFrame:
    """(address, asset, day, balance, total): running balances at the end of each day on which they change, and the asset's total then.

    A transfer takes its amount from the sender and gives it to the receiver. Signed amounts are summed by address, asset and day and then
    cumulated, so a window holds at most one row a day, however busy an address. The total is that of all positive balances: it is cumulated
    from their daily changes, without a row for each holder and day. A balance below zero is that of an issuer or of one whose past is missing
    and adds nothing. Rows with a null address, asset, time or amount don't take part.
    """
    side = lambda c, amount: transfers.select(F.col(c).alias("address"), "asset", F.to_date("ts").alias("day"), amount.alias("amount"))
    moved = side("sender", -F.col("amount")).unionByName(side("receiver", F.col("amount"))).dropna()
    daily = moved.groupBy("address", "asset", "day").agg(F.sum("amount").alias("amount")).where("amount != 0")
    past = Window.partitionBy("address", "asset").orderBy("day")
    held = daily.withColumn("balance", F.sum("amount").over(past.rowsBetween(Window.unboundedPreceding, 0)))
    positive = F.greatest("balance", F.col("balance") * 0)
    held = held.withColumn("change", positive - F.coalesce(F.lag(positive).over(past), positive * 0))
    totals = held.groupBy("asset", "day").agg(F.sum("change").alias("change"))
    totals = totals.select("asset", "day", F.sum("change").over(Window.partitionBy("asset").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    return held.join(totals, ["asset", "day"]).select("address", "asset", "day", "balance", "total")


def large_holders(transfers: DataFrame, share: float) -> DataFrame:
    """holdings of which the balance is at least a share of the total, with the share: at the end of each day on which the holder's balance changes."""
    held = holdings(transfers)
    if share > 0:  # others have no share; without them half as much meets the totals
        held = held.where("balance > 0")
    return held.withColumn("share", F.try_divide(F.col("balance").cast("double"), F.col("total").cast("double"))).where(F.col("share") >= share)


def frequent_days(transfers: DataFrame, least: int, amount: float) -> DataFrame:
    """(sender, day, transfers, volume): days with at least so many transfers of a sender or with at least an amount in all."""
    daily = transfers.groupBy("sender", F.to_date("ts").alias("day")).agg(F.count("*").alias("transfers"), F.sum("amount").alias("volume"))
    return daily.where((F.col("transfers") >= least) | (F.col("volume") >= amount))


def repeated_calls(transfers: DataFrame, days: int, least: int) -> DataFrame:
    """Pairs of sender and receiver with at least so many transfers in a span of days, for each span that begins with one."""
    return _bursts(transfers, ["sender", "receiver"], days, least, "calls")


def repaid_loans(borrowed: DataFrame, repaid: DataFrame, days: int, band: float) -> DataFrame:
    """(sender, receiver, window_start, repayments): days on which a pair borrows what it repays within days for nearly the amount.

    An interval join on buckets of days and of amounts, so that a busy pair's transfers meet only those near in both. Only the transfers of
    pairs that have both kinds are dealt to buckets.
    """
    pair = ["sender", "receiver"]
    kinds = borrowed.select(*pair, F.lit(True).alias("lent")).unionByName(repaid.select(*pair, F.lit(False).alias("lent")))
    mutual = kinds.groupBy(*pair).agg(F.bool_or("lent").alias("some"), F.bool_and("lent").alias("only")).where("some and not only").select(*pair)
    mutual = store(mutual, "mutual")
    borrowed, repaid = (df.join(mutual, pair, "left_semi") for df in (borrowed, repaid))
    step = F.lit(float(-math.log(1 - band)))  # two amounts within the band lie at most one bucket of logarithms apart
    day, size = F.floor(F.unix_date("ts") / (days + 1)), F.floor(F.log("amount") / step)
    ins = borrowed.where("amount > 0").select("sender", "receiver", F.to_date("ts").alias("window_start"), F.col("amount").alias("lent"), F.explode(F.array(day, day + 1)).alias("day"), size.alias("size"))
    ins = ins.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    outs = repaid.where("amount > 0").select("sender", "receiver", F.to_date("ts").alias("back_on"), F.col("amount").alias("back"), day.alias("day"), size.alias("size"))
    gap = F.datediff("back_on", "window_start")
    near = F.abs(F.col("back") - F.col("lent")) <= F.col("lent") * band
    pairs = ins.join(outs, ["sender", "receiver", "day", "size"]).where((gap >= 0) & (gap <= days) & near)
    return pairs.groupBy("sender", "receiver", "window_start").agg(F.count("*").alias("repayments"))


def within_hops(transfers: DataFrame, labelled: DataFrame, hops: int) -> DataFrame:
    """(address, hops) of the addresses within so many undirected hops of a labelled one: an equi join per hop on a distinct frontier.

    The edges are stored once and never made distinct: only the addresses that a hop reaches are, so no task holds pairs of addresses in a hash table.
    """
    edges = store(transfers.select("sender", "receiver"), "edges")
    seen = labelled.select("address").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        step = lambda a, b: edges.join(frontier.select(F.col("address").alias(a)), a, "left_semi").select(F.col(b).alias("address"))  # noqa: B023, E731
        reached = step("sender", "receiver").distinct().unionByName(step("receiver", "sender").distinct()).distinct()
        frontier = store(reached.join(seen, "address", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen
