"""Dictionaries of phrases matched against texts by an equi join on runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_of(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, longest: int) -> Column:
    """(pos, n, run) of every run of 1 to ``longest`` words."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("run")))
    return F.flatten(F.array(*[F.when(F.size(words) >= n, of(n)).otherwise(F.array().cast("array<struct<pos:int,n:int,run:string>>")) for n in range(1, longest + 1)]))


def dictionary_matches(texts: DataFrame, key: str, text: str, dictionary: DataFrame, longest: int = 4) -> DataFrame:
    """texts(key, text) against dictionary(position, label, phrase): (key, pos, n, position, label), one row for each place of a phrase.

    Phrases match as whole words, whatever the case and what stands between the words. A match that lies inside a longer one is dropped; those
    that overlap or share a span stay. A label may have several phrases. Null texts, null phrases and phrases without words match nothing.

    The plan is as long for ten entries as for ten thousand: texts give their runs of up to ``longest`` words, which meet the entries' in one
    equi join. A longer entry is found by its first words and then compared whole; only texts with such candidates are read again. Rows of equal keys are one text for
    the dropping, so keys should be unique.
    """
    split = texts.where(F.col(text).isNotNull()).select(key, words_of(F.col(text)).alias("_w"))
    entry = dictionary.select("position", "label", words_of(F.col("phrase")).alias("_e")).where("size(_e) > 0").distinct()
    entry = entry.select("*", F.size("_e").alias("size"), F.array_join(F.slice("_e", 1, longest), " ").alias("run"), F.least(F.size("_e"), F.lit(longest)).alias("n"))
    met = split.select(key, F.explode(_runs(F.col("_w"), longest)).alias("r")).select(key, "r.*").join(entry, ["run", "n"])
    short = met.where(F.col("size") <= longest).select(key, "pos", "size", "position", "label")
    begun = met.where(F.col("size") > longest).select(key, "pos", "size", "position", "label", "_e")
    long = begun.join(split, key).where(F.slice("_w", F.col("pos"), F.col("size")) == F.col("_e")).select(key, "pos", "size", "position", "label")
    spans = short.unionByName(long).groupBy(key, "pos", "size").agg(F.collect_set(F.struct("position", "label")).alias("_l"))
    end = F.col("pos") + F.col("size")
    before = Window.partitionBy(key).orderBy(F.asc("pos"), F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.withColumn("_end", F.max(end).over(before)).where(F.col("_end").isNull() | (end > F.col("_end")))
    return outer.select(key, "pos", F.col("size").alias("n"), F.explode("_l").alias("l")).select(key, "pos", "n", "l.*")


def labels_found(texts: DataFrame, key: str, text: str, dictionary: DataFrame, longest: int = 4) -> DataFrame:
    """(key, found): the labels in a text, each once, in the dictionary's order. Texts without any have no row."""
    hits = dictionary_matches(texts, key, text, dictionary, longest).groupBy(key, "label").agg(F.min("position").alias("position"))
    return hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]).alias("found"))
