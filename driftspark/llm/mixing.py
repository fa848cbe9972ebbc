"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic) once; raking then works on cells alone, one aggregate and one
join per marginal and round, until every marginal is met or a round hardly brings it closer. Documents are sampled with a
probability in proportion to their cell's factor, so that the expected tokens of the sample meet the marginals. What each
marginal still lacks is returned as its residual. DataFrame functions only.

Topics are learned from all texts: a topic is a word that a fair share of a language's documents holds, but no common one (its
document frequency lies between two bounds), and a document's topic is the one of these words that it holds most often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import drop, store, table

#: A target share is the present share to this power, made to sum to 1; 1 keeps the present mix.
TEMPER = {"source": 0.85, "lang": 0.9, "topic": 1.0}
#: Largest difference of shares that counts as met, and the part of it that a round must take away to be worth another.
TOLERANCE, PROGRESS = 1e-4, 0.02
#: Topics to learn, and the least and largest share of a language's documents that hold a topic's word.
TOPICS, LEAST_SHARE, MOST_SHARE = 12, 0.01, 0.1
#: The value of a target table that stands for all values it doesn't list, and that of a null.
REST, NULL = "*", "∅"
OTHER = "other"


def word_array(text: Column) -> Column:
    """A lower-cased text split at its runs of ASCII white space; the first and the last value may be empty. Null is as empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\t\n\x0B\f\r ]+")


def n_words(words: Column) -> Column:
    """Values of a word_array that aren't empty."""
    ends = (F.get(words, 0) == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(words) - ends).cast("long")


def learn_topics(docs: DataFrame, n: int = TOPICS, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[str]:
    """The n words in the largest shares of a language's documents that are neither rare nor common in it, over all docs(lang, text).

    A word is of at least two letters, nothing else, and in between ``least`` and ``most`` of the documents; ties go to the lesser word.
    """
    sizes = docs.groupBy("lang").agg(F.count("*").alias("docs"))
    held = docs.select("lang", F.explode(F.array_distinct(word_array(F.col("text")))).alias("word"))
    held = held.groupBy("lang", "word").agg(F.count("*").alias("df")).where("df > 1")
    share = F.col("df") / F.col("docs")
    between = held.join(F.broadcast(sizes), "lang").where((share >= least) & (share <= most) & F.col("word").rlike(r"^\p{L}{2,}$"))
    return [r.word for r in between.groupBy("word").agg(F.max(share).alias("share")).orderBy(F.desc("share"), "word").limit(n).collect()]


def topic_of(words: Column, topics: list[str]) -> Column:
    """The topic word that an array of words holds most often, of equal ones the lesser; ``other`` for none."""
    known = F.array_sort(F.array_intersect(words, F.array(*[F.lit(t) for t in topics]))) if topics else F.array().cast("array<string>")
    often = F.array_sort(F.transform(known, lambda t: F.struct((-F.size(F.filter(words, lambda w: w == t))).alias("n"), t.alias("t"))))
    return F.when(F.size(known) > 1, F.get(often, 0)["t"]).otherwise(F.coalesce(F.get(known, 0), F.lit(OTHER)))


def tempered(cells: DataFrame, by: str, power: float) -> DataFrame:
    """(by, target): shares of one marginal to a power, made to sum to 1."""
    sums = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("w")).where("w > 0")
    norm = sums.agg(F.sum(F.pow("w", F.lit(power)))).first()[0] or 1.0
    return sums.select(by, (F.pow("w", F.lit(power)) / norm).alias("target"))


def completed(cells: DataFrame, by: str, given: dict[str, float] | DataFrame) -> DataFrame:
    """(by, target) for every value with tokens from given weights (value, target).

    REST's weight is shared by the values that aren't listed, in proportion to their tokens; without it they get none. Listed values
    without tokens are left out. What is left is made to sum to 1.
    """
    if isinstance(given, dict):
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{by} string, target double")
    sums = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("w")).where("w > 0")
    rest = given.where(F.col(by) == REST).agg(F.sum("target")).first()[0] or 0.0
    joined = sums.join(given.where(F.col(by) != REST), by, "left")
    unlisted = joined.where("target is null").agg(F.sum("w")).first()[0] or 1.0
    target = F.coalesce("target", F.lit(rest) * F.col("w") / F.lit(unlisted))
    norm = joined.agg(F.sum(target)).first()[0] or 1.0
    return joined.select(by, (target / norm).alias("target"))


def residuals(cells: DataFrame, marginals: list[str], total: float) -> dict[str, float]:
    """The largest difference between reached and target share of each marginal."""
    mass = F.col("factor") * F.col("tokens")
    each = [F.struct(F.lit(by).alias("by"), F.col(by).cast("string").alias("value"), mass.alias("mass"), F.col(f"to_{by}").alias("target")) for by in marginals]
    reached = cells.select(F.explode(F.array(*each)).alias("m")).select("m.*").groupBy("by", "value").agg((F.sum("mass") / total).alias("share"), F.first("target").alias("target"))
    found = reached.groupBy("by").agg(F.max(F.abs(F.col("share") - F.col("target"))).alias("off")).collect()
    return dict.fromkeys(marginals, 0.0) | {r.by: r.off or 0.0 for r in found}


def fitted(cells: DataFrame, by: str, total: float) -> DataFrame:
    """cells with the factors that meet one marginal, stored: a plan over several marginals would hold each of its inputs twice for each of them."""
    margin = cells.groupBy(by).agg(F.sum(F.col("factor") * F.col("tokens")).alias("mass"))
    step = F.when(F.col("mass") > 0, F.col(f"to_{by}") * F.lit(total) / F.col("mass")).otherwise(0.0)
    return store(cells.join(margin, by).withColumn("factor", F.col("factor") * step).select(cells.columns), "cells")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, float]]:
    """(cells with ``factor``, residuals): factor * tokens meets each target (a share of all tokens) as closely as the cells allow.

    A cell without tokens, or whose value has no target, gets factor 0. Rounds end when every residual is at most ``tolerance``, or when
    the largest one has fallen by less than PROGRESS: targets that no factors can meet together end so, with their residuals returned.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("factor", F.lit(1.0))
    for by, target in targets.items():
        now = now.join(target.withColumnRenamed("target", f"to_{by}"), by, "left").fillna(0.0, [f"to_{by}"])
    now = store(now, "cells")
    off = residuals(now, list(targets), total) if total else dict.fromkeys(targets, 0.0)
    while max(off.values(), default=0.0) > tolerance:
        before = max(off.values())
        for by in targets:
            last, now = now, fitted(now, by, total)
            drop(last)
        off = residuals(now, list(targets), total)
        if max(off.values()) > before * (1 - PROGRESS):
            break
    return now.select(*targets, "tokens", "factor"), off


def mix(docs: DataFrame, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float] | DataFrame] | None = None, topic: Column | None = None, seed: int = 17) -> DataFrame:
    """docs(source, lang, text, ...) -> row (a struct of all columns), topic, tokens, factor, probability (0 to 1), sampled, residual.

    Tokens are words, runs of other than ASCII white space. A marginal's targets are those given in ``targets`` (weights by value, see ``completed``), else its present
    shares tempered by its power in ``temper``. ``topic`` may name a column instead of the learned topics. residual: by marginal, the
    largest difference of the shares reached from their targets.
    A null source, language or topic is a value of its own, NULL. Null and empty texts have no tokens and count in no marginal; they
    take the probability of their cell, and if there are no tokens at all every row is sampled. Whether a row is sampled follows from its
    doc_id and text alone, so repeated rows share a decision and a rerun makes the same; a null doc_id leaves it to the text. Columns of
    docs come back inside ``row``, so none clashes. A text of any length is read whole. An empty table gives an empty result.
    """
    named = {by: F.coalesce(F.col(by).cast("string"), F.lit(NULL)) for by in ("source", "lang")}
    topics = learn_topics(docs.select(named["lang"].alias("lang"), "text")) if topic is None else []
    chosen = (lambda w: topic_of(w, topics)) if topic is None else (lambda w: F.coalesce(topic.cast("string"), F.lit(NULL)))
    # bound as a lambda's argument, a text is split into words once
    read = F.get(F.transform(F.array(word_array(F.col("text"))), lambda w: F.struct(chosen(w).alias("topic"), n_words(w).alias("tokens"))), 0)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(by) for by, c in named.items()], read.alias("read"))
    rows = store(rows.select("row", "source", "lang", "read.topic", "read.tokens"), "mixed-rows")
    cells = store(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "cells")
    given = targets or {}
    goal = {by: completed(cells, by, given[by]) if by in given else tempered(cells, by, power) for by, power in (TEMPER | (temper or {})).items()}
    factors, off = rake(cells, goal)
    factors = store(factors.drop("tokens"), "factors")
    most = factors.agg(F.max("factor")).first()[0] or 0.0
    drop(cells)
    unit = F.pmod(F.xxhash64("row.doc_id", "row.text", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (
        rows.join(factors, ["source", "lang", "topic"])
        .withColumn("probability", F.col("factor") / F.lit(most) if most else F.lit(1.0))
        .withColumn("residual", F.struct(*[F.lit(float(off[by])).alias(by) for by in goal]))
        .select("row", "topic", "tokens", "factor", "probability", (unit < F.col("probability")).alias("sampled"), "residual")
    )


#: Weights of the languages that op8 mixes to; other languages share the last one.
LANGUAGES = {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15, REST: 0.05}


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, targets={"lang": LANGUAGES}, temper={"source": 0.5})
    return mixed.select("row.doc_id", "row.source", "row.lang", "topic", "tokens", F.col("factor").alias("weight"), "probability", "sampled", *[F.col(f"residual.{by}").alias(f"residual_{by}") for by in TEMPER])
