"""From documents to shards of training data: five stages, each of them an operator of driftspark.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import decontamination, mixing, near_dedup, sharding, toxicity
from driftspark.llm.common import remainder, store, table

#: A text is rejected as toxic from this score on.
TOXIC = 0.3
#: Rows of whole texts that reach Python at once. Spark's 10,000 are held several times over by a task's JVM and its Python worker.
ROWS = 1000


def _portions(spark: SparkSession) -> None:
    """Give Python tasks at most ROWS rows at once; set for the session, since a stage's result is computed after it returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def _whole(docs: DataFrame) -> DataFrame:
    """text beside a struct of all columns, so that no column of docs clashes with an operator's."""
    return docs.select("text", F.struct(*docs.columns).alias("kept"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; null and empty texts stay. It learns from labelled rows of the table."""
    _portions(spark)
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    model = toxicity.fit(*toxicity.labelled_sample(docs.where(remainder("doc_id", 4) != 2), labels))
    scored = toxicity.score(_whole(docs), model)
    blank = F.length(F.trim(F.coalesce("row.kept.text", F.lit("")))) == 0
    return scored.where((F.col("score") < TOXIC) | blank).select("row.kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the first by doc_id. Of rows that repeat that doc_id in a group one stays."""
    _portions(spark)
    found = near_dedup.near_duplicates(docs.select("text", "doc_id", F.struct(*docs.columns).alias("kept")), k=5, percent=80)
    return found.where("first").select("row.kept.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    _portions(spark)
    found = decontamination.contamination(_whole(docs), table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select("row.kept.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources and languages meet their tempered shares and topics keep theirs."""
    return mixing.mix(docs).where("sampled").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document left."""
    return sharding.shard(docs.select("doc_id", "text"), shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained network and a raking to convergence aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
