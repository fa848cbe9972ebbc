"""Readers and writers of collections: JSON arrays or keyed objects, feeds, artifacts, partitioned tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collection(spark: SparkSession, path: str, schema: T.StructType, keyed: bool = False, lines: bool = False) -> DataFrame:
    """Rows of a JSON collection: an array of objects; with lines, one object a line (splittable, so the form for large ones); with keyed, the values of an object by id, one a file or a line."""
    if not keyed:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    whole = spark.read.text(path, wholetext=not lines)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), schema)))).select("value.*")


def checked(spark: SparkSession, path: str, schema: T.StructType, lines: bool = True) -> DataFrame:
    """(row, rejected): each entry of a collection as a struct of the schema, or as the text of what isn't a JSON object, never both.

    An entry is a line, or without lines an element of a file's array; a file that isn't an array of any entries is rejected whole. Rejected are
    texts that aren't JSON, numbers, strings, lists and null; blank lines are no entries. A field that doesn't fit its type is null, as are missing ones.
    """
    text = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    v = text.select("value", F.try_parse_json("value").alias("v"))
    if not lines:
        listed = F.schema_of_variant("v").startswith("ARRAY")
        each = F.when(listed, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
        v = v.select(F.when(F.coalesce(listed, F.lit(False)), F.lit(None)).otherwise(F.col("value")).alias("whole"), F.explode(each).alias("v"))
        v = v.select(F.coalesce("whole", F.to_json("v"), F.lit("null")).alias("value"), F.when(F.col("whole").isNull(), F.col("v")).alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return v.select(F.when(is_object, F.from_json("value", schema)).alias("row"), F.when(~is_object, F.col("value")).alias("rejected"))


def described(files: DataFrame) -> DataFrame:
    """files(path, value) as artifacts: path, name, media type by the name's ending, and text."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(".json"), "application/json").when(name.endswith(".md"), "text/markdown").otherwise("text/plain")
    return files.select("path", name.alias("name"), kind.alias("media_type"), F.col("value").alias("text"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path as an artifact."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return described(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def filings(feed: DataFrame) -> DataFrame:
    """Rows of a feed of parallel arrays (form, filed, accession), zipped."""
    return feed.select("company", F.inline(F.arrays_zip("form", "filed", "accession")))


def registry_records(raw: DataFrame) -> DataFrame:
    """Domain records (JSON text) as columns: events by action, name servers, whether anything was redacted."""
    schema = "handle string, events array<struct<eventAction:string,eventDate:string>>, nameservers array<struct<ldhName:string>>, remarks array<struct<title:string>>"
    r = raw.select("domain", F.from_json("record", schema).alias("r"))
    events = F.map_from_entries(F.transform("r.events", lambda e: F.struct(e["eventAction"], e["eventDate"])))
    redacted = F.exists("r.remarks", lambda m: F.contains(F.lower(m["title"]), F.lit("redacted")))
    return r.select("domain", "r.handle", F.try_element_at(events, F.lit("last changed")).alias("changed"), F.array_join(F.transform("r.nameservers", lambda n: F.lower(n["ldhName"])), "|").alias("servers"), F.coalesce(redacted, F.lit(False)).alias("redacted"))


def articles(feed: DataFrame) -> DataFrame:
    """Articles of news feeds, one a row."""
    return feed.select(F.explode("articles").alias("a")).select("a.*")


def overwrite(rows: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Replace a collection, partitioned by columns where given, and read it back."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return rows.sparkSession.read.parquet(path)


def publish(rows: DataFrame, root: str) -> int:
    """Write a collection as a new version below root and point to it; gives the version's number.

    A version is a folder of its own and the pointer a one-row append, which Spark's commit makes visible at once: readers see the old rows until
    then, and a write that fails leaves them in place. One writer at a time; old versions stay until their owner removes them.
    """
    spark = rows.sparkSession
    number = _latest(spark, root)[0] + 1
    folder = f"v{number}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    spark.range(1).select(F.lit(number).alias("version"), F.lit(folder).alias("folder")).write.mode("append").parquet(f"{root}/pointer")
    return number


def _latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and folder of the published version, (0, None) before the first."""
    try:
        newest = spark.read.schema("version int, folder string").parquet(f"{root}/pointer").agg(F.max(F.struct("version", "folder")).alias("at")).first().at
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    return (newest.version, newest.folder) if newest else (0, None)


def published(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Rows of the published version; none before the first."""
    folder = _latest(spark, root)[1]
    return spark.read.schema(schema).parquet(f"{root}/{folder}") if folder else spark.createDataFrame([], schema)


def bucket_of(key: list[str], buckets: int) -> Column:
    """The bucket of a row by its key's hash."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def bucketed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A keyed table in hash buckets, each a partition folder, with its column ``bucket``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)


def create_bucketed(rows: DataFrame, path: str, key: list[str], buckets: int) -> None:
    """Write a keyed table in hash buckets; the number of buckets belongs to the table."""
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def merge_bucketed(batch: DataFrame, path: str, schema: T.StructType, key: list[str], buckets: int, merge) -> None:
    """Merge a batch into a keyed table, rewriting only the buckets that its keys fall into; ``merge(old, new)`` gives the rows of those.

    Only the touched buckets are read (at most ``buckets`` numbers come to the driver) and dynamic partition overwrite replaces only them, so files
    of other buckets keep their names. If ``merge`` is idempotent, a replayed batch changes no row. Lost executors are no matter: Spark puts the
    buckets in place after all tasks are done. A driver lost while it does that can leave a bucket out; keep the version folder of ``publish``
    where that can't be borne. A merge that leaves a bucket without rows keeps the bucket as it was: mark rows instead of dropping them.
    """
    spark = batch.sparkSession
    new = batch.select(*schema.names).withColumn("bucket", bucket_of(key, buckets))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    old = bucketed(spark, path, schema).where(F.col("bucket").isin(touched)).drop("bucket")
    out = merge(old, new.drop("bucket")).select(*schema.names).withColumn("bucket", bucket_of(key, buckets))
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
