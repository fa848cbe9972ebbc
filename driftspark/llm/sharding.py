"""Sharding: longest-processing-time scheduling of groups that must stay together.

Groups are equal texts. LPT takes groups from the largest down and gives each to
the least-loaded shard through a heap. Groups of one size are interchangeable, so
the heap runs over sizes with their numbers of groups, not over groups. The sizes
reach the driver from the largest down, one partition at a time, and what each of
them gives to the shards is written out in portions of ``PORTION``: the driver holds
one portion and the heap, whatever the number of rows, groups or sizes.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspark.llm.common import drop, shared_dir, store, table

#: Sizes that the driver plans before it writes them out.
PORTION = 1 << 17


def lpt_counts(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """sizes: (size of a group, number of such groups) from the largest down. For each size the running totals of groups for shards 0, 1, ...

    The least-loaded shard comes first, of equal ones the lowest number. Of a size with many groups, whole rounds of
    ``shards`` groups are dealt out at once as soon as the loads lie within one group of each other: the heap would do the same.
    """
    heap = [(0, s) for s in range(shards)]
    for size, n in sizes:
        given = [0] * shards
        left = n
        while left:
            if left >= 2 * shards and max(heap)[0] - heap[0][0] < size:
                rounds = left // shards - 1
                heap = [(load + rounds * size, s) for load, s in heap]
                given = [g + rounds for g in given]
                left -= rounds * shards
            else:
                load, s = heap[0]
                take = left
                if shards > 1:
                    second, other = min(heap[1:3])
                    whole, rest = divmod(second - load, size)
                    take = min(left, max(1, whole + (rest > 0 or s < other)))
                heapq.heapreplace(heap, (load + take * size, s))
                given[s] += take
                left -= take
        running, total = [], 0
        for g in given:
            total += g
            running.append(total)
        yield size, running


def _plan(groups: DataFrame, shards: int) -> DataFrame:
    """(total, upto) for each size of the groups, by lpt_counts."""
    spark = groups.sparkSession
    path, schema = f"{shared_dir(spark)}/shard-plan-{uuid.uuid4().hex}", "total long, upto array<long>"
    sizes = groups.groupBy("total").agg(F.count("*").alias("n")).orderBy(F.desc("total")).toLocalIterator()
    portion: list = []

    def write():
        spark.createDataFrame(portion, schema).write.mode("append").parquet(path)
        portion.clear()

    for row in lpt_counts(((r.total, r.n) for r in sizes), shards):
        portion.append(row)
        if len(portion) == PORTION:
            write()
    write()
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def shard(docs: DataFrame, shards: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Put every row of docs(doc_id, text, ...) into a shard; equal texts share one.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot (gapless from 0
    within a shard), grown_shard (null under this law) and the columns named in ``keep``.
    A null text has size 1 and crc32 0; null texts stay together, and with no other text. A text of any length is one group with
    its copies. Groups of equal size are taken in the order of their partitions and digests, and of equally loaded shards the
    lowest comes first. Repeated rows and null or repeated doc_ids each keep a row of their own; slots follow the partitions and, in
    these, doc_id (nulls first). Columns of docs other than doc_id and text don't matter, unless named in ``keep``. An empty
    table gives an empty result.
    """
    blob = F.col("text").cast("binary")
    rows = store(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(blob), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(blob, 256), F.lit("null")).alias("digest"),
            *keep,
        ),
        "shard-rows",
    )
    groups = store(rows.groupBy("digest").agg(F.sum("size").alias("total")).withColumn("part", F.spark_partition_id()), "shard-groups")
    per_part = groups.groupBy("total", "part").agg(F.count("*").alias("n"))
    by_size = Window.partitionBy("total").orderBy("part")
    starts = per_part.withColumn("start", F.sum("n").over(by_size) - F.col("n")).drop("n")
    plan = _plan(groups, shards)
    ranked = (
        groups.withColumn("nth", F.row_number().over(Window.partitionBy("total", "part").orderBy("digest")) - 1)
        .join(starts, ["total", "part"])
        .join(plan, "total")
        .select("digest", F.size(F.filter("upto", lambda u: u <= F.col("start") + F.col("nth"))).alias("shard"))
    )
    # stored before the join, so that a group of very many rows can be split among tasks
    ranked = store(ranked, "shard-ranked")
    placed = store(rows.join(ranked, "digest").drop("digest").withColumn("part", F.spark_partition_id()), "shard-placed")
    drop(rows, groups, plan, ranked)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(within) - 1)
        .join(before, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            *keep,
        )
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)
