"""Readers that reject, writers that publish, and merges that touch few files."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.sources import readers

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def _lines(path, lines):
    path.mkdir()
    (path / "part.txt").write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_lines_that_are_no_objects_are_rejected(spark, tmp_path):
    bad = ["5", '"text"', "[1, 2]", "null", '{"id": 1', "true", '[{"id": 9}]']
    path = _lines(tmp_path / "in", ['{"id": 1, "name": "a"}', "", *bad, '{"id": "x"}', "{}", '{"name": "{\\"id\\": 4}", "more": [1]}'])
    got = readers.checked(spark, path, ROW).collect()
    assert sorted(r.rejected for r in got if r.rejected is not None) == sorted(bad)
    assert sorted((tuple(r.row) for r in got if r.row is not None), key=str) == sorted([(1, "a"), (None, None), (None, None), (None, '{"id": 4}')], key=str)
    assert all((r.row is None) != (r.rejected is None) for r in got)


def test_arrays_are_checked_element_by_element(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"id": 1, "name": "a"}, 7, None, "x", [2], {"id": 2}], indent=1))
    (tmp_path / "in" / "b.json").write_text("no json")
    (tmp_path / "in" / "c.json").write_text("[]")
    got = readers.checked(spark, str(tmp_path / "in"), ROW, lines=False).collect()
    assert sorted(r.row.id for r in got if r.row) == [1, 2]
    assert sorted(r.rejected for r in got if r.rejected is not None) == sorted(["7", "null", '"x"', "[2]", "no json"])


def test_keyed_objects(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps({"1": {"id": 1, "name": "a"}, "2": {"id": 2}}, indent=2))
    assert sorted(tuple(r) for r in readers.collection(spark, str(tmp_path / "one"), ROW, keyed=True).collect()) == [(1, "a"), (2, None)]
    path = _lines(tmp_path / "many", ['{"1": {"id": 1, "name": "a"}}', '{"2": {"id": 2}, "3": {"id": 3}}'])
    assert sorted(r.id for r in readers.collection(spark, path, ROW, keyed=True, lines=True).collect()) == [1, 2, 3]


def test_artifacts_have_names_and_types(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.json", "deep/b.md", "deep/c"):
        (tmp_path / "in" / name).write_text("x\ny")
    got = readers.artifacts(spark, str(tmp_path / "in")).collect()
    assert {(r.name, r.media_type, r.text) for r in got} == {("a.json", "application/json", "x\ny"), ("b.md", "text/markdown", "x\ny"), ("c", "text/plain", "x\ny")}


def test_a_failed_write_leaves_the_published_rows(spark, tmp_path):
    root, rows = str(tmp_path / "root"), spark.createDataFrame([(1, "a"), (2, "b")], ROW)
    assert readers.published(spark, root, ROW).count() == 0
    assert readers.publish(rows, root) == 1
    broken = spark.range(100, numPartitions=4).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit("n")).cast("string").alias("name"))
    with pytest.raises(Exception, match="lost"):
        readers.publish(broken, root)
    assert sorted(tuple(r) for r in readers.published(spark, root, ROW).collect()) == [(1, "a"), (2, "b")]
    assert readers.publish(rows.where("id = 2"), root) == 2
    assert [tuple(r) for r in readers.published(spark, root, ROW).collect()] == [(2, "b")]
    readers.publish(rows.limit(0), root)
    assert readers.published(spark, root, ROW).count() == 0


def _files(path):
    return {os.path.join(os.path.basename(at), f) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_the_touched_buckets_alone(spark, tmp_path):
    path, rows = str(tmp_path / "table"), spark.range(200).select("id", F.lit("old").alias("name")).to(ROW)
    readers.create_bucketed(rows, path, ["id"], 8)
    before = _files(path)
    batch = spark.createDataFrame([(3, "new"), (1000, "new")], ROW)
    merge = lambda old, new: old.join(new, "id", "left_anti").unionByName(new)
    touched = {r.b for r in batch.select(readers.bucket_of(["id"], 8).alias("b")).collect()}
    for _ in range(2):  # the second is a replay
        readers.merge_bucketed(batch, path, ROW, ["id"], 8, merge)
        got = {r.id: r.name for r in readers.bucketed(spark, path, ROW).collect()}
        assert got == {i: "new" if i in (3, 1000) else "old" for i in [*range(200), 1000]}
        kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
        assert kept and kept == before & _files(path)
    readers.merge_bucketed(batch.limit(0), path, ROW, ["id"], 8, merge)
    assert readers.bucketed(spark, path, ROW).count() == 201


def test_notifications_merge_in_buckets_of_managers(spark, tmp_path):
    from driftspark.operators.evidence import upsert_notifications

    state = spark.createDataFrame([("m", "a", "2024-01-01", True, 9), ("m", "c", "2024-01-01", True, 3), ("n", "a", "2024-01-01", True, 1)], "rm_id string, alert_id string, first_seen string, active boolean, position int")
    path = str(tmp_path / "state")
    readers.create_bucketed(state, path, ["rm_id"], 16)
    run = spark.createDataFrame([("m", "a", "2024-02-01", 1), ("m", "b", "2024-02-01", 2)], "rm_id string, alert_id string, seen string, policy_rank int")
    arrived = run.select("rm_id", "alert_id", F.col("seen").alias("first_seen"), F.lit(True).alias("active"), F.col("policy_rank").alias("position"))
    merge = lambda old, new: upsert_notifications(old, new.select("rm_id", "alert_id", F.col("first_seen").alias("seen"), F.col("position").alias("policy_rank")))
    for _ in range(2):
        readers.merge_bucketed(arrived, path, state.schema, ["rm_id"], 16, merge)
        got = readers.bucketed(spark, path, state.schema).drop("bucket").collect()
        assert sorted(map(tuple, got)) == [("m", "a", "2024-01-01", True, 1), ("m", "b", "2024-02-01", True, 2), ("m", "c", "2024-01-01", False, 3), ("n", "a", "2024-01-01", True, 1)]
