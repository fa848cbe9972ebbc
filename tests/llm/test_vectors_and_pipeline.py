"""The embedding join against brute force, the registered queries against SQL, and the pipeline's stages."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import embedding_dedup


def cloud():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=16) * 0.12 * (i % 4)], i % 2) for i in range(90)]
    rows += [(100, rows[3][1], 1), (101, rows[3][1], 1), (102, rows[3][1], None), (103, None, 1), (104, [0.0] * 16, 1), (105, [float("nan")] + [1.0] * 15, 1), (106, [], 1), (107, [None] + [1.0] * 15, 0), (None, rows[5][1], 1), (3, rows[3][1], 1), (108, [1.0, 2.0], 1), (109, [2.0, 4.0], 1), (110, [float("inf")] + [1.0] * 15, 1)]
    return rows


def test_embedding_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 8)
    rows = cloud()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, gid string, n int")
    good = [r[2] is not None and bool(r[1]) and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = (np.array(np.float32(x), float) for x in (a[1], b[1]))
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min([x for x in (least.get(top(i)), r[0]) if x is not None], default=None)
    want = Counter((r[0], n[i], least[top(i)], r[0] == least[top(i)]) for i, r in enumerate(rows))
    got = Counter((r.row.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_range_join_finds_the_pairs_within_reach(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS", 16)
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(70, 3)), rng.normal(size=(131, 3))
    y[:5] = x[:5] + 0.25
    got = [(int(i), int(j)) for a, b in embedding_dedup._range_join(x, y, 0.25 + 1e-12) for i, j in zip(a, b, strict=True)]
    assert sorted(got) == [(i, j) for i in range(70) for j in range(131) if (np.abs(x[i] - y[j]) <= 0.25 + 1e-12).all()]


def test_few_pairs_of_a_label_get_a_distance(spark):
    """On the largest label of sf0.1, all blocks together give a distance to less than a tenth of all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    v = embedding_dedup._unit(np.stack(df[df.label == df.label.mode()[0]].embedding))
    n, width = v.shape
    rotated, edge = v @ embedding_dedup.rotation(width), embedding_dedup.edges_of(width)
    compared = 0
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        reach = np.sqrt((2 - 2 * embedding_dedup.COSINE) * (hi - lo) / width)
        compared += sum(int((i < j).sum()) for i, j in embedding_dedup._range_join(rotated[:, lo:hi], rotated[:, lo:hi], reach))
    assert compared < 0.1 * n * (n - 1) / 2


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "near-dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(sf + "/documents.parquet")
    clean = p.drop_contaminated(spark, docs, sf)
    assert clean.columns == docs.columns
    from tests.llm.test_text_operators import brute_hits

    items = [tuple(r) for r in spark.read.parquet(sf + "/benchmark.parquet").select("item_id", "text").collect()]
    some = {r.doc_id: r.text for r in docs.where("n_chars < 1500").collect()}
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    assert all((i in left) == (brute_hits(t, items)[1] == 0) for i, t in some.items())
    one = p.drop_near_duplicates(spark, docs, sf)
    assert one.columns == docs.columns and one.count() == one.select("doc_id").distinct().count() < docs.count()
    assert p.shard(spark, one, sf).count() == one.count()


def test_pipeline_python_tasks_hold_few_texts(spark, sf):
    """The stages that send whole texts to Python send at most ROWS of them at once; a smaller bound of the session stays."""
    import corpus_pipeline as p

    docs = spark.createDataFrame([(-1, None, "en", "x", None)], "doc_id long, text string, lang string, source string, n_chars long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for stage in (p.drop_toxic, p.drop_near_duplicates, p.drop_contaminated):
            for given, want in (("10000", p.ROWS), ("0", p.ROWS), ("7", 7)):
                spark.conf.set(key, given)
                assert stage(spark, docs, sf).count() == 1 and int(spark.conf.get(key)) == want <= 1000
    finally:
        spark.conf.unset(key)


def test_inputs_of_words_are_made_a_portion_at_a_time(monkeypatch):
    """Portions change no value, and bound what is held beside the result."""
    import tracemalloc

    from driftspark.llm import toxicity

    rng = np.random.default_rng(4)
    length = rng.integers(1, 12, 120_000)
    data, ends = rng.integers(97, 123, length.sum()).astype(np.uint8), np.cumsum(length)
    words, h, net = (data, ends - length, ends), rng.integers(0, 2**63, len(length)).astype(np.uint64), toxicity.new_network()
    tracemalloc.start()
    found = toxicity.word_inputs(*words, h)
    x = toxicity.embed(net, *found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes + sum(a.nbytes for a in found) + (12 << 20)
    monkeypatch.setattr(toxicity, "PORTION", len(length))
    whole = toxicity.word_inputs(*words, h)
    assert all((a == b).all() for a, b in zip(found, whole, strict=True)) and (toxicity.embed(net, *whole) == x).all()


def test_a_filter_travels_packed_and_is_not_part_of_the_code(spark, sf, monkeypatch):
    """The bitmap of the items' fingerprints isn't pickled with the function that reads it, and tells the same packed as unpacked."""
    from pyspark import cloudpickle

    from driftspark.llm import common, decontamination

    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").limit(5) for t in ("documents", "benchmark"))
    sizes, frame = [], type(docs)
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: sizes.append(len(cloudpickle.dumps(f))) or whole(self, f, *a, **b))
    decontamination.contamination(docs.select("text", "doc_id"), items)
    assert sizes and max(sizes) < 1 << 18
    rng = np.random.default_rng(6)
    bits, values = rng.integers(0, 256, common.FILTER_BITS // 8).astype(np.uint8), rng.integers(0, 2**63, 50_000).astype(np.uint64)
    assert (common.filter_has(bits, values) == (np.unpackbits(bits)[common.filter_at(values)] == 1)).all()


def test_raking_reads_its_cells_twice_in_a_plan(spark, monkeypatch):
    """However many marginals there are, each query of a round holds its stored cells twice at most."""
    from driftspark.llm import mixing

    reads, store = [], mixing.store
    monkeypatch.setattr(mixing, "store", lambda df, name: reads.append(df._jdf.queryExecution().analyzed().toString().count("parquet")) or store(df, name))
    cells = spark.createDataFrame([(s, l, t, n) for n, (s, l, t) in enumerate(zip("ababba", "xyxyxx", "pqqppq", strict=True), 3)], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.4, "b": 0.6}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.7, "q": 0.3}}
    targets = {by: mixing.completed(cells, by, t) for by, t in goal.items()}
    found, off = mixing.rake(cells, targets, tolerance=0.01)
    assert len(reads) > 3 and max(reads) == 2 and found.count() == 6
    mass = F.sum(F.col("factor") * F.col("tokens")) / sum(range(3, 9))
    for by, t in goal.items():
        assert off[by] == pytest.approx(max(abs(r.share - t[r[by]]) for r in found.groupBy(by).agg(mass.alias("share")).collect()), abs=1e-9)
