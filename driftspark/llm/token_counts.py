"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content plus a digest of the tokenizer file. Texts are joined to the
cache by that key; only distinct misses are encoded, and their counts are appended to the cache. Normalising folds
runs of white space for tokenizers that drop it; for all others the key is of the exact bytes, so texts that share a key
share a count.

Each run appends its misses in a folder of its own below the cache, so that runs at the same time never touch each other's
files. Two such runs may both append a content; its counts are equal, and readers take one.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import shared_dir, store, table

#: Distinct words whose counts a task keeps; the memory that holds them starts afresh beyond.
WORDS_KEPT = 1 << 20

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def _encoder(definition: str | bytes):
    """texts -> token counts by the library of that kind of file: a .json text or the bytes of a .model."""
    if isinstance(definition, bytes):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=definition)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def version_of(definition: str | bytes) -> str:
    return hashlib.sha256(definition if isinstance(definition, bytes) else definition.encode()).hexdigest()


def drops_white_space(definition: str | bytes) -> bool:
    """Whether white space alone separates what the tokenizer encodes: then a text's count is the sum over its words.

    True for a tokenizer that folds white space, splits on a pattern without it and drops the rest, and whose added
    tokens hold none and take none from their sides.
    """
    if isinstance(definition, bytes):
        return False
    spec = json.loads(definition)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    normal = (spec.get("normalizer") or {}).get("normalizers") or []
    folds = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in normal)
    plain = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    return folds and plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and r"[^\s" in (first.get("pattern") or {}).get("Regex", "")


def counter(definition: str | bytes):
    """texts (bytes) -> token counts, as the tokenizer's library gives them without added special tokens."""
    encode = _encoder(definition)
    by_word = drops_white_space(definition)
    known: dict[bytes, int] = {}

    def count(texts: list[bytes]) -> list[int]:
        if not by_word:
            return encode([t.decode() for t in texts])
        if len(known) > WORDS_KEPT:
            known.clear()
        split = [t.split() for t in texts]
        new = list({w for ws in split for w in ws if w not in known})
        known.update(zip(new, encode([w.decode() for w in new]), strict=True))
        get = known.__getitem__
        return [sum(map(get, ws)) for ws in split]

    return count


def _encode(definition: str | bytes):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(definition)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n: list[int] = []
            for i in range(0, len(texts), 256):
                n += count(texts[i : i + 256])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.array(n, np.int64))], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts of all runs; an empty table where nothing is stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(path)
    return spark.createDataFrame([], CACHE)


def normalised(text, folds: bool):
    """What a text's digest covers, null as empty: where ``folds``, each run of ASCII white space is one blank, with none at the ends."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r ]+", " ")) if folds else text


def count_tokens(docs: DataFrame, definition: str | bytes, cache_path: str) -> DataFrame:
    """row (a struct of the columns of docs but text), n_bytes, n_tokens: counts from the cache, to which those of new contents are appended.

    definition: the tokenizer file's content, a text for .json and bytes for .model. Null and empty texts have no tokens. Repeated rows and texts are encoded
    once and each row gets the count; a row is never split, so a text of any length is counted whole. Since the columns of docs
    come back inside ``row``, none of them clashes. An empty table gives an empty result and an unchanged cache.
    """
    spark = docs.sparkSession
    version = version_of(definition)
    digest = F.unhex(F.sha2(normalised(F.col("text"), drops_white_space(definition)), 256))
    known = lambda: read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    contents = docs.select(digest.alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    # distinct first, which begins in the tasks that read: copies of a content never meet in one task
    misses = contents.groupBy("digest").agg(F.first("text").alias("text")).join(known().select("digest"), "digest", "left_anti")
    new = misses.mapInArrow(_encode(definition), "digest binary, n_tokens long")
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.parquet(f"{cache_path}/{uuid.uuid4().hex}")
    rest = [c for c in docs.columns if c != "text"]
    keyed = docs.select(digest.alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.struct(*rest).alias("row"))
    # stored before the join, so that a content of very many rows can be split among tasks
    counts = store(known().dropDuplicates(["digest"]), "token-counts")
    return keyed.join(counts, "digest").select("row", "n_bytes", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is kept for each tokenizer and table: a second run over a table encodes nothing, a first one every distinct text."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = hashlib.sha256(f"{version_of(definition)} {sf_dir}".encode()).hexdigest()[:32]
    counted = count_tokens(docs, definition, f"{shared_dir(spark)}/token-cache/{of}")
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
