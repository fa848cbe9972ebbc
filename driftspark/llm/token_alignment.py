"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

A cut is a byte offset at which a token of either side ends. An interval of tokens whose borders are cuts is divided at
the cut nearest the middle of its A tokens, which is looked for among the B ends by bisection, in rings that double
around the middle; both halves are divided in turn, and an interval without a cut inside is a group. All intervals of one
depth, of all texts that a task holds, are divided together.

A link is the pair of tokens that end at a cut. How often each pair of ids is linked in the corpus is counted in two steps:
texts are taken in chunks of some megabytes, each of which names its distinct pairs once with their number, and the sums over
chunks come back to the chunks, not to the texts, so that a pair of nearly every text travels once a chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import slices, store, table, utf8

#: Bytes of text in a chunk (a longer text is one of its own), ids of segments that a task remembers.
CHUNK, IDS_KEPT = 2 << 20, 1 << 21

#: Where no token of either kind reaches across: before a blank between two printable ASCII characters other than blanks.
_SEGMENT = re.compile(r"(?<=[!-~])(?= [!-~])")
_PLAIN = re.compile(r"(?s) [!-~](?:.*[!-~])?")
#: Segments encoded at once, joined.
LOT = 1024


class Side:
    """One tokenizer: texts to ids, and the bytes of each id. A .json definition is encoded as it stands, a .model adds the leading blank itself."""

    def __init__(self, definition: str | bytes):
        if isinstance(definition, bytes):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=definition)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            hexed = lambda i, p: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            self.bytes = [hexed(i, p) for i, p in enumerate(pieces)]
            self.encode = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)
            self.segments = not any("▁" in p.lstrip("▁") for p in pieces)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(definition)
            library.no_truncation()
            library.no_padding()
            library.encode_special_tokens = True
            spec = json.loads(definition)
            characters = _byte_characters()
            decoded = lambda entry: bytes(characters[c] for c in entry) if all(c in characters for c in entry) else entry.encode()
            entries = {i: decoded(t) for t, i in library.get_vocab(with_added_tokens=False).items()}
            self.bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
            self.encode = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            before = spec.get("pre_tokenizer") or {}
            self.segments = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.length = np.array([len(b) for b in self.bytes], np.int64)


def _byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers segments in the order they are asked for; ``new`` holds those not encoded yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.new.append(segment)
        return n


class Encoder:
    """Texts to the ids of both sides, each distinct segment encoded once while it is remembered."""

    def __init__(self, a: str | bytes, b: str | bytes):
        self.sides = (Side(a), Side(b))
        self.segments = all(s.segments for s in self.sides)
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        # segments in the order they were encoded: ids of either side and where each segment's begin; what place a numbered segment has
        self.ids, self.starts = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2
        self.spelt = np.zeros(0, bool)

    def _learn(self) -> None:
        """Encode the new segments: those that begin and end where texts may be cut, joined; others on their own."""
        new, self.numbers.new = self.numbers.new, []
        plain = np.array([self.segments and bool(_PLAIN.fullmatch(p)) for p in new], bool)
        joined = [new[i] for i in np.flatnonzero(plain)]
        alone = [new[i] for i in np.flatnonzero(~plain)]
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        lots = [joined[i : i + LOT] for i in range(0, len(joined), LOT)]
        kept = dict(zip(map("".join, lots), self._read(list(map("".join, lots))), strict=True))
        # a lot that isn't spelt holds a segment that isn't: its segments are encoded one by one
        lots = [x for lot in lots for x in ([lot] if kept["".join(lot)][2] else [[p] for p in lot])] + [[p] for p in alone]
        texts = ["".join(lot) for lot in lots]
        rest = [t for t in texts if t not in kept]
        kept |= dict(zip(rest, self._read(rest), strict=True))
        spelt = np.concatenate([np.full(len(lot), kept[t][2]) for lot, t in zip(lots, texts, strict=True)])
        for k, side in enumerate(self.sides):
            sizes = []
            for lot, text in zip(lots, texts, strict=True):
                ids = kept[text][k]
                ends = np.cumsum(np.fromiter((len(p.encode()) for p in lot), np.int64, len(lot)))
                sizes.append(np.diff(np.searchsorted(np.cumsum(side.length[ids]), ends, "left") + 1, prepend=0) if kept[text][2] else np.zeros(len(lot), np.int64))
            ids, size = np.concatenate([kept[t][k] for t in texts]), np.concatenate(sizes)
            first = np.cumsum(size) - size
            ids = ids[_runs(first[order], size[order])]
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(size[order])])
            self.ids[k] = np.concatenate([self.ids[k], ids])
        self.spelt = np.concatenate([self.spelt, spelt[order]])

    def _read(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """The ids of both sides for each text and whether both spell it; none where they don't."""
        want, none = [t.encode() for t in texts], np.zeros(0, np.int32)
        both = [[np.array(ids, np.int32) for ids in side.encode(texts)] for side in self.sides]
        fine = [all(b"".join(map(s.bytes.__getitem__, ids[n].tolist())) == w for s, ids in zip(self.sides, both, strict=True)) for n, w in enumerate(want)]
        return [(both[0][n], both[1][n], True) if f else (none, none, False) for n, f in enumerate(fine)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side: ids of all texts in turn, and where each text's begin. A text that a side's tokens don't spell has none on either side."""
        if sum(map(len, self.ids)) > IDS_KEPT:
            self._clear()
        number, of, count = self.numbers.__getitem__, [], []
        for text in texts:
            parts = (_SEGMENT.split(" " + text) if self.segments else [" " + text]) if text else []
            of += map(number, parts)
            count.append(len(parts))
        if self.numbers.new:
            self._learn()
        places, count = np.array(of, np.int64), np.array(count, np.int64)
        wrong = np.concatenate([[0], np.cumsum(~self.spelt[places])])[np.concatenate([[0], np.cumsum(count)])]
        fine = np.diff(wrong) == 0
        places = places[np.repeat(fine, count)]
        first = np.concatenate([[0], np.cumsum(np.where(fine, count, 0))])
        out = []
        for ids, starts in zip(self.ids, self.starts, strict=True):
            size = starts[places + 1] - starts[places]
            out.append((ids[_runs(starts[places], size)], np.concatenate([[0], np.cumsum(size)])[first]))
        return out


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all runs that begin at first, in turn."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(first - before, size)


def divide(ea: np.ndarray, eb: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where groups begin among the A tokens, sorted. ea, eb: ascending ends of the tokens; lo, hi: A tokens of intervals whose borders are cuts."""
    leaves = [np.zeros(0, np.int64)]
    lo, hi = lo[hi > lo], hi[hi > lo]

    def shared(at: np.ndarray) -> np.ndarray:
        j = np.searchsorted(eb, ea[at])
        return eb[np.minimum(j, len(eb) - 1)] == ea[at]

    while len(lo):
        middle = (lo + hi - 2) // 2
        cut = np.full(len(lo), -1, np.int64)
        todo, inner, radius = np.flatnonzero(hi - lo > 1), 0, 0
        while len(todo):  # tokens at a distance of inner..radius on both sides of the middle
            m = middle[todo]
            left, right = np.maximum(lo[todo], m - radius), np.minimum(hi[todo] - 2, m + radius)
            n = right - left + 1
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = np.arange(n.sum()) + np.repeat(left - begin, n)
            far = np.abs(at - np.repeat(m, n))
            score = np.where((far >= inner) & shared(at), 2 * far + (at > np.repeat(m, n)), 1 << 60)
            best = np.minimum.reduceat(score, begin)
            found = best < 1 << 60
            cut[todo[found]] = m[found] + np.where(best[found] % 2, best[found] // 2, -(best[found] // 2))
            more = ~found & ((m - radius > lo[todo]) | (m + radius < hi[todo] - 2))
            todo, inner, radius = todo[more], radius + 1, 2 * radius + 1
        leaves.append(lo[cut < 0])
        at = cut >= 0
        # halves stay in the order of the text: ascending ends are looked for faster
        lo, hi = np.stack([lo[at], cut[at] + 1], axis=1).ravel(), np.stack([cut[at] + 1, hi[at]], axis=1).ravel()
    return np.sort(np.concatenate(leaves))


def align_texts(encoder: Encoder, texts: list[str]) -> dict:
    """Tokens, groups and links of texts: n_a, n_b, n_groups (an array each), where each group's tokens begin, and the ids that end together."""
    (a, sa), (b, sb) = encoder.encode(texts)
    side_a, side_b = encoder.sides
    ea, eb = np.cumsum(side_a.length[a]), np.cumsum(side_b.length[b])
    first = divide(ea, eb, sa[:-1], sa[1:])
    last = np.append(first[1:], len(a))[: len(first)] - 1
    last_b = np.searchsorted(eb, ea[last])
    first_b = np.concatenate([[0], last_b[:-1] + 1]) if len(first) else first
    per_text = np.diff(np.searchsorted(first, sa))
    return {"a": a, "b": b, "first_a": first, "first_b": first_b, "link_a": a[last], "link_b": b[last_b], "n_a": np.diff(sa), "n_b": np.diff(sb), "n_groups": per_text}


class Writer:
    """Groups as text: ids of A, a bar, ids of B, groups apart by semicolons."""

    def __init__(self, most: int):
        self.words = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], pa.large_string())
        self.most = most

    def write(self, x: dict) -> list[str]:
        na, nb = len(x["a"]), len(x["b"])
        size_a, size_b = np.diff(np.append(x["first_a"], na)), np.diff(np.append(x["first_b"], nb))
        ends = np.cumsum(size_a + size_b)
        at_a = np.arange(na) + np.repeat(x["first_b"], size_a)
        at_b = np.arange(nb) + np.repeat(x["first_a"] + size_a, size_b)
        key = np.empty(na + nb, np.int64)
        key[at_a], key[at_b] = x["a"], x["b"]
        key[ends - 1] += 2 * self.most
        key[at_a[x["first_a"] + size_a - 1]] += self.most
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(x["n_groups"])])]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cut), self.words.take(pa.array(key))), pa.scalar("", pa.large_string()))
        return [g[:-1] for g in joined.to_pylist()]


_FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64())]


def _aligned(a: str | bytes, b: str | bytes, digest: bool):
    """Arrow function: a row for each text, with the places of its links among its chunk's pairs, and one for each chunk, with these pairs and their numbers."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(a, b)
        writer = Writer(max(len(s.bytes) for s in encoder.sides))
        names = ["chunk", "row", "groups", "links", "pair_a", "pair_b", "pair_n", *[n for n, _ in _FIELDS]]
        for batch in batches:
            for lo, hi in slices(utf8(batch.column("text"))[1], CHUNK):
                x = align_texts(encoder, [t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()])
                groups = writer.write(x)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                code = x["link_a"].astype(np.int64) << 32 | x["link_b"].astype(np.int64)
                pairs, place, n = np.unique(code, return_inverse=True, return_counts=True)
                place = place.astype(np.uint32)
                cut = np.concatenate([[0], np.cumsum(x["n_groups"])])
                links = [place[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                chunk, k = uuid.uuid4().hex, hi - lo
                values = [pa.array([chunk] * k), batch.column("row").slice(lo, k), pa.array(groups, pa.string()), pa.array(links, pa.binary())]
                values += [pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*values, *[pa.array(x[c].astype(np.int64), t) for c, t in _FIELDS]], names=names)
                values = [pa.array([chunk]), pa.nulls(1, batch.schema.field("row").type), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
                values += [pa.array([(pairs >> 32).astype(np.int32)], pa.list_(pa.int32())), pa.array([(pairs & 0xFFFFFFFF).astype(np.int32)], pa.list_(pa.int32())), pa.array([n.astype(np.int64)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*values, *[pa.nulls(1, t) for _, t in _FIELDS]], names=names)

    return run


def _summed(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of a chunk with the corpus-wide numbers of its pairs."""
    slot = pairs["slot"].to_numpy()
    count, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    count[slot], best[slot] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
    links = [np.frombuffer(x, np.uint32) for x in texts["links"].to_pylist()]
    out = texts.drop_columns(["chunk", "links"])
    for name, values in (("n_links", [len(x) for x in links]), ("n_best", [int(best[x].sum()) for x in links]), ("count_sum", [int(count[x].sum()) for x in links])):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out


def align(docs: DataFrame, a: str | bytes, b: str | bytes, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs) of docs(text, ...) under two tokenizers, given as the content of a .json (text) or a .model (bytes); b adds the leading blank.

    texts: row (a struct of the columns of docs but text), n_a, n_b, n_groups, n_links, n_best (links whose pair is linked as often as any
    of its B id's), count_sum (over links) and groups, 'a1,a2|b1;a3|b2,b3' in ids, or with ``digest`` its SHA-256. pairs: a, b, n, best: how often
    two ids are linked in all texts, and whether no pair of that b is linked more often.

    A null or empty text, and one that either side's tokens don't spell byte by byte after a blank, has no tokens: zeros and an empty ``groups``.
    Repeated rows count each. A text is aligned whole, in one task, whatever its length: it takes memory for its tokens,
    and no more time than in proportion to them. An empty table gives empty results. The columns of docs come back inside ``row``,
    so none clashes. Chunks are named at random and written once, before they are counted: a lost executor can't change them later.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*rest).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"chunk string, row {kind}, groups string, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>, n_a long, n_b long, n_groups long"
    aligned = store(rows.mapInArrow(_aligned(a, b, digest), schema), "aligned")
    slots = aligned.where("pair_a is not null").select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("slot", "p")).select("chunk", "slot", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("m"))
    counts = slots.groupBy("a", "b").agg(F.sum("m").alias("n"))
    pairs = store(counts.withColumn("best", F.col("n") == F.expr("max(n) over (partition by b)")), "alignment-pairs")
    known = slots.join(pairs, ["a", "b"]).select(F.col("chunk").alias("of"), "slot", "n", F.col("best").cast("int").alias("best"))
    texts = aligned.where("pair_a is null").select("chunk", "row", "n_a", "n_b", "n_groups", "groups", "links")
    done = texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_summed, f"row {kind}, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long")
    return done, pairs


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents under byte_bpe_50k.json and piece_bpe_32k.model; counts are over all documents."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        b = f.read()
    texts, _ = align(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b, digest=True)
    return texts.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
