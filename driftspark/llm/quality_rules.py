"""Quality rules with adaptive thresholds.

Each rule is a ratio of two counts of a text, in whole numbers. Its quantiles come from a sketch for each language and source:
the counts of the rule's values rounded down to BITS significant bits, so a quantile is exact up to one part in 2**(BITS - 1).
Sketches merge by adding counts, which is one aggregate: partial sums in the tasks, and from (language, source) to the language
to all for groups of too few documents. A rule's bounds are the group's outer fences, its quartiles plus and minus
FENCE times their distance, and each document is joined to the bounds of its group.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import SPACE, drop, grams, mix, slices, spans, store, table, utf8

#: Significant bits of a value in a sketch, and documents that a group needs for bounds of its own.
BITS, ENOUGH = 6, 100
FENCE = 3
#: Tasks among which the documents of one language and source are joined to its bounds.
SALTS = 16

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


class Rule(NamedTuple):
    """scale * part div whole, whose quartiles count as at least ``slack`` apart; a low value fails only with ``low``."""

    name: str
    part: str
    whole: str
    scale: int
    slack: int
    low: bool = False


RULES = (
    Rule("word_length", "word_chars", "n_words", 1000, 200, low=True),
    Rule("symbols", "n_symbols", "word_chars", 10_000, 100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 10_000, 1000),
    Rule("repeated_words", "n_repeat_words", "n_words", 10_000, 1000),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of each text."""
    n = len(offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    in_word = ~SPACE[data]
    h, rows, _, _ = spans(data, offsets, SPACE)
    line, line_rows, first, last = spans(data, offsets, NEWLINE)
    seen = np.concatenate([[0], np.cumsum(in_word)])
    worded = seen[last] > seen[first]
    line, line_rows = line[worded], line_rows[worded]
    n_lines = np.bincount(line_rows, minlength=n)
    # the row is mixed into a hash, so that equal values are those of one text
    distinct = np.unique(mix(line + line_rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    n_dup = n_lines - np.bincount(line_rows[distinct], minlength=n)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        whole = np.flatnonzero(rows[:-2] == rows[2:])
        g = mix(grams(h, 3)[whole] + rows[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(g, return_inverse=True, return_counts=True)
        again = whole[counts[inverse] > 1]
        for j in range(3):
            covered[again + j] = True
    return [np.bincount(rows, minlength=n), total(in_word & ((data & 0xC0) != 0x80)), total(SYMBOL[data]), n_lines, n_dup, np.bincount(rows[covered], minlength=n)]


def _count(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for lo, hi in slices(offsets):
            part = text_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), *[pa.array(x.astype(np.int64)) for x in part]], names=["row", *COUNTS])


def count_texts(docs: DataFrame) -> DataFrame:
    """row (a struct of the columns of docs but text) and the COUNTS of each whole text, a null one as empty.

    Words are runs of other than ASCII white space; word_chars their code points; n_symbols the characters # * $ % & | < >;
    n_lines the lines with a word, n_dup_lines those equal to an earlier line; n_repeat_words the words in three-word
    windows that the text holds twice or more. Time and memory of a very long text grow in proportion to it, in one task.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*rest).alias("row"))
    return rows.mapInArrow(_count, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    """Fixed rules that precede the adaptive ones: under 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def value(rule: Rule) -> Column:
    return F.expr(f"{rule.scale} * {rule.part} div greatest({rule.whole}, 1)")


def rounded(v: Column) -> Column:
    """A value of 0 or more, rounded down to BITS significant bits."""
    drop_bits = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop_bits), drop_bits)


def sketch(counted: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keys, rule, value, n: how many rows of each group have each rounded value. Two sketches merge by adding n."""
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), rounded(value(r)).alias("value")) for r in rules])
    return counted.select(*keys, F.inline(each)).groupBy(*keys, "rule", "value").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], percents: tuple[int, ...] = (25, 75)) -> DataFrame:
    """keys, rule, n and q<percent>: the smallest value that so many of a group's rows don't exceed."""
    by = [*keys, "rule"]
    # a group's rows here are its rounded values, some dozens for each doubling of the value
    up_to = "sum(n) over (partition by " + ", ".join(by) + " order by value)"
    all_n = "sum(n) over (partition by " + ", ".join(by) + ")"
    ranked = sketches.select(*by, "value", "n", F.expr(up_to).alias("up_to"), F.expr(all_n).alias("all_n"))
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), *[F.min(F.when(100 * F.col("up_to") >= p * F.col("all_n"), F.col("value"))).alias(f"q{p}") for p in percents])


def bounds(sketches: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES, enough: int = ENOUGH) -> DataFrame:
    """keys, least and most (maps rule -> bound) for each group of ``keys``: from its own sketch where it has ``enough`` rows, else
    from that of its first key, else from all rows. A rule without ``low`` has no entry in least."""
    own = quantiles(sketches, keys)
    wide = quantiles(merge(sketches, keys[:1]), keys[:1]).select(keys[0], "rule", *[F.col(c).alias(f"{c}_1") for c in ("n", "q25", "q75")])
    every = quantiles(merge(sketches, []), []).select("rule", *[F.col(c).alias(f"{c}_2") for c in ("q25", "q75")])
    joined = own.join(wide, [keys[0], "rule"]).join(every, "rule")
    pick = lambda c: F.when(F.col("n") >= enough, F.col(c)).when(F.col("n_1") >= enough, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    slack = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.slack))])
    both = joined.select(*keys, "rule", pick("q25").alias("q25"), pick("q75").alias("q75"), slack[F.col("rule")].alias("slack"))
    reach = FENCE * F.greatest(F.col("q75") - F.col("q25"), F.col("slack"))
    low = [r.name for r in rules if r.low]
    entry = lambda bound: F.map_from_entries(F.array_compact(F.collect_list(bound)))
    least = F.when(F.col("rule").isin(low), F.struct("rule", (F.col("q25") - reach).alias("bound")))
    return both.groupBy(*keys).agg(entry(least).alias("least"), entry(F.struct("rule", (F.col("q75") + reach).alias("bound"))).alias("most"))


def quality(docs: DataFrame, keys: tuple[str, str] = ("lang", "source"), rules: tuple[Rule, ...] = RULES, enough: int = ENOUGH) -> DataFrame:
    """docs(text, *keys, ...) -> row (a struct of its columns but text), the COUNTS, base_failed, failed (names of adaptive rules), kept.

    The sketches hold all documents that the fixed rules keep; those rejected by them have no adaptive verdict, an empty ``failed``.
    A null key counts as an empty text. Repeated rows count each; a null or empty text has counts of 0 and fails. An empty table gives an
    empty result. Very long texts are counted whole. Since the columns of docs come back inside ``row``, none of them clashes.
    """
    counted = store(count_texts(docs), "quality-counts")
    by = [f"_{k}" for k in keys]
    keyed = counted.select("*", *[F.coalesce(F.col(f"row.{k}").cast("string"), F.lit("")).alias(b) for k, b in zip(keys, by, strict=True)], base_failed().alias("base_failed"))
    sketches = store(sketch(keyed.where("not base_failed"), by, rules), "quality-sketches")
    limits = store(bounds(sketches, by, rules, enough), "quality-bounds")
    salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = keyed.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, [*by, "_salt"], "left")
    low = lambda r: F.coalesce(value(r) < F.element_at("least", F.lit(r.name)), F.lit(False)) if r.low else F.lit(False)
    cases = [F.when(~F.col("base_failed") & (low(r) | (value(r) > F.element_at("most", F.lit(r.name)))), r.name) for r in rules]
    out = joined.select("row", *COUNTS, "base_failed", F.array_compact(F.array(*cases)).alias("failed"))
    drop(sketches)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; nothing is learned from labels. Columns as the contract names them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS MATERIALIZED (SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT g.r, g.i FROM g JOIN (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1) m ON m.r = g.r AND m.g = g.g),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS MATERIALIZED (SELECT d.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS MATERIALIZED (SELECT r, lang, source, unnest([
    {'rule': 'word_length', 'v': 1000 * word_chars // greatest(n_words, 1), 'slack': 200}, {'rule': 'symbols', 'v': 10000 * n_symbols // greatest(word_chars, 1), 'slack': 100},
    {'rule': 'repeated_lines', 'v': 10000 * n_dup_lines // greatest(n_lines, 1), 'slack': 1000}, {'rule': 'repeated_words', 'v': 10000 * n_repeat_words // greatest(n_words, 1), 'slack': 1000}], recursive := true)
  FROM b WHERE NOT base_failed),
x AS MATERIALIZED (SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS q FROM v),
q2 AS (SELECT lang, source, rule, count(*) AS n, quantile_disc(q, 0.25) AS a, quantile_disc(q, 0.75) AS b FROM x GROUP BY ALL),
q1 AS (SELECT lang, rule, count(*) AS n, quantile_disc(q, 0.25) AS a, quantile_disc(q, 0.75) AS b FROM x GROUP BY ALL),
q0 AS (SELECT rule, quantile_disc(q, 0.25) AS a, quantile_disc(q, 0.75) AS b FROM x GROUP BY ALL),
f AS (SELECT q2.lang, q2.source, q2.rule, CASE WHEN q2.n >= 100 THEN q2.a WHEN q1.n >= 100 THEN q1.a ELSE q0.a END AS a, CASE WHEN q2.n >= 100 THEN q2.b WHEN q1.n >= 100 THEN q1.b ELSE q0.b END AS b
  FROM q2 JOIN q1 USING (lang, rule) JOIN q0 USING (rule)),
bad AS (SELECT DISTINCT v.r FROM v JOIN f USING (lang, source, rule) WHERE v.v > f.b + 3 * greatest(f.b - f.a, slack) OR rule = 'word_length' AND v.v < f.a - 3 * greatest(f.b - f.a, slack))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM b LEFT JOIN bad USING (r)
"""
