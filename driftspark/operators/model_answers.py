"""A model's raw answers about documents: read as variants of any shape, checked against the vocabulary and the source, routed by status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions import rules
from driftspark.operators.discovery import folded

#: Keys under which an answer may hold its candidates, the first that holds any counts.
CANDIDATE_KEYS = ("signal_candidates", "signals", "candidates", "signal_candidate")
#: Characters of an excerpt or sentence that stands in for a quote.
QUOTE = 500


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def first_object(raw: Column) -> Column:
    """The first balanced {...} of a text that isn't JSON as a whole, by an Arrow-batched scan."""

    @F.pandas_udf("string")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            depth, start, quoted, escaped = 0, -1, False, False
            for i, c in enumerate(text or ""):
                if quoted:
                    quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
                elif c == '"' and depth:
                    quoted = True
                elif c == "{":
                    start = i if depth == 0 else start
                    depth += 1
                elif c == "}" and depth:
                    depth -= 1
                    if depth == 0:
                        return text[start : i + 1]
            return None

        for t in texts:
            yield t.map(one)

    return scan(raw)


def _spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def parse(answers: DataFrame) -> DataFrame:
    """answers(raw, ...) with ``payload``, the answer as a variant object, null where there is none.

    White space is folded and a code fence dropped. A text that is JSON as a whole counts as it is, and is no answer if it isn't an object; of another
    text the first balanced object counts. Only those texts are scanned in Python. An object that repeats a key is none.
    """
    bare = _spaces(F.regexp_replace(_spaces(F.col("raw")), r"(?i)^```(?:json)?|```$", ""))
    read = answers.withColumn("_bare", bare).withColumn("_whole", F.try_parse_json("_bare"))
    fine = read.where("_whole is not null").withColumn("payload", F.col("_whole"))
    rest = read.where("_whole is null").withColumn("payload", F.try_parse_json(first_object(F.col("_bare"))))
    kind = F.schema_of_variant("payload")
    return fine.unionByName(rest).withColumn("payload", F.when(kind.startswith("OBJECT"), F.col("payload"))).drop("_bare", "_whole")


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _let(value: Column, body) -> Column:
    """body(value), with the value bound, so that an expression that uses it often holds it once."""
    return F.get(F.transform(F.array(value), body), 0)


def _holds(v: Column) -> Column:
    """Whether a value says anything: not missing, null, empty, zero or false."""
    return F.coalesce((F.schema_of_variant(v) != "VOID") & ~F.to_json(v).isin('""', "[]", "{}", "0", "0.0", "false"), F.lit(False))


def said(v: Column) -> Column:
    """A value as text with its white space folded; one that says nothing is empty."""
    text = F.when(F.schema_of_variant(v) == "STRING", _at(v, "$", "string")).otherwise(F.to_json(v))
    return F.when(_holds(v), _spaces(text)).otherwise("")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def flag(v: Column) -> Column:
    """A boolean, or a text true, yes, false or no; null for anything else."""
    low = F.lower(F.trim(_at(v, "$", "string")))
    return F.when(F.schema_of_variant(v).isin("BOOLEAN", "STRING"), F.when(low.isin("true", "yes"), True).when(low.isin("false", "no"), False))


def _confidence(v: Column) -> tuple[Column, Column]:
    """(value within 0..1 to two decimals, warning): a number as it is; a text without its % sign, in percent where over 1; else 0.7."""
    kind = F.schema_of_variant(v)
    text = _at(v, "$", "string")
    number = F.regexp_replace(F.trim(text), "%", "").try_cast("double")
    as_text = F.when(number > 1, number / 100).otherwise(number)
    numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    bare = F.when(kind == "BOOLEAN", _at(v, "$", "boolean").cast("double")).otherwise(_at(v, "$", "double"))
    value = F.when(kind == "STRING", as_text).when(numeric, bare)
    missing = F.when(kind == "STRING", F.concat(F.lit("Unsupported confidence '"), _spaces(text), F.lit("' normalized to 0.7."))).otherwise("Missing confidence normalized to 0.7.")
    warning = F.when(value.isNull(), missing).when((value < 0) | (value > 1), F.concat(F.lit("Out-of-range confidence '"), text, F.lit("' clamped into 0..1.")))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.7)))), 2), warning


_TEXTS = ("signal_type", "severity_suggestion", "claim", "reason", "verbatim_evidence", "effective_date")


class _Columns:
    """The columns of a candidate under way."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c_{name}")


def _checked(rows: DataFrame, types: dict[str, list[str]]) -> DataFrame:
    """rows with a candidate ``c``, an object of any shape, beside its document's columns -> the candidate's checked columns too.

    Made in steps of columns over those of the one before, so that no value is computed again for each use.
    """
    x = _Columns()
    fields_of = F.create_map(*[x for t, fs in types.items() for x in (F.lit(t), F.array(*map(F.lit, sorted(fs))))])
    every_field = F.array(*map(F.lit, sorted({f for fs in types.values() for f in fs})))
    quoted = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    single = lambda *w: F.array_compact(F.array(*w))
    none = F.array().cast("array<string>")
    alias = lambda f: F.coalesce(F.try_element_at(_literal_map(rules.FIELD_ALIASES), f), f)

    def read() -> dict[str, Column]:
        c = F.col("c")
        raw = _at(c, "$.changed_kyc_fields")
        fields = F.when(F.schema_of_variant(raw).startswith("ARRAY"), _at(raw, "$", "array<variant>")).otherwise(F.array(raw))
        texts = {k: said(_at(c, f"$.{k}")) for k in _TEXTS}
        dated = F.coalesce(F.schema_of_variant(_at(c, "$.effective_date")) != "VOID", F.lit(False))
        return texts | {"fields_said": F.transform(fields, said), "conf": _at(c, "$.confidence"), "dated": dated, "review": flag(_at(c, "$.needs_human_review"))}

    def named() -> dict[str, Column]:
        name = slug(x["signal_type"])
        fields = F.transform(x["fields_said"], lambda f: F.struct(f.alias("said"), slug(f).alias("slug")))
        return dict(name=name, slugs=fields, quote=folded(x["verbatim_evidence"]), severity=F.lower(x["severity_suggestion"]))

    def typed() -> dict[str, Column]:
        name = F.coalesce(F.try_element_at(_literal_map(rules.SIGNAL_TYPE_ALIASES), x["name"]), x["name"])
        fields = F.transform(x["slugs"], lambda f: F.struct(f["said"].alias("said"), alias(f["slug"]).alias("field")))
        expected = F.filter(F.coalesce("expected", none), lambda t: t.isin(list(types)))
        kind = F.when(name.isin(list(types)), name).otherwise(F.coalesce(F.get(expected, 0), F.lit("business_activity_change")))
        stands = (x["quote"] != "") & F.contains(F.col("_folded"), x["quote"])
        return dict(known=name.isin(list(types)), kind=kind, fields=fields, stands=stands)

    def fielded() -> dict[str, Column]:
        allowed = F.try_element_at(fields_of, x["kind"])
        targeted = F.filter(F.transform(F.coalesce("targeted", none), lambda f: alias(slug(f))), lambda f: F.array_contains(allowed, f))
        kept = F.transform(F.filter(x["fields"], lambda f: F.array_contains(allowed, f["field"])), lambda f: f["field"])
        foreign = F.filter(x["fields"], lambda f: ~F.array_contains(allowed, f["field"]) & F.array_contains(every_field, f["field"]))
        day = x["effective_date"]
        origin = F.when(~x["dated"], "null").when(~day.rlike(r"^\d{4}-\d{2}-\d{2}$"), "invalid_model_date_normalized_to_null").when(F.coalesce(day == F.col("published_at"), F.lit(False)), "document_published_at").when(F.contains("_text", day), "document_text").otherwise("model_supplied_date_not_in_source_normalized_to_null")
        confidence, warning = _confidence(x["conf"])
        return dict(first=F.get(allowed, 0), kept=kept, foreign=F.transform(foreign, lambda f: f["said"]), targeted=targeted, origin=origin, confidence=confidence, warn_confidence=warning)

    def finished() -> dict[str, Column]:
        kind, severity, origin = x["kind"], x["severity"], x["origin"]
        no_fields = (F.size(x["kept"]) == 0) & (F.size(x["targeted"]) == 0)
        fields = F.when(F.size(x["kept"]) > 0, x["kept"]).when(F.size(x["targeted"]) > 0, x["targeted"]).otherwise(F.array(x["first"]))
        fine = severity.isin(*rules.SEVERITIES)
        shown = lambda c: F.when(c == "", "<empty>").otherwise(c)
        evidence = F.when(x["stands"], x["verbatim_evidence"]).when(F.col("_excerpt") != "", F.substring("_excerpt", 1, QUOTE)).when(F.col("_sentence") != "", F.substring("_sentence", 1, QUOTE)).otherwise(F.substring("_name", 1, QUOTE))
        replaced = F.when(F.col("_excerpt") != "", "Quote was not exact; replaced with collected source excerpt.").when(F.col("_sentence") != "", "Quote was not exact; replaced with first source sentence.").otherwise("Quote was not exact and source text was empty; using title as evidence quote.")
        warnings = [
            single(F.when(~x["known"], quoted("Unsupported signal_type '", shown(x["signal_type"]), "' mapped to '", kind, "'."))),
            F.transform(x["foreign"], lambda f: quoted("Field '", f, "' is not supported for ", kind, "; ignored.")),
            single(
                F.when(no_fields, quoted("Missing supported changed_kyc_fields; inferred '", x["first"], "' for ", kind, ".")),
                F.when(~fine, quoted("Unsupported severity_suggestion '", shown(severity), "' normalized to 'medium'.")),
                x["warn_confidence"],
                F.when(~x["stands"], replaced),
                F.when(origin == "invalid_model_date_normalized_to_null", "effective_date was not YYYY-MM-DD; normalized to null.").when(origin == "model_supplied_date_not_in_source_normalized_to_null", "effective_date was not present in source text; normalized to null."),
                F.when(x["review"].isNull(), quoted(kind, " needs_human_review was not boolean; normalized to true.")).when(~x["review"], "needs_human_review was false; forced to true for model-derived evidence."),
            ),
        ]
        return {
            "signal_type": kind,
            "fields": F.array_sort(F.array_distinct(fields)),
            "severity": F.when(fine, severity).otherwise("medium"),
            "confidence": x["confidence"],
            "claim": F.when(x["claim"] != "", x["claim"]).when(F.col("_name") != "", F.col("_name")).otherwise(F.concat(kind, F.lit(" signal detected"))),
            "reason": F.when(x["reason"] != "", x["reason"]).otherwise("The model identified this as different from the supplied baseline."),
            "evidence": evidence,
            "effective_date": F.when(origin.isin("document_published_at", "document_text"), x["effective_date"]),
            "effective_date_source": origin,
            "needs_human_review": F.lit(True),
            "warnings": F.concat(*warnings),
        }

    out = rows
    for step in (read, named, typed, fielded):
        out = out.withColumns({f"c_{name}": column for name, column in step().items()})
    return out.withColumns(finished())


def _answered(documents: DataFrame, profiles: DataFrame, answers: DataFrame, mode: str) -> DataFrame:
    """Documents with their answer read: status, flags, the objects among the candidates, errors, and the texts that a check needs."""
    known = profiles.select("customer_id", F.lit(True).alias("_known")).dropDuplicates(["customer_id"])
    joined = parse(documents.join(known, "customer_id", "left").join(answers.select("document_id", "raw", "error"), "document_id", "left"))
    payload = F.col("payload")
    found = F.get(F.filter(F.array(*[_at(payload, f"$.{k}") for k in CANDIDATE_KEYS]), _holds), 0)
    shape = F.schema_of_variant
    none = F.array().cast("array<variant>")
    as_list = lambda f: F.when(shape(f).startswith("OBJECT"), F.array(f)).when(shape(f).startswith("ARRAY"), _at(f, "$", "array<variant>")).otherwise(none)
    unusable = F.when(F.col("_found").isNotNull() & ~shape("_found").rlike("^(OBJECT|ARRAY)"), "Model omitted a usable signal_candidates list; normalized to empty list.")
    read = joined.withColumn("_found", found).withColumns({"_list": _let(F.col("_found"), as_list), "_unusable": unusable})

    def inferred(key: str) -> tuple[Column, Column]:
        v = _at(payload, f"$.{key}")
        error = F.when(v.isNull(), f"Model omitted {key}; inferred from non-empty signal_candidates.").when(_let(v, flag).isNull(), f"Model {key} flag was not boolean; inferred from signal_candidates.")
        return F.coalesce(_let(v, flag), F.size("_list") > 0), error

    (relevant, no_relevant), (match, no_match) = inferred("relevant"), inferred("entity_match")
    read = read.withColumns({"relevant": relevant, "entity_match": match})
    asked = F.col("relevant") & F.col("entity_match")
    is_object = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
    numbered = F.transform("_list", lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    odd = F.when(asked, F.transform(F.filter(numbered, lambda y: ~is_object(y["c"])), lambda y: F.concat(F.lit("signal_candidates["), y["i"], F.lit("] must be an object."))))
    errors = F.concat(F.array_compact(F.array("_unusable", no_relevant, no_match)), F.coalesce(odd, F.array().cast("array<string>")))
    read = read.withColumns({"objects": F.when(asked, F.filter("_list", is_object)).otherwise(none), "_errors": errors})
    mock = F.lit(mode == "mock")
    status = (
        F.when(F.col("_known").isNull(), "skipped_missing_baseline")
        .when(F.lit(mode == "off"), "skipped_ai_disabled")
        .when(mock, "mock_fixture_no_signal")
        .when(F.col("error").isNotNull() | F.col("raw").isNull(), "api_error")
        .when(F.col("payload").isNull(), "invalid_model_output")
        .when(F.size("objects") > 0, "validated")
        .otherwise("no_signal")
    )
    read = read.withColumn("status", status)
    told = F.when(F.col("status").isin("validated", "no_signal"), F.col("_errors")).when(F.col("status") == "api_error", F.array(F.coalesce("error", F.lit("no answer"))))
    return read.withColumns({"errors": F.coalesce(told, F.array().cast("array<string>")), "analysis_id": F.concat(F.lit("ai-"), "document_id")})


def analyse(documents: DataFrame, profiles: DataFrame, answers: DataFrame, mode: str = "live") -> DataFrame:
    """One analysis a document: analysis_id, document_id, customer_id, status, relevant, entity_match, n_candidates, no_signal_reason, errors.

    documents(document_id, customer_id), profiles(customer_id), answers(document_id, raw, error), at most one a document; mode: off, mock or
    live. The candidates of an answer are listed under any of CANDIDATE_KEYS, or are a single object there; they count where the answer
    is relevant and about the right entity, flags that are inferred from them where they are missing or aren't boolean.
    """
    read = _answered(documents, profiles, answers, mode)
    own = lambda c: F.when(F.col("status").isin("validated", "no_signal"), c)
    stated = said(_at(F.col("payload"), "$.no_signal_reason"))
    reason = F.when(F.size("objects") == 0, F.when(stated != "", stated).otherwise("Model returned no supported signal candidates."))
    return read.select(
        "analysis_id", "document_id", "customer_id", "status", own(F.col("relevant")).alias("relevant"), own(F.col("entity_match")).alias("entity_match"), own(F.size("objects")).alias("n_candidates"), own(reason).alias("no_signal_reason"), "errors"
    )


#: What a checked candidate says.
CANDIDATE = ("signal_type", "fields", "severity", "confidence", "claim", "reason", "evidence", "effective_date", "effective_date_source", "needs_human_review", "warnings")


def validated_candidates(documents: DataFrame, profiles: DataFrame, answers: DataFrame, model: str | None = None, types: dict[str, list[str]] = rules.SIGNAL_FIELDS) -> DataFrame:
    """A row for each candidate of the validated analyses: analysis_id, document_id, customer_id, pos, model, CANDIDATE, and all_warnings with its analysis' errors.

    documents has title, evidence_excerpt, raw_text, published_at, expected and targeted (arrays of signal types and of fields) too.
    Each candidate is checked beside its document, whose text is folded once.
    """
    read = _answered(documents, profiles, answers, "live").withColumn("objects", F.when(F.col("status") == "validated", F.col("objects")))
    text = _spaces(F.concat_ws(" ", "title", "evidence_excerpt", "raw_text"))
    read = read.withColumns({"_text": text, "_name": _spaces(F.coalesce("title", F.lit(""))), "_excerpt": _spaces(F.coalesce("evidence_excerpt", F.lit("")))})
    sentence = F.regexp_extract("_text", r"^.*?[.!?](?= )", 0)
    read = read.withColumns({"_folded": folded(F.col("_text")), "_sentence": F.when(sentence != "", sentence).otherwise(F.col("_text"))})
    read = read.select("analysis_id", "document_id", "customer_id", "published_at", "expected", "targeted", "errors", "_text", "_name", "_excerpt", "_folded", "_sentence", "objects")
    # outer, and filtered after: a condition on the list would be made again below, from the answer on
    rows = read.select("*", F.posexplode_outer("objects").alias("pos", "c")).drop("objects").where("c is not null")
    return _checked(rows, types).select("analysis_id", "document_id", "customer_id", "pos", F.lit(model).cast("string").alias("model"), *CANDIDATE, F.concat("warnings", "errors").alias("all_warnings"))
