"""Model answers of odd shapes with written-out rows; masking, timeline ranges and feed dates in the words of their definitions."""

import datetime

import pytest
from pyspark.sql import functions as F

from driftspark.functions.text import seen_at
from driftspark.operators import governance, model_answers

DOC = "document_id long, customer_id long, title string, evidence_excerpt string, raw_text string, published_at string, expected array<string>, targeted array<string>"


@pytest.fixture(scope="module")
def read(spark):
    doc = lambda i, customer=1, excerpt="An  excerpt.", text="First sentence here. Second “quoted” one on 2023-05-06.", targeted=None: (i, customer, "A title", excerpt, text, "2024-01-02", ["nothing", "new_product"], targeted)
    documents = [doc(1), doc(2), doc(3, excerpt=""), doc(4), doc(5), doc(6, targeted=["risk level"]), doc(7, customer=2), doc(8), doc(9), doc(10), doc(11), doc(12)]
    answers = {
        1: '```json\n{"relevant": "Yes", "entity_match": true, "signal_candidates": [{"signal_type": "Product Launch", "changed_kyc_fields": ["Products", "risk", 5], "severity_suggestion": " HIGH ", "confidence": "85%", "claim": "c", "reason": "r", "verbatim_evidence": "second \\"quoted\\" ONE", "effective_date": "2024-01-02", "needs_human_review": true}]}\n```',
        2: 'Sure: {"signals": {"signal_type": "a b", "confidence": 1.5, "effective_date": "2023-05-06", "needs_human_review": false}} and {"x": 1}',
        3: '{"relevant": true, "entity_match": true, "candidates": [1, "x", {"signal_type": null, "changed_kyc_fields": "website", "severity_suggestion": "severe", "confidence": "high", "verbatim_evidence": "made up", "effective_date": "2020-01-01"}]}',
        4: '[{"signal_type": "new_product"}]',
        5: '{"relevant": true, "signals": [{"a": 1}',
        6: '{"signal_candidates": [], "signals": 0, "candidates": {}, "signal_candidate": {"signal_type": "kyc_refresh", "effective_date": "soon", "confidence": null}}',
        7: '{"signals": [{}]}',
        8: '{"relevant": 3, "entity_match": "no", "signals": [{}]}',
        9: '{"signals": "many"}',
        10: '{"relevant": false, "entity_match": true, "signals": [{}], "no_signal_reason": " none \\n here "}',
    }
    rows = [(i, answers.get(i), "TimeoutError: late" if i == 11 else None) for i in range(1, 13)]
    parts = spark.createDataFrame(documents, DOC), spark.createDataFrame([(1,), (1,)], "customer_id long"), spark.createDataFrame(rows, "document_id long, raw string, error string")
    return parts


def test_status_flags_and_errors(read):
    got = {r.document_id: r for r in model_answers.analyse(*read).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "validated", 2: "validated", 3: "validated", 4: "invalid_model_output", 5: "invalid_model_output", 6: "validated", 7: "skipped_missing_baseline", 8: "no_signal", 9: "no_signal", 10: "no_signal", 11: "api_error", 12: "api_error"}
    assert got[1].errors == [] and got[1].analysis_id == "ai-1" and got[1].no_signal_reason is None
    omitted = [f"Model omitted {k}; inferred from non-empty signal_candidates." for k in ("relevant", "entity_match")]
    assert got[2].errors == omitted and got[2].relevant and got[2].entity_match
    assert got[3].errors == ["signal_candidates[0] must be an object.", "signal_candidates[1] must be an object."] and got[3].n_candidates == 1
    assert got[8].errors == ["Model relevant flag was not boolean; inferred from signal_candidates."] and (got[8].relevant, got[8].entity_match) == (True, False)
    assert got[9].errors == ["Model omitted a usable signal_candidates list; normalized to empty list.", *omitted] and not got[9].relevant
    assert got[10].no_signal_reason == "none here" and got[9].no_signal_reason == "Model returned no supported signal candidates."
    assert got[11].errors == ["TimeoutError: late"] and got[12].errors == ["no answer"] and got[11].relevant is None
    for mode, status in (("off", "skipped_ai_disabled"), ("mock", "mock_fixture_no_signal")):
        assert {r.status for r in model_answers.analyse(*read, mode).where("document_id <> 7").collect()} == {status}


def test_candidates_are_checked(read):
    got = {r.document_id: r for r in model_answers.validated_candidates(*read, "m").collect()}
    assert sorted(got) == [1, 2, 3, 6]
    one = got[1]
    assert (one.signal_type, one.fields, one.severity, one.confidence, one.claim, one.reason, one.evidence) == ("new_product", ["known_products"], "high", 0.85, "c", "r", 'second "quoted" ONE')
    assert (one.effective_date, one.effective_date_source, one.warnings, one.model) == ("2024-01-02", "document_published_at", ["Field 'risk' is not supported for new_product; ignored."], "m")
    two = got[2]
    assert (two.signal_type, two.fields, two.severity, two.confidence, two.claim, two.evidence) == ("new_product", ["business_area"], "medium", 1.0, "A title", "An excerpt.")
    assert (two.effective_date, two.effective_date_source, two.needs_human_review) == ("2023-05-06", "document_text", True)
    assert two.warnings == [
        "Unsupported signal_type 'a b' mapped to 'new_product'.",
        "Missing supported changed_kyc_fields; inferred 'business_area' for new_product.",
        "Unsupported severity_suggestion '<empty>' normalized to 'medium'.",
        "Out-of-range confidence '1.5' clamped into 0..1.",
        "Quote was not exact; replaced with collected source excerpt.",
        "needs_human_review was false; forced to true for model-derived evidence.",
    ]
    assert two.all_warnings == two.warnings + [f"Model omitted {k}; inferred from non-empty signal_candidates." for k in ("relevant", "entity_match")]
    three = got[3]
    assert three.warnings[0] == "Unsupported signal_type '<empty>' mapped to 'new_product'." and "Field 'website' is not supported for new_product; ignored." in three.warnings
    assert (three.confidence, three.evidence, three.effective_date, three.effective_date_source) == (0.7, "A title First sentence here.", None, "model_supplied_date_not_in_source_normalized_to_null")
    assert "Quote was not exact; replaced with first source sentence." in three.warnings and "new_product needs_human_review was not boolean; normalized to true." in three.warnings
    six = got[6]
    assert (six.signal_type, six.fields, six.confidence, six.effective_date_source) == ("risk_rating_review", ["risk_rating"], 0.7, "invalid_model_date_normalized_to_null") and "Missing confidence normalized to 0.7." in six.warnings


def test_sensitive_values_are_masked(spark):
    row = [("ACC-12345", 12.5, "abc", None, [("GB00", 3)], [("long enough", "kept")], "open")]
    table = spark.createDataFrame(row, "Account_No string, paid_amount double, swift string, email string, payments array<struct<iban:string,n:int>>, lines array<struct<purpose:string,memo:string>>, address string")
    got = governance.mask_sensitive(table).first()
    assert got[:5] == ("***2345", "[REDACTED]", "[REDACTED]", None, "[REDACTED]")
    assert [tuple(x) for x in got.lines] == [("***ough", "kept")] and got.address == "open"


@pytest.mark.parametrize(("latest", "end"), [(datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1)), (datetime.datetime(2024, 1, 30), datetime.datetime(2024, 2, 1)), (datetime.datetime(2024, 2, 3), datetime.datetime(2024, 2, 3))])
def test_a_timeline_range_ends_now_unless_all_is_older_or_later(spark, latest, end):
    days = [latest - datetime.timedelta(days=k) for k in range(12)]
    events = spark.createDataFrame([(t,) for t in days], "at timestamp")
    got = governance.timeline_windows(events, "at", F.lit("2024-02-01").cast("timestamp"), {"1w": 7}).collect()
    assert sorted(r.at for r in got) == sorted(t for t in days if end - datetime.timedelta(days=7) <= t <= end)


def test_feed_dates(spark):
    said = ["20240102030405", "202401020304", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05", " 2024-01-02 ", "2024-01-02T05:34:05+02:30", "2024-01-02T03:04", "soon", "", None]
    got = [str(r.t) if r.t else None for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("i", seen_at(F.col("x")).cast("timestamp_ntz").alias("t")).orderBy("i").collect()]
    full, minute = "2024-01-02 03:04:05", "2024-01-02 03:04:00"
    assert got == [full, minute, full, full, "2024-01-02 00:00:00", full, minute, None, None, None]


def test_keyed_chain_needs_the_key(spark):
    import hashlib
    import hmac

    fields = ["id", "at", "actor", "action", "kind", "entity", "payload"]
    rows = [(c, i, f"2024-01-0{i}", "a", "view", "k", None, f"päy|load {i}") for c in "xyz" for i in range(1, 6)]
    events = spark.createDataFrame(rows, "chain string, id int, at string, actor string, action string, kind string, entity string, payload string")
    for key in (b"short", b"k" * 100):
        written = governance.chained(events, ["chain"], ["id"], fields, key)
        stored = written.collect()
        for c in "xyz":
            last = governance.GENESIS
            for r in sorted((r for r in stored if r.chain == c), key=lambda r: r.id):
                body = "|".join("" if r[f] is None else str(r[f]) for f in fields)
                assert r.previous_hash == last
                last = hmac.new(key, f"{last}|{body}".encode(), hashlib.sha256).hexdigest()
                assert r.event_hash == last
        table = spark.createDataFrame(stored, written.schema)
        unkeyed = F.sha2(F.concat(F.col("previous_hash"), F.lit("|"), governance.body_of(fields)), 256)
        forged = table.withColumn("payload", F.when((F.col("chain") == "y") & (F.col("id") == 3), "other").otherwise(F.col("payload")))
        forged = forged.withColumn("event_hash", F.when((F.col("chain") == "y") & (F.col("id") == 3), unkeyed).otherwise(F.col("event_hash"))).where("not (chain = 'z' and id = 1)")
        got = {r.chain: (r.checked, r.valid, r.first_break) for r in governance.verify_chain(forged, ["chain"], ["id"], fields, key).collect()}
        assert got == {"x": (5, True, None), "y": (5, False, 3), "z": (4, False, 2)}


def test_near_names_miss_none(spark):
    import random

    from driftspark.operators.bank import near_names

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)

    def misspelt(name):
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randint(0, max(0, len(name) - 1)), rng.randint(0, 2)
            name = name[:i] + ("" if kind == 0 else rng.choice("abé ")) + name[i + (kind != 1) :]
        return name

    def names(n):
        known = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(6, 16))) for _ in range(n)] + ["", "a", "ab", "ba", "aa"]
        return known, [misspelt(rng.choice(known)) for _ in range(n)] + ["", "a", "x", None]

    for n in (40, 160):
        known, said = names(n)
        left, right = spark.createDataFrame([(x,) for x in said], "name string"), spark.createDataFrame([(x,) for x in known + known[:3]], "known string")
        for edits in (1, 2):
            want = {(a, b, distance(a, b)) for a in set(said) - {None} for b in set(known) if distance(a, b) <= edits}
            assert {tuple(r) for r in near_names(left, right, edits).collect()} == want
