from pyspark.sql import functions as F

from lorestream.operators import evaluation, observability

FIELDS = "event_id long, ts timestamp, kb string, intent string, mode string, answer_state string, latency double, accepted long, citations long, fallback boolean, capped boolean, unsupported long, failures long, words long"


def records(spark, rows):
    return spark.createDataFrame([tuple({"event_id": i, **row}.get(f.split()[0]) for f in FIELDS.split(", ")) for i, row in enumerate(rows)], FIELDS)


def told(found):
    return {(r.metric, r.key): r.value for r in found.collect()}


def test_no_records(spark):
    got = told(observability.summary(observability.with_alerts(records(spark, []))))
    assert set(got.values()) == {0.0} and ("latency_p50", "all") in got and ("count", "queries") in got
    assert not {m for m, _ in got} & {"alert", "intent", "kb", "answer_state", "latency_p50_by_kb"}


def test_only_errors_are_no_queries_but_raise_alerts(spark):
    got = told(observability.summary(observability.with_alerts(records(spark, [{"answer_state": "error", "capped": True, "latency": 5.0}] * 2))))
    assert got["count", "errors"] == 2 and got["count", "queries"] == 0 and got["alert", "confidence_cap_applied"] == 2
    assert got["latency_max", "all"] == 0 and got["latency_p95", "all"] == 0 and ("intent", "unknown") not in got


def test_nulls_are_zero_false_and_unknown(spark):
    got = told(observability.summary(observability.with_alerts(records(spark, [{}, {"kb": "", "latency": 2.0, "accepted": 3, "citations": 1, "intent": "count"}]))))
    assert got["kb", "unknown"] == 2 and got["answer_state", "unknown"] == 2 and got["intent", "unknown"] == 1
    assert got["latency_p50", "all"] == 1.0 and got["latency_p95_by_intent", "count"] == 2.0 and got["rate", "no_accepted_evidence"] == 0.5
    assert got["rate", "structured_search_exact_result"] == 1.0 and got["rate", "followup_transform_success"] == 0.0


def test_window_keeps_the_newest_and_one_base(spark):
    rows = records(spark, [{"kb": "a", "latency": float(i)} for i in range(10)] + [{"kb": "b", "latency": 99.0}]).withColumn("ts", F.timestamp_seconds(F.col("event_id") / 2 - F.col("event_id") % 2 / 2))
    got = told(observability.summary(observability.with_alerts(rows), 3, "a"))
    assert got["count", "events"] == 3 and got["latency_max", "all"] == 9 and got["latency_p50", "all"] == 8 and ("kb", "b") not in got


def test_alerts_in_order_and_at_their_limits(spark):
    rows = [
        {"kb": "legal", "answer_state": "direct_response", "intent": "factual", "latency": 9.0},
        {"kb": "legal", "answer_state": "direct_response", "intent": "factual", "latency": 9.1, "accepted": 1},
        {"kb": "legal", "answer_state": "partial", "intent": "legal", "fallback": True, "unsupported": 1, "failures": 1, "capped": True},
        {"kb": "other", "answer_state": "grounded_answer", "fallback": True},
    ]
    got = [r.alerts for r in observability.with_alerts(records(spark, rows), "legal").orderBy("event_id").collect()]
    assert got == [["answer_without_accepted_evidence"], ["direct_answer_latency_budget_exceeded"],
                   ["fallback_used_for_high_risk_query", "unsupported_claims_detected", "citation_validation_failures", "confidence_cap_applied"], []]


def test_evidence_quality(spark):
    hits = spark.createDataFrame([
        (1, 0.2, ["extraction_error", None], None), (1, 0.4, None, None), (2, None, ["low_text_quality"], None), (2, 0.9, [], False), (3, 0.55, None, None), (4, None, ["replacement_characters"], True), (5, 0.5, ["extraction_error"], None),
    ], "query_id long, quality double, flags array<string>, poor boolean")
    queries = spark.createDataFrame([(1, True), (2, True), (3, None), (4, True), (5, True), (6, True)], "query_id long, high_risk boolean")
    got = {r.query_id: r for r in observability.evidence_quality(queries, hits).collect()}
    assert (got[1].cap, got[1].source_limited, got[1].flags, got[1].mean) == (0.45, True, ["extraction_error"], 0.3)
    assert (got[2].cap, got[2].n_low, got[2].reasons) == (0.65, 1, ["some_final_evidence_low_extraction_quality"])
    assert (got[3].cap, got[3].n_low, got[3].flags) == (None, 0, [])
    assert got[4].source_limited and got[4].mean is None
    assert got[5].cap == 0.45 and not got[5].source_limited
    assert (got[6].n_hits, got[6].low_ratio, got[6].cap, got[6].reasons) == (0, 0.0, None, [])


def test_confidence_is_clamped(spark):
    row = spark.sql("select -1.0d as a, 3.0d as b, 2 as c, cast(null as double) as d, 9 as e")
    got = row.select(observability.cited_confidence(F.col("a"), F.col("b"), F.col("c")).alias("x"), observability.cited_confidence(F.col("d"), F.col("d"), F.col("e")).alias("y")).first()
    assert abs(got.x - (0.4 + 0.2 * 2 / 3)) < 1e-12 and abs(got.y - 0.2) < 1e-12


def test_cache_statistics(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", True)], "k string, hit boolean")
    assert sorted(map(tuple, observability.cache_statistics(rows, "k").collect())) == [("a", 3, 1, 2, 0.3333), ("b", 1, 1, 0, 1.0)]
    assert tuple(observability.cache_statistics(rows.where("false")).first()) == (0, 0, 0, None)


def test_canary(spark):
    fields = "group string, total long, passed long, failed long, source_accuracy double, latency_p95 double"
    base = spark.createDataFrame([("all", 10, 10, 0, 0.95, 1.0)], fields)
    now = spark.createDataFrame([("good", 10, 10, 0, 0.94, 2.0), ("worse", 10, 8, 2, 0.5, 30.0), ("bare", 1, 1, 0, None, None), ("none", 0, 0, 0, None, None)], fields)
    got = {r.group: r for r in evaluation.canary(now, base).collect()}
    assert got["good"].eligible and got["bare"].eligible and got["good"].latency_p95_delta == 1.0
    assert got["worse"].blockers == ["retrieval_gate_failed", "hard_pass_rate_below_threshold", "hard_source_accuracy_below_threshold", "hard_latency_p95_above_threshold",
                                     "source_accuracy_regressed_vs_baseline", "pass_rate_regressed_vs_baseline", "latency_regressed_vs_baseline"]
    assert got["none"].blockers == ["hard_pass_rate_below_threshold", "pass_rate_regressed_vs_baseline"]
    assert {r.group: r.eligible for r in evaluation.canary(now, base.where("false")).collect()}["good"]
