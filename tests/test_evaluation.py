import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lorestream.operators import evaluation as E
from lorestream.operators import tables


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def outcome(spark, expect, response, case=None):
    cases = E.suite(lines(spark, [{"id": "a", "kb_id": "k", "query": "q", "expect": expect, **(case or {})}]))
    rows = spark.createDataFrame([("a", json.dumps(response))] if response is not None else [], "id string, r string").select("id", F.try_parse_json("r").alias("response"))
    return E.evaluate(cases, rows).first()


def test_suite(spark, tmp_path):
    got = E.suite(lines(spark, ["", "  # note", {"kb_id": "k", "query": "q"}, "{bad", {"query": "q"}, {"kb_id": "", "query": "q"}, {"id": 7, "kb_id": "k", "query": "x", "query_class": "c"}])).collect()
    assert sorted((r.id or "", r.query_class, r.status) for r in got) == [("", "unknown", "invalid_json"), ("7", "c", "ok"), ("q", "unknown", "incomplete"), ("q", "unknown", "incomplete"), ("q", "unknown", "ok")]
    (tmp_path / "bad.jsonl").write_text('{"query": "q"}\n')
    with pytest.raises(ValueError, match="incomplete"):
        E.load_suite(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "good.jsonl").write_text('# c\n\n{"kb_id": "k", "query": "q", "expect": {"anything": {"deep": [1]}}}\n')
    assert E.load_suite(spark, str(tmp_path / "good.jsonl")).count() == 1


GOOD = {"status": "success", "answer": "The  Fee is due", "citations": [{"source": "A.pdf", "text": "x"}, {"source": "Lease.pdf"}], "_runner_latency_seconds": 2.5, "metadata": {"answer_state": "grounded", "sparse_debug": {"total_ms": 12, "lexical_backend": "fts"}}}


EXPECTED = [
    ({}, []), ({"status": "error"}, ["status"]), ({"answer_state_in": ["partial"]}, ["answer_state_in"]), ({"min_citations": 3}, ["min_citations"]), ({"min_citations": 2}, []),
    ({"sources_any": "lease.PDF"}, []), ({"sources_all": ["a.pdf", "b.pdf"]}, ["sources_all"]), ({"entities_any": ["zz", "the fee"]}, []), ({"entities_all": ["fee", "zz"]}, ["entities_all"]), ({"codes_any": ["zz"]}, ["codes_any"]),
    ({"answer_contains_any": ["lease"]}, ["answer_contains_any"]), ({"not_contains": ["lease"]}, ["not_contains"]), ({"max_latency_seconds": 2}, ["max_latency_seconds"]), ({"max_sparse_ms": 5}, ["max_sparse_ms"]), ({"retrieval_backend_in": ["bm25"]}, ["retrieval_backend_in"]),
    ({"status": "error", "min_citations": 9, "sources_any": [], "unknown": 1}, ["min_citations", "status"]),
]


def test_predicates(spark):
    cases = E.suite(lines(spark, [{"id": str(i), "kb_id": "k", "query": "q", "expect": expect} for i, (expect, _) in enumerate(EXPECTED)]))
    rows = spark.createDataFrame([(str(i), json.dumps(GOOD)) for i in range(len(EXPECTED))], "id string, r string").select("id", F.try_parse_json("r").alias("response"))
    got = {r.id: (r.failures, r.passed) for r in E.evaluate(cases, rows).collect()}
    assert got == {str(i): (failures, not failures) for i, (_, failures) in enumerate(EXPECTED)}


def test_metrics_of_a_case(spark):
    row = outcome(spark, {"sources_any": ["lease"], "entities_all": ["fee"]}, GOOD)
    assert (row.source_rank, row.mrr, row.source_hit, row.entity_hit, row.code_expected, row.no_evidence) == (2, 0.5, True, True, False, False)
    row = outcome(spark, {"sources_any": ["lease"]}, None)  # no response at all
    assert row.failures == ["sources_any", "status"] and row.no_evidence and row.source_rank is None and row.latency == 0.0
    row = outcome(spark, {}, {"status": "success", "citations": "none", "answer": 5, "metadata": []})
    assert row.passed and row.no_evidence


def test_percentiles(spark):
    rng = random.Random(8)
    data = [(g, float(rng.randint(0, 30))) for g in "ab" for _ in range(57)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.percentile for r in tables.interpolated(df, "g", "v", share).collect()}
        for g in "ab":
            values = sorted(v for k, v in data if k == g)
            at = (len(values) - 1) * share
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert got[g] == pytest.approx(values[low] + (values[high] - values[low]) * (at - low), abs=1e-3)
        assert got["c"] == 4.0 and "d" not in got
    assert statistics.median(v for k, v in data if k == "a") == {r.g: r.percentile for r in tables.interpolated(df, "g", "v", 0.5).collect()}["a"]
