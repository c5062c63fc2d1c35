import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lorestream.operators import retrieval
from lorestream.plans import queries as Q
from tests.conftest import SF

DOCS = [
    (5, "alpha beta alpha gamma"), (5, "alpha beta alpha gamma"), (5, "beta delta"), (1, "alpha beta"), (2, "alpha beta"), (3, None), (4, ""), (6, "zeta " * 40 + "alpha"),
    (None, "beta beta gamma"), (None, "alpha"), *((n, f"alpha word{n % 7} gamma") for n in range(10, 60)),
]
ASKED = [(1, "alpha beta beta"), (2, "gamma word3"), (None, "delta"), (3, None), (4, "nowhere"), (1, "zeta")]


def brute(docs, asked, digits=6, k1=1.5, b=0.75):
    bags = [(i, (t or "").split()) for i, t in docs]
    mean = sum(len(x) for _, x in bags) / len(bags)
    tf = Counter((w, i, len(x)) for i, x in bags for w in x)
    df, qtf = Counter(w for w, _, _ in tf), Counter((q, w) for q, t in asked for w in (t or "").split())
    score, met = defaultdict(float), Counter()
    for (q, w), times in qtf.items():
        for (v, i, dl), n in tf.items():
            if v == w:
                score[q, i] += times * math.log((len(bags) - df[w] + 0.5) / (df[w] + 0.5) + 1) * n * (k1 + 1) / (n + k1 * (1 - b + b * dl / mean))
                met[q, i] += 1
    return {at: (round(x, digits), met[at]) for at, x in score.items()}


def ranked(scores, k):
    out = {}
    for q in {q for q, _ in scores}:
        order = sorted((i for p, i in scores if p == q), key=lambda i: (-scores[q, i][0], i is not None, i or 0))
        out |= {(q, i): n for n, i in enumerate(order[:k], 1)}
    return out


def got(rows):
    return {(r.query_id, r.doc_id): (r.score, r.n_terms) for r in rows}


@pytest.mark.parametrize("near_rows", [0, 1 << 18])
def test_scores_and_ranks_by_brute_force(spark, monkeypatch, near_rows):
    monkeypatch.setattr(retrieval, "_NEAR_ROWS", near_rows)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(ASKED, "query_id long, query string")
    want = brute(DOCS, ASKED)
    found = got(retrieval.bm25_scores(asked, docs, digits=6).collect())
    assert found.keys() == want.keys() and all(found[at] == (pytest.approx(want[at][0], abs=2e-6), want[at][1]) for at in want)
    for k in (1, 4, 100):
        best = retrieval.bm25(asked, docs, k=k, digits=6).collect()
        assert {(r.query_id, r.doc_id): r.rank for r in best} == ranked(want, k)
    assert retrieval.bm25(asked.where("false"), docs, digits=6).count() == retrieval.bm25(asked, docs.where("false"), digits=6).count() == 0


def test_names_as_ids(spark):
    docs = spark.createDataFrame([("b", "alpha"), ("a", "alpha"), ("c", "alpha")], "doc_id string, text string")
    best = retrieval.bm25(spark.createDataFrame([("q", "alpha")], "query_id string, query string"), docs, k=2)
    assert [(r.query_id, r.doc_id) for r in best.orderBy("rank").collect()] == [("q", "a"), ("q", "b")]


def test_a_task_hands_on_its_best_only(spark):
    """Four hundred documents that meet both questions: before, all eight hundred scores were ranked."""
    docs = spark.createDataFrame([(n, "alpha beta " + "filler " * (n % 50)) for n in range(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta alpha")], "query_id long, query string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert retrieval._scores(asked, docs, 1.5, 0.75, retrieval.T.tokens, 6, 3).count() <= 2 * 3 * tasks
    assert retrieval.bm25_scores(asked, docs).count() == 800


def test_documents_over_several_batches(monkeypatch):
    """What belongs to one document comes together wherever batches and slices end, nulls too."""
    flat = pa.schema([("doc_id", pa.int64()), ("dl", pa.int32()), ("tid", pa.int32())])
    rows = [(None, 1, 3), (None, 1, 0), (1, 2, 5), (1, 2, 5), (1, 2, 0), (1, 3, 5), (1, 3, 0), (2, 1, 4), (2, 1, 0)]
    want = [(None, 0, 1, 1), (None, 3, 1, 1), (1, 0, 2, 1), (1, 0, 3, 1), (1, 5, 2, 2), (1, 5, 3, 1), (2, 0, 1, 1), (2, 4, 1, 1)]
    pairs = np.array([0, 0, 0, 2, 2, 2])
    for size in (1, 2, 4, 9):
        for most in (1, 3, 100):
            monkeypatch.setattr(retrieval, "_UNPACKED", most)
            monkeypatch.setattr(retrieval, "_CELLS", most)
            batches = [pa.RecordBatch.from_pylist([dict(zip(flat.names, r)) for r in rows[at : at + size]], schema=flat) for at in range(0, len(rows), size)]
            packed = list(retrieval._packed(batches))
            assert [(i, t, d, n) for ids, *x in retrieval._unpacked(packed) for i, t, d, n in zip(ids.take(pa.array(x[0])).to_pylist(), *(y.tolist() for y in x[1:]))] == want
            sums = [(i, t, w, n) for ids, *x in retrieval._weighed(packed, lambda tf, dl: tf * 10 + dl, pairs, 2) for i, t, w, n in zip(ids.take(pa.array(x[0])).to_pylist(), *(y.tolist() for y in x[1:]))]
            assert sums == [(None, 0, 11, 1), (None, 3, 11, 1), (1, 0, 25, 2), (1, 5, 35, 2), (2, 0, 11, 1), (2, 4, 11, 1)]


@pytest.mark.parametrize("name", ["cited_confidence", "merged_citations", "guard_report"])
def test_texts_stay_where_they_are(spark, name):
    """Hits go to documents: no exchange of documents, and the corpus is tokenised before the plan, once."""
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(doc_id" not in plan and retrieval.T.WORD not in plan
