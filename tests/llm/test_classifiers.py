import numpy as np
import pytest

from lorestream.llm import factorization as Q
from lorestream.llm import toxicity as T

AT = "/root/testdata/sf0.01/"


def test_linear_form_equals_pairwise_sum():
    texts = [b"some words, Some more words ### and 12 others", b"", b"\n\nx"]
    x = Q.inputs(texts, np.array([45.0, 0.0, 3.0]))
    model = Q.Machine.blank(3, 1)
    model.w[:] = np.random.default_rng(2).normal(size=Q.SIZE)
    for r, margin in enumerate(model.parts(x)[0]):
        i, v = x.index[x.cuts[r] : x.cuts[r + 1]], x.value[x.cuts[r] : x.cuts[r + 1]]
        want = (model.w[i] * v).sum() + sum(model.v[i[a]] @ model.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert margin == pytest.approx(want, rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("operator, label, least", [(Q, "quality", 0.95), (T, "toxic", 0.9)])
def test_held_out_accuracy_and_independence(spark, operator, label, least):
    docs, labels = spark.read.parquet(AT + "documents.parquet"), spark.read.parquet(AT + "labels.parquet")
    out = operator.classify(docs, labels)
    got = out.join(labels, "doc_id").where("held_out").selectExpr(f"avg(int(predicted = {label})) AS a", "count(*) AS n").first()
    assert got.n > 50 and got.a >= least
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    # labels of held-out rows, languages and sources change nothing
    flipped = labels.selectExpr("doc_id", f"if({'crc32(string(doc_id)) % 3 = 1' if label == 'quality' else 'crc32(string(doc_id)) % 5 = 0'}, 1 - {label}, {label}) AS {label}")
    again = operator.classify(docs.selectExpr("doc_id", "text", "n_chars", "'x' AS lang", "'y' AS source").repartition(3), flipped)
    assert {r.doc_id: round(r.score, 4) for r in again.collect()} == {i: round(r.score, 4) for i, r in rows.items()}


@pytest.mark.parametrize("operator, label", [(Q, "quality"), (T, "toxic")])
def test_edges(spark, operator, label):
    docs = spark.createDataFrame([(1, None, None, 9), (2, "", 0, 9), (2, "", 0, 9), (None, "word " * 50, 250, 9), (3, "x" * 5000, 5000, 9)], "doc_id long, text string, n_chars long, score int")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    out = operator.classify(docs, none).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5}
    some = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (3, None), (None, 1), (77, 1)], f"doc_id long, {label} int")
    out = operator.classify(docs, some).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert operator.classify(docs.limit(0), some).count() == 0
