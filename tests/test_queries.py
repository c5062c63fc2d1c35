import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lorestream.operators import retrieval
from lorestream.plans import queries as Q
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con

KIND = {"BIGINT": "bigint", "HUGEINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "FLOAT": "float"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    kinds = {d[0]: KIND.get(str(d[1]), "string") for d in want.description}
    assert {f.name: f.dataType.simpleString().replace("timestamp_ntz", "timestamp") for f in got.schema} == kinds
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_others_run(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_dense_ties_beyond_the_candidates(spark, tmp_path):
    far = [[1.0, 1e-4 * (50 - i) / 50] + [0.0] * 62 if i else [1.0] + [0.0] * 63 for i in range(50)]
    spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = Q.QUERIES["dense_topk_cosine"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(10))
    want = con.execute(Q.ORACLE_SQL["dense_topk_cosine"])
    names = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_first_holder_outside_the_best(spark, tmp_path):
    """Thirty documents repeat a passage's words more often than the first that holds it; short passages lie inside words."""
    passage = "alpha beta gamma delta epsilon zeta"
    docs = [(0, f"xx{passage}yy " + "filler words here " * 60)] + [(i, "beta gamma delta epsilon " * 30) for i in range(1, 30)] + [(30, passage), (31, "unhappily"), (32, None), (33, "a b")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(7, passage), (8, "happi"), (9, "no holder of this text"), (10, "ha"), (11, "words"), (12, "a")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = Q.QUERIES["first_expected_rank"](spark, str(tmp_path))
    want = con.execute(Q.ORACLE_SQL["first_expected_rank"])
    names = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
    asked = Q.QUERIES["first_expected_rank"].__globals__["_read"](spark, str(tmp_path), "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    scores = retrieval.bm25_scores(asked.withColumnRenamed("passage", "query"), texts, digits=6)
    assert {r.query_id: r.doc_id for r in retrieval.holders(asked, texts, scores).collect()} == {7: 0, 8: 31, 10: 0 if "ha" in docs[0][1] else 31, 11: 0, 12: 0}


def test_costly_steps_are_said_once(spark, monkeypatch, tmp_path):
    from lorestream.operators import ingest
    from lorestream.plans import evaluation as suites
    from lorestream.streaming import state

    plan = Q.QUERIES["cleaned_texts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^(?:https?://|www") == 1
    names = []
    monkeypatch.setattr(ingest, "written", lambda rows, name: names.append(name) or state.written(rows, name))
    monkeypatch.setattr(suites, "written", lambda rows, name: names.append(name) or state.written(rows, name))
    docs = spark.createDataFrame([(1, "One two three. " * 40), (2, "short"), (3, None)], "file_id long, text string")
    got = ingest.sync(docs, f"{tmp_path}/store", 1, ingest.pages_of(20))
    assert {(r.file_id, r.status) for r in got.collect()} == {(1, "accepted"), (2, "too_short"), (3, "empty")}
    suites._responses(spark, SF)
    assert names == ["judged", "responses"]
