import json

import pytest
from pyspark.sql import functions as F

from lorestream.functions import text as T
from lorestream.operators import chunking, retrieval, tables
from lorestream.sources import files
from lorestream.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text", ["".join(map(str, range(700))), " ".join(map(str, range(900))), "a. b. " + "".join(map(str, range(400))), "\n\n".join(map(str, range(400))), "", "short", "y" * 800])
def test_cut_ends_and_covers(text):
    assert len(chunking.cut("x" * 2000)) == 3
    chunks = chunking.cut(text)
    assert all(len(c) <= 1000 for c in chunks)
    at = 0
    for c in chunks:
        place = text.find(c, max(0, at - 200 - len(c)))
        assert 0 <= place <= at
        at = max(at, place + len(c))
    assert at == len(text)


def test_text_functions(spark):
    assert one(spark, T.legal_tokens(F.lit("See § 501(c)(3) and IRS pre-trial rules of 42(a), x 45.6"))) == ["§ 501(c)(3)", "IRS", "pre-trial", "rules", "42(a)", "45", "6"]
    assert one(spark, T.stem(F.lit("companies"))) == "company"
    assert one(spark, T.stem(F.lit("boxes"))) == "box"
    assert one(spark, T.stem(F.lit("adoptions"))) == "adoption"
    assert one(spark, T.stem(F.lit("status"))) == "status"
    assert one(spark, T.source_family(F.lit("a/b/report (2).pdf?x=1"))) == "report"
    assert one(spark, T.section_slug(F.lit("Section 4.2 Scope"))) == "4.2"
    assert one(spark, T.section_slug(F.lit("Who Pays?"))) == "who-pays"
    head = one(spark, T.email_headers(F.lit("From: a@b.c\nTo: d\nRe: hello\nSubject: s\n\nbody")))
    assert (head.sender, head.receiver, head.subject, head.is_email) == ("a@b.c", "d", "hello", True)
    assert one(spark, T.mentions(F.lit("Smith, John met John Smith"), "John Smith")) == 2
    assert one(spark, T.citations(F.lit("a [2] b [1][2]."))) == [1, 2]
    assert one(spark, T.citation_coverage(F.lit("a [1]. b. c [2]. d."))) == 0.5
    assert one(spark, T.similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(2**-0.5)
    assert one(spark, T.clean_lines(F.lit("a  b\n 12 \nc\nc\nd"))) == "a b\nc\nd"
    assert one(spark, T.quality_score(F.lit("short"))) == 0.0


def test_follow_ups(spark):
    asked = ["What did I ask first?", "Tell me more", "What do you mean?", "As bullet points", "Who wrote the contract of 1999?"]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select(tables.follow_up_class(F.col("q"))).collect()
    assert [r[0] for r in rows] == ["meta", "continuation", "clarification", "formatting", "new"]


def test_ranking(spark):
    ranked = spark.createDataFrame([(1, i + 1) for i in range(7)], "query_id long, rank int")
    assert sorted(r.place for r in retrieval.lost_in_middle(ranked).collect()) == list(range(7))
    lists = spark.createDataFrame([(1, "a", d, r, 1.0 / r) for r, d in enumerate([5, 6, 7], 1)] + [(1, "b", d, r, None) for r, d in enumerate([6, 8], 1)], "query_id long, retriever string, doc_id long, rank int, score double")
    assert retrieval.rrf(lists).orderBy("rank").first().doc_id == 6
    vectors = spark.createDataFrame([(1, 1, 10, [1.0, 0.0]), (1, 2, 11, [0.99, 0.01]), (1, 3, 12, [0.0, 1.0])], "query_id long, rank int, doc_id long, vector array<double>")
    assert [r.doc_id for r in retrieval.greedy_dedup(vectors).orderBy("rank").collect()] == [10, 12]


def test_versions(spark):
    chunks = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("g", 1, "c")], "file_uuid string, ingest_version long, content string")
    versions = spark.createDataFrame([("f", 1, "ready"), ("f", 2, "staging"), ("g", 1, "ready")], "file_uuid string, ingest_version long, state string")
    assert sorted(r.content for r in tables.visible(chunks, versions).collect()) == ["a", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    (tmp_path / "c.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "d.exe").write_bytes(b"\0")
    found = {r.extension: r for r in files.listing(spark, str(tmp_path)).withColumn("text", files.decoded(F.col("content"))).collect()}
    assert found["txt"].text == "café" and not found["exe"].supported and found["csv"].supported
    assert [r.content for r in files.json_documents(spark, str(tmp_path / "b.json")).orderBy("item_index").collect()] == ['{"k":1}', '{"k":2}']
    assert files.csv_lines(spark, str(tmp_path / "c.csv")).first().text == "Row 1: x: 1 | y: 2\nRow 2: x: 3 | y: 4"
    assert [tuple(h) for h in one(spark, files.headings(F.lit("# A\nx\n## B b")))] == [(1, "A"), (2, "B b")]


def test_streams(spark, tmp_path):
    source = spark.createDataFrame([(i, 1, i) for i in range(5)] + [(9, 1, 100)], "event_id long, user_id long, s int")
    source.select("event_id", "user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    run = E.rate_limited(stream, most=3, seconds=60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True}
    assert E.admit([0, 1, 2, 61], [], 2, 60.0)[0] == [True, True, False, True]


def test_scores_move_no_postings_by_token(spark):
    import re

    from lorestream.operators import retrieval, sparse

    docs = spark.createDataFrame([(i, f"common word{i % 3}") for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common word1"), (2, "word2")], "query_id long, query string")
    scores = retrieval.bm25_scores(asked, docs)
    assert {(r.query_id, r.n) for r in scores.groupBy("query_id").count().withColumnRenamed("count", "n").collect()} == {(1, 20), (2, 6)}
    vectors = sparse.with_vectors(asked.withColumnRenamed("query", "text")).select("query_id", "terms"), sparse.with_vectors(docs).select("doc_id", "terms")
    for rows in (scores, sparse.dot_top_k(*vectors)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(query_id#\w+, doc_id#", plan)
