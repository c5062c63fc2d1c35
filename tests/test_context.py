from pyspark.sql import functions as F

from lorestream.operators import context


def order(rows):
    return [r.doc_id for r in rows.orderBy("query_id", "display_order").collect()]


def test_orders(spark):
    hits = spark.createDataFrame([(1, 1, 10, None, "2024-05"), (1, 2, 11, "", None), (1, 2, 12, "2023", "2025"), (1, 3, 13, None, None), (1, 4, 14, "2024-05", None)], "query_id long, rank int, doc_id long, date string, created_at string")
    assert order(context.ordered(hits)) == [10, 11, 12, 13, 14]
    assert order(context.ordered(hits, "chronological")) == [12, 10, 14, 11, 13]
    assert order(context.ordered(hits, "lost_in_middle")) == [10, 12, 14, 13, 11]
    assert order(context.ordered(hits, "other")) == order(context.ordered(hits.drop("date", "created_at"), "chronological")) == [10, 11, 12, 13, 14]
    got = context.ordered(hits.where("rank = 1"), "lost_in_middle").first()
    assert (got["display_order"], got["ordering_strategy"], got["rank"]) == (1, "lost_in_middle", 1)
    assert context.ordered(hits.where("false"), "chronological").count() == 0


def test_merged_citations(spark):
    a = spark.createDataFrame([(1, " B.pdf", 1, 5), (1, "b.PDF", 2, 6), (1, None, 3, 7), (1, "", 4, 8), (2, "x", 1, 9)], "query_id long, source string, nth int, hits int")
    b = spark.createDataFrame([(1, "c", 1), (1, "B.PDF ", 2), (3, "C", 1), (3, "c", 2)], "query_id long, source string, nth int")
    got = sorted((r.query_id, r.citation, r.source, r.hits) for r in context.merged_citations(a, b).collect())
    assert got == [(1, 1, "B.pdf", 5), (1, 2, "c", None), (2, 1, "x", 9), (3, 1, "C", None)]
    assert context.merged_citations(a.where("false"), b.where("false")).count() == 0


def test_distinct_names(spark):
    rows = spark.createDataFrame([(0, ["A", " a", None, "", "b ", "B", "Ä", "ä"]), (1, []), (2, None)], "i int, n array<string>")
    assert [r.n for r in rows.select("i", context.distinct_names(F.col("n")).alias("n")).orderBy("i").collect()] == [["A", "b", "Ä"], [], None]


def test_summaries(spark):
    turns = spark.createDataFrame(
        [(1, n, f"q{n}", [f"E{n:02d}", "E00", None]) for n in range(12)] + [(2, 0, None, None)] + [(3, 0, "word " * 200, [])] + [(4, 0, "x" * 600, [""])],
        "conv_id long, turn long, query string, e array<string>")
    got = {r.conv_id: r for r in context.conversation_summaries(turns, F.col("e")).collect()}
    assert got[1].summary == "Topics discussed: " + ", ".join(f"E{n:02d}" for n in range(10)) + ". Conversation length: 12 turns. Recent questions: q9; q10; q11" and got[1].n_entities == 12
    assert got[2].summary == "Conversation length: 1 turns. Recent questions: " and got[2].n_entities == 0
    assert got[3].summary.endswith("word...") and len(got[3].summary) <= 503
    assert got[4].summary == "Conversation length: 1 turns. Recent questions:..."
    assert context.conversation_summaries(turns.where("false"), F.col("e")).count() == 0
