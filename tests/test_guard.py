import datetime

from pyspark.sql import functions as F

from lorestream.functions import calendar
from lorestream.operators import guard

TOPICS = [
    {"topic_id": "a", "triggers": ["red car"], "attributes": ["price"]}, {"topic_id": "b", "triggers": ["red-car", "bus"], "sources": ["b.pdf"], "contents": ["bus stop"], "extra": 1},
    {"topic_id": "c", "triggers": ["bus"]}, {"topic_id": " ", "triggers": ["bus"]},
]


def topics_of(spark, *pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, h string")
    got = rows.select("i", guard.topic(F.col("q"), F.col("h"), TOPICS).alias("t")).orderBy("i").collect()
    return [r.t and (r.t.topic_id, r.t.confidence) for r in got]


def test_topics(spark):
    assert topics_of(spark, ("Red  CAR?", None), ("red car price", None), ("a bus", None), ("train", None), (None, None), ("", "bus")) == [("b", 0.75), ("a", 0.95), ("b", 0.75), None, None, None]


def test_history_only_where_the_query_leans(spark):
    assert topics_of(spark, ("what about it", "the bus"), ("the time", "the bus"), ("more", "red car price"), ("how about price", "a red car")) == [("b", 0.75), None, ("b", 0.75), ("a", 0.95)]


def test_turns_see_three_back(spark):
    turns = spark.createDataFrame([(1, n, t) for n, t in enumerate(["the bus", "hello", None, "it", "it"])] + [(2, 0, "it")], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.topic_id for r in guard.turn_topics(turns, TOPICS).collect()}
    assert got == {(1, 0): "b", (1, 1): None, (1, 2): None, (1, 3): "b", (1, 4): None, (2, 0): None}
    assert guard.turn_topics(turns.where("false"), TOPICS).count() == 0


HIT = "query_id long, topic_id string, source string, doc_id long, text string, rank long"


def test_guard_and_supplement(spark):
    hits = spark.createDataFrame([
        (1, "b", "B.PDF", 1, None, 1), (1, "b", "x", 2, "a Bus-stop", 2), (1, "b", None, 3, None, 3), (2, None, "x", 1, "y", 1), (3, "b", "x", 9, "y", 1), (4, "c", "x", 1, "y", 1), (5, "gone", "x", 1, "y", 1),
    ], HIT)
    kept = sorted((r.query_id, r.doc_id) for r in guard.guard(hits, TOPICS).collect())
    assert kept == [(1, 1), (1, 2), (2, 1), (4, 1), (5, 1)]
    report = {r.query_id: (r.n_hits, r.n_matched, r.n_removed, r.strict_no_match) for r in guard.guard_report(hits, TOPICS).collect()}
    assert report[1] == (3, 2, 1, False) and report[3] == (1, 0, 1, True)
    more = spark.createDataFrame([
        (1, "b", "b pdf", 1, "bus stop", 1), (1, "b", "b.pdf", 1, None, 2), (1, "b", "n", 5, "bus stop", 4), (1, "b", "n", 5, "bus stop", 4), (1, "b", "n", 6, "bus stop", 4), (2, None, "n", 7, "z", 1), (4, "c", "n", 8, "z", 1),
    ], HIT)
    got = sorted((r.query_id, r.source, r.doc_id) for r in guard.supplemented(guard.guard(hits, TOPICS), more, TOPICS).where("added").collect())
    assert got == [(1, "b pdf", 1), (4, "n", 8)]
    assert guard.supplemented(hits.where("false"), more.where("false"), TOPICS).count() == 0


def test_suppression(spark):
    rows = spark.createDataFrame([
        (0, "count", None, False, ["x"], ["y"], ["t"], "f"), (1, "requirement", None, True, ["x"], ["y"], ["t"], "f"), (2, "requirement", None, None, ["x"], ["x"], ["t"], "f"), (3, "requirement", None, None, ["x", None], ["y"], ["t"], "f"),
        (4, None, True, None, None, None, None, "f"), (5, None, True, None, [], [], [], ""), (6, None, None, None, None, None, None, None),
    ], "i int, intent string, exact boolean, m boolean, a array<string>, b array<string>, t array<string>, f string")
    got = rows.select("i", guard.suppression(*map(F.col, ("intent", "exact", "m", "a", "b", "t", "f"))).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [0.0, 0.0, 0.0, -0.08, -0.05, 0.0, 0.0]


def test_ranges_at_ends_of_weeks_months_and_years(spark):
    at = lambda *x: datetime.datetime(*x)
    asked = [
        ("today", at(2024, 2, 29, 23, 59), at(2024, 2, 29), at(2024, 3, 1)), ("this_month", at(2023, 12, 31), at(2023, 12, 1), at(2024, 1, 1)), ("weekend", at(2024, 1, 7, 5), at(2024, 1, 13), at(2024, 1, 15)),
        ("weekend", at(2024, 1, 6, 5), at(2024, 1, 6), at(2024, 1, 8)), ("this_week", at(2024, 1, 7, 5), at(2024, 1, 1), at(2024, 1, 8)), (None, at(2024, 1, 8), at(2024, 1, 8), at(2024, 1, 15)), ("next_week", at(2024, 1, 1), at(2024, 1, 8), at(2024, 1, 15)),
        ("ytd_forward", at(2024, 6, 1, 1), at(2024, 1, 1), at(2025, 6, 1)), ("evening_today", at(2024, 1, 1), at(2024, 1, 1, 18), at(2024, 1, 2)), ("else", at(2024, 1, 1, 1, 2), at(2024, 1, 1, 1, 2), at(2024, 1, 8, 1, 2)),
    ]
    rows = spark.createDataFrame([(i, a[0], a[1]) for i, a in enumerate(asked)], "i int, s string, n timestamp_ntz")
    got = rows.withColumn("r", calendar.range_of(F.col("s"), F.col("n"))).orderBy("i").collect()
    assert [(r.r.starts, r.r.ends) for r in got] == [(a[2], a[3]) for a in asked]


def test_days_are_of_the_wall_clock(spark):
    """On the day clocks go forward in Paris a day is still from midnight to midnight, whatever the session's zone."""
    rows = spark.sql("select timestamp_ntz'2024-03-30 23:30:00' as t, 'Europe/Paris' as z")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = rows.select(calendar.range_of(F.lit("today"), calendar.local(F.col("t"), F.col("z"))).alias("r")).first().r
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (r.starts, r.ends) == (datetime.datetime(2024, 3, 31), datetime.datetime(2024, 4, 1))


def test_event_marks(spark):
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', array('a','b'), ' Zoom', cast(null as string)), (2, null, array('a'), 'Hall', ''), (3, null, null, ' ', 'x'), (4, null, array(), cast(null as string), cast(null as string)) as t(i, s, a, p, l)")

    def kept(**marks):
        given = {k: F.lit(True) if marks.get(k) else F.lit(None).cast("boolean") for k in ("all_day", "with_others", "virtual", "in_person")}
        return [r.i for r in rows.where(calendar.passes(F.col("s"), F.col("a"), F.col("p"), F.col("l"), **given)).orderBy("i").collect()]

    assert kept() == [1, 2, 3, 4] and kept(all_day=1) == [2, 3, 4] and kept(with_others=1) == [1] and kept(virtual=1) == [1, 3] and kept(in_person=1) == [1, 2] and kept(virtual=1, in_person=1) == [1]
