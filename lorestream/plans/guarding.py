"""Guard topics and calendar questions over the given tables, altered by number so that every rule speaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.functions import calendar
from lorestream.operators import guard
from lorestream.plans.fragments import _pick, _picked
from lorestream.plans.queries import _BM25, _benchmark, _query, _read
from lorestream.streaming.state import place

TOPICS = [
    {"topic_id": "north", "triggers": ["Heating-plan", "radiator", " "], "attributes": ["cost", "limit of"], "sources": ["source-1", "src1"], "contents": ["er the", "THE."], "extra": 2},
    {"topic_id": "south", "triggers": ["heating plan", "Boiler"], "sources": ["src2"], "extra": 3},
    {"topic_id": "east", "triggers": ["§ 12.5"], "contents": ["and"], "extra": 0},
    {"topic_id": "west", "triggers": ["pump"]},
]
TURNS = ["What does the heating plan cost? ", "And the boiler; ", "what about it? ", "Under § 12.5, ", "more ", "The heating-plan: ", "Radiator; ", "pump, ", "", "Explain "]
_FOLD = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9§.]+', ' ', 'g')"


def _any(text: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {_FOLD.format(repr(p))})" for p in patterns if p.strip()) + ")"


def _topic_sql(own: str, seen: str) -> str:
    """The first of the surest topics, as id|confidence."""
    sure = [f"case when {_any(own, t['attributes'])} then 0.95 else 0.65 end" if "attributes" in t else "0.75" for t in TOPICS]
    listed = ", ".join(f"case when {_any(seen, t['triggers'])} then {{'c': cast({c} as double), 'n': {-n}, 'id': '{t['topic_id']}'}} end" for n, (t, c) in enumerate(zip(TOPICS, sure)))
    return f"list_max(list_filter([{listed}], lambda x: x is not null))"


_BEFORE = "concat_ws(' ', lag(q, 3) over w, lag(q, 2) over w, lag(q, 1) over w)"
_LEANS = "regexp_matches(regexp_replace(lower(q), '^\\s+|\\s+$', '', 'g'), '" + "|".join(guard.LEANING) + "')"


@_query(f"""with t as (select conv_id, turn, {_picked('turn + conv_id', TURNS)} || coalesce(text, '') as q from conversations), h as (select *, {_BEFORE} as before from t window w as (partition by conv_id order by turn)),
s as (select *, {_FOLD.format('q')} as own, concat_ws(' ', nullif({_FOLD.format('q')}, ''), case when {_LEANS} then nullif({_FOLD.format('before')}, '') end) as seen from h), b as (select conv_id, turn, {_topic_sql('own', 'seen')} as best from s)
select conv_id, turn, best.id as topic_id, best.c as confidence from b""".replace("case turn + conv_id %", "case (turn + conv_id) %"))
def turn_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard topic of each turn, by itself or by the three turns before."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + F.col("conv_id")).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    return guard.turn_topics(turns.select("conv_id", "turn", F.concat(_pick("n", TURNS), "text").alias("text")), TOPICS)


_IDS = ["north", "south", "east", "west", None]
_HITS = f"""with {_BM25}, h as (select query_id, doc_id, rank, text, case query_id % 5 when 0 then 'north' when 1 then 'south' when 2 then 'east' when 3 then 'west' end as topic_id, case when doc_id % 10 = 1 then 'SRC1' when doc_id % 6 = 2 and query_id % 20 <> 1 then 'src2' else source || '!' end as source from best join documents using (doc_id)),
f as (select *, {_FOLD.format('source')} as s, {_FOLD.format('text')} as t from h),
g as (select *, topic_id is null or case topic_id when 'north' then {_any('s', TOPICS[0]['sources'])} or {_any('t', TOPICS[0]['contents'])} when 'south' then {_any('s', TOPICS[1]['sources'])} when 'east' then {_any('t', TOPICS[2]['contents'])} else true end as own from f)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, q = F.col("doc_id"), F.col("query_id")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    source = F.when(i % 10 == 1, "SRC1").when((i % 6 == 2) & (q % 20 != 1), "src2").otherwise(F.concat("source", F.lit("!")))
    topic_id = F.element_at(F.array(*map(F.lit, _IDS)), (q % 5 + 1).cast("int"))
    return _benchmark(spark, sf_dir).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank")).join(docs, "doc_id").select("query_id", topic_id.alias("topic_id"), source.alias("source"), "doc_id", "text", "rank")


@_query(f"{_HITS} select query_id, topic_id, count(*) as n_hits, count(*) filter (own) as n_matched, count(*) filter (not own) as n_removed, count(*) filter (own) = 0 as strict_no_match from g group by query_id, topic_id")
def guard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each question's twenty best belong to its topic."""
    return guard.guard_report(_hits(spark, sf_dir), TOPICS)


@_query(f"""{_HITS}, p as (select * from g where own and rank <= 6), x as (select *, row_number() over (partition by query_id order by rank, doc_id) as nth from g where own and topic_id is not null and rank > 3 and (query_id, s, doc_id) not in (select (query_id, s, doc_id) from p))
select query_id, topic_id, doc_id, rank, false as added from p union all select query_id, topic_id, doc_id, rank, true from x where nth <= case topic_id when 'north' then 2 when 'south' then 3 when 'east' then 0 else 5 end""")
def guarded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each question's six best those of its topic, and what others of its topic make up for the rest."""
    at = place(spark, "hits")
    _hits(spark, sf_dir).write.parquet(at)  # read three times below, ranked once
    hits = spark.read.parquet(at)
    return guard.supplemented(guard.guard(hits.where("rank <= 6"), TOPICS), hits.where("rank > 3"), TOPICS).select("query_id", "topic_id", "doc_id", "rank", "added")



@_query(f"""with {_BM25}, h as (select query_id, doc_id, case query_id % 4 when 0 then 'requirement' when 1 then 'count' when 2 then 'missing_detail' end as intent, case when query_id % 8 = 3 then true end as exact, doc_id % 9 = 0 as matches, case when doc_id % 3 = 0 then [lang] else [] end as own,
  ['en', case when query_id % 6 = 0 then 'fr' end] as facets, case when doc_id % 2 = 0 then ['t'] when doc_id % 5 > 0 then []::varchar[] end as topics, case when doc_id % 7 = 0 then '' else source end as family from best join documents using (doc_id))
select query_id, doc_id, case when not (coalesce(intent in ('requirement', 'missing_detail'), false) or coalesce(exact, false)) or matches or len(list_intersect(list_filter(facets, lambda x: x is not null), list_filter(own, lambda x: x is not null))) > 0 then 0.0::double
  when len(coalesce(topics, [])) > 0 then -0.08::double when coalesce(family, '') <> '' then -0.05::double else 0.0::double end as penalty from h""")
def suppression_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the twenty best loses where its question needs exact evidence of another topic or source."""
    i, q = F.col("doc_id"), F.col("query_id")
    none = F.array().cast("array<string>")
    hits = _benchmark(spark, sf_dir).select("query_id", "doc_id").join(_read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    intent = F.when(q % 4 == 0, "requirement").when(q % 4 == 1, "count").when(q % 4 == 2, "missing_detail")
    penalty = guard.suppression(
        intent, F.when(q % 8 == 3, True), i % 9 == 0, F.array(F.lit("en"), F.when(q % 6 == 0, "fr")), F.when(i % 3 == 0, F.array("lang")).otherwise(none),
        F.when(i % 2 == 0, F.array(F.lit("t"))).when(i % 5 > 0, none), F.when(i % 7 != 0, F.col("source")).otherwise(""))
    return hits.select("query_id", "doc_id", penalty.alias("penalty"))


ZONES = ["UTC", "Europe/Paris", "America/New_York", "Asia/Kolkata"]
ASKED = [*calendar.SCOPES, "whenever", ""]
_DAY = "(date_trunc('day', n))"
_TO = lambda a, b: f"[{a}, {b}]"
_D = lambda n: f"{_DAY} + interval {n} day"
_H = lambda n: f"{_DAY} + interval {n} hour"
_MONDAY = "date_trunc('week', n)"
_SATURDAY = f"{_DAY} + to_days((13 - isodow(n)) % 7)"
_RANGES = {
    "today": _TO(_DAY, _D(1)), "tomorrow": _TO(_D(1), _D(2)), "next_week": _TO(f"{_MONDAY} + interval 7 day", f"{_MONDAY} + interval 14 day"), "this_month": _TO("date_trunc('month', n)", "date_trunc('month', n) + interval 1 month"),
    "morning_today": _TO(_H(6), _H(12)), "afternoon_today": _TO(_H(12), _H(18)), "evening_today": _TO(_H(18), _D(1)), "weekend": _TO(f"({_SATURDAY})::timestamp", f"({_SATURDAY} + interval 2 day)::timestamp"), "soon_48h": _TO("n", "n + interval 48 hour"),
    "agenda": _TO(_DAY, _D(2)), "pipeline_14d": _TO(_DAY, _D(14)), "ytd_forward": _TO("date_trunc('year', n)", _D(365)), "whenever": _TO("n", "n + interval 7 day"),
}


@_query(f"""with e as (select event_id, {_picked('event_id', ASKED)} as scope, timezone({_picked('user_id', ZONES)}, timezone('UTC', ts)) as n from events),
r as (select event_id, scope, n, case scope {" ".join(f"when '{k}' then {v}" for k, v in _RANGES.items())} else [{_MONDAY}, {_MONDAY} + interval 7 day] end as r from e) select event_id, scope, n as asked_at, r[1]::timestamp as starts, r[2]::timestamp as ends from r""")
def calendar_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of time each event asks for, as a question at its own time in its user's zone."""
    rows = _read(spark, sf_dir, "events").select("event_id", _pick("event_id", ASKED).alias("scope"), calendar.local(F.col("ts"), _pick("user_id", ZONES)).alias("asked_at"))
    return rows.withColumn("r", calendar.range_of(F.col("scope"), F.col("asked_at"))).select("event_id", "scope", "asked_at", "r.starts", "r.ends")


PLACES = ["Room 4", "Zoom 12", "  ", "MS Teams", "https://meet.google.com/x", "Hall"]


@_query(f"""with e as (select event_id, event_id // 16 as j, event_id % 16 as m, case when event_id % 7 > 1 then ts end as starts_at from events), p as (select *, case when j % 11 = 10 then null else {_picked('j', PLACES)} end as location, case when j % 5 = 0 then 'https://x' when j % 5 = 1 then '' end as link, case when j % 3 = 2 then null else j % 3 + 1 end as n from e)
select event_id from p where (m & 1 = 0 or starts_at is null) and (m & 2 = 0 or coalesce(n, 0) >= 2) and (m & 4 = 0 or coalesce(link, '') <> '' or regexp_matches(lower(coalesce(location, '')), 'zoom|meet\\.google|teams')) and (m & 8 = 0 or (trim(coalesce(location, ''), ' ') <> '' and coalesce(link, '') = ''))""")
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that meet the marks set for them; all sixteen settings of four marks occur."""
    i = F.col("event_id")
    rows = _read(spark, sf_dir, "events").withColumn("j", F.floor(i / 16).cast("long")).withColumn("m", i % 16)
    j, mark = F.col("j"), lambda bit: F.col("m").bitwiseAND(F.lit(bit)) > 0
    people = F.when(j % 3 != 2, F.array_repeat(F.lit("a"), (j % 3 + 1).cast("int")))
    link = F.when(j % 5 == 0, "https://x").when(j % 5 == 1, "")
    kept = calendar.passes(F.when(i % 7 > 1, F.col("ts")), people, F.when(j % 11 != 10, _pick("j", PLACES)), link, all_day=mark(1), with_others=mark(2), virtual=mark(4), in_person=mark(8))
    return rows.where(kept).select("event_id")
