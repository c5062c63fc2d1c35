"""Turns and passages as questions, with fragments that make every rule speak."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.functions import questions as Q
from lorestream.plans.fragments import _pick, _picked
from lorestream.plans.queries import _BM25, _benchmark, _in, _query, _read

FRONT = ["Why and how do they compare, and then what is the difference; as a result? ", "Explain the cause, the effect, the reason? ", "In addition, therefore; furthermore more? ", ""]
_WORDS = "list_distinct(regexp_extract_all(lower(q), '\\S+'))"
_HOPS = " + ".join(f"contains(lower(q), '{h}')::int" for h in Q.HOPS)
_SCORE = f"""greatest(0.1, least(0.95, 0.2 * least(len(regexp_extract_all(q, '\\S+')) / 20, 1.0) + 0.3 * least((len(list_filter({_WORDS}, lambda w: w in ({_in(Q.COMPARING)}))) + len(list_filter({_WORDS}, lambda w: w in ({_in(Q.ANALYTIC)})))) / 3, 1.0)
  + 0.15 * least(({_HOPS}) / 2, 1.0) + 0.15 * least(len(regexp_extract_all(q, '[?,;]')) / 3, 1.0)))"""
_TURNS = f"(select conv_id, turn, {_picked('turn', FRONT)} || case when conv_id % 3 = 0 then substr(text, 1, 30) else text end as q from conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("conv_id") % 3 == 0, F.substring("text", 1, 30)).otherwise(F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(_pick("turn", FRONT), text).alias("q"))


@_query(f"select conv_id, turn, round({_SCORE}, 4)::double as complexity from {_TURNS}")
def question_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complex each turn is as a question."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(Q.complexity(F.col("q")), 4).alias("complexity"))


@_query(f"""with s as (select turn, round({_SCORE}, 9) as c from {_TURNS}) select case when turn % 3 = 0 then 'direct' else 'retrieve' end as route, case when c < 0.3 then 'simple' when c < 0.6 then 'moderate' else 'complex' end as band, count(*) as n, round(avg(c), 4)::double as mean from s group by all""")
def routing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by route and band of complexity."""
    scored = _turns(spark, sf_dir).select(F.when(F.col("turn") % 3 == 0, "direct").otherwise("retrieve").alias("route"), F.round(Q.complexity(F.col("q")), 9).alias("c"))
    return scored.groupBy("route", Q.band(F.col("c")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("c"), 4).alias("mean"))


ASKED = ["Hello!", " what's UP ", "ok", "Thank you.", "h", "?", "test test", "Hi, who are you?", "@#$%", "#a1!", "<script>x", "   ", "Yo", "no such thing"]
_ASKED = f"(select doc_id, case when doc_id % 37 = 36 then null when doc_id % 5 = 4 then repeat(coalesce(text, ''), 3) else {_picked('doc_id', ASKED)} end as q from documents)"
_LOW = "regexp_replace(lower(q), '^\\s+|\\s+$', '', 'g')"
_BARE = "regexp_replace(q, '^\\s+|\\s+$', '', 'g')"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@_query(f"""with a as (select *, {_LOW} as low, {_BARE} as b from {_ASKED}), w as (select *, regexp_extract_all(low, '[a-z0-9'']+') as w, array_to_string(regexp_extract_all(low, '[a-z0-9'']+'), ' ') as c from a),
v as (select case when q is null then 'missing' when b = '' then 'empty' when length(b) > 4000 then 'too_long' when regexp_matches(b, '{Q.UNSAFE}') then 'unsafe' when regexp_matches(b, '^[^\\p{{L}}\\p{{N}}_\\s]+$') then 'symbols'
  when regexp_matches(b, '[^\\p{{L}}\\p{{N}}_\\s]') and length(regexp_replace(low, '[^a-z0-9]', '', 'g')) <= 3 then 'noise' else 'ok' end as verdict, case when low = '' then null when low in ({_quoted(Q.NOTHING)}) or len(w) = 1 and length(w[1]) <= 2 and c not in ({_quoted(Q.GREETINGS + Q.THANKS)}) then 'meaningless'
  when len(list_filter(w, lambda x: x in ({_in(Q.ASKING)}))) > 0 then null when c in ({_quoted(Q.GREETINGS)}) or replace(c, '''', '') in ({_quoted(Q.GREETINGS)}) then 'greeting' when c in ({_quoted(Q.THANKS)}) or replace(c, '''', '') in ({_quoted(Q.THANKS)}) then 'acknowledgment'
  when c in ({_quoted(Q.NOTHING)}) then 'meaningless' end as talk from w) select verdict, talk, count(*) as n from v group by all""")
def question_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by verdict and kind of small talk."""
    i = F.col("doc_id")
    q = F.when(i % 37 == 36, None).when(i % 5 == 4, F.repeat(F.coalesce("text", F.lit("")), F.lit(3))).otherwise(_pick("doc_id", ASKED))
    asked = _read(spark, sf_dir, "documents").select(q.alias("q"))
    return asked.groupBy(Q.verdict(F.col("q")).alias("verdict"), Q.small_talk(F.col("q")).alias("talk")).agg(F.count("*").alias("n"))


OFFERING = ["Would you like to know more? ", "", "Feel free to ask! Let me know if you agree. ", "If needed, I can offer clarification. "]
_ANSWER = f"{_picked('turn', OFFERING)} || case when conv_id % 5 = 0 then '' else text end"
_OFFER = "|".join(Q.OFFERS)


@_query(f"""with a as (select conv_id, turn, regexp_replace({_ANSWER}, '^\\s+|\\s+$', '', 'g') as b from conversations), c as (select *, list_transform(regexp_split_to_array(b, '[.!?]+\\s+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) as l from a),
f as (select *, list_filter(l, lambda s: s <> '' and not regexp_matches(lower(s), '{_OFFER}'))[1:2] as facts from c), g as (select *, case when len(facts) > 0 then array_to_string(facts, '. ') else l[1] end as chosen from f)
select conv_id, turn, case when length(b) < 150 then b when regexp_matches(chosen, '[.!?]$') then chosen else chosen || '.' end as summary from g""")
def answer_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sentences of each answer that offer nothing further."""
    answer = F.concat(_pick("turn", OFFERING), F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("text")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", Q.summary(answer).alias("summary"))


@_query(f"""with {_BM25}, p as (select query_id, avg(1 / rank) as rel, avg(case when query_id % 3 > 0 then case when query_id % 3 = 1 then 0.9 else 0.0 end end) as nli, least(query_id % 4, count(*)) as cited, count(*) as docs, query_id % 7 <> 0 as answered from best where rank <= 3 group by query_id),
w as (select *, 0.5 * rel + 0.25 * coalesce(nli, 0.5) + 0.15 * least(cited / greatest(1, least(2, docs)), 1.0) + 0.1 * answered::int as whole from p),
c as (select *, list_filter([case when query_id % 4 = 1 and whole > 0.3 then 'low_citation_relevance' end, case when query_id % 5 = 0 and whole > 0.55 then 'verification_fallback_used' end, case when query_id % 10 = 0 and whole > 0.45 then 'fallback_without_nli_support' end], lambda x: x is not null) as caps from w)
select query_id, round(least(whole, case when list_contains(caps, 'low_citation_relevance') then 0.3 when list_contains(caps, 'fallback_without_nli_support') then 0.45 when len(caps) > 0 then 0.55 else 1 end), 6)::double as confidence, round(whole, 6)::double as uncapped, array_to_string(caps, ',') as caps from c""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in an answer to each passage from its three best documents, and what caps it."""
    i = F.col("query_id")
    hits = _benchmark(spark, sf_dir, 3).select("query_id", (1 / F.col("rank")).alias("rel"), F.when(i % 3 == 1, 0.9).when(i % 3 == 2, 0.0).alias("nli"))
    per = hits.groupBy("query_id").agg(F.avg("rel").alias("rel"), F.avg("nli").alias("nli"), F.count("*").alias("docs"))
    caps = [("low_citation_relevance", 0.3, i % 4 == 1), ("verification_fallback_used", 0.55, i % 5 == 0), ("fallback_without_nli_support", 0.45, i % 10 == 0)]
    out = per.select("query_id", Q.confidence(F.col("rel"), F.col("nli"), F.least(i % 4, F.col("docs")), F.col("docs"), i % 7 != 0, caps).alias("c")).select("query_id", "c.*")
    return out.withColumn("caps", F.array_join("caps", ","))
