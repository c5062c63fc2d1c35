"""Records of a service made of events, by number so that every rule speaks, and what they sum up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.functions import text as T
from lorestream.operators import evaluation, observability
from lorestream.plans import evaluation as suites
from lorestream.plans.fragments import _pick, _picked
from lorestream.plans.queries import _BM25, _QUALITY, ORACLE_SQL, _benchmark, _in, _query, _read
from lorestream.plans.stateful import cached_answers

KBS = ["legal-main", "sales", "legal-old", "ops"]
STATES = ["grounded_answer", "direct_response", "source_limited_answer", "true_out_of_scope", "conversation_transform", "partial", ""]
INTENTS = ["count", "definition", "factual", "requirement", "structured_list", "archive", "direct_answer", "summary"]
_RECORDS = f"""r0 as (select event_id as i, ts, case when user_id % 9 = 8 then null else {_picked('user_id', KBS)} end as kb, case when event_type = 'error' then 'error' else {_picked('event_id', STATES)} end as state, case when event_id % 23 = 0 then null else {_picked('event_id', INTENTS)} end as intent,
  case when event_id % 11 = 0 then 'structured_count' end as mode, case when event_id % 19 = 0 then null else value end as latency, case when event_id % 13 = 0 then null else event_id % 4 end as accepted, event_id % 3 as citations, event_id % 5 = 0 as fallback, event_id % 9 = 0 as capped,
  case when event_id % 10 = 0 then 2 end as unsupported, case when event_id % 14 = 0 then 1 else 0 end as failures, event_id * 7 % 300 as words from events),
r as (select *, list_filter([case when kb like 'legal%' and coalesce(accepted, 0) <= 0 and state in ({_in(observability.ANSWERED)}) then 'answer_without_accepted_evidence' end, case when fallback and intent in ({_in(observability.RISKY_INTENTS)}) then 'fallback_used_for_high_risk_query' end,
  case when unsupported > 0 then 'unsupported_claims_detected' end, case when failures > 0 then 'citation_validation_failures' end, case when capped then 'confidence_cap_applied' end,
  case when intent in ({_in(observability.DIRECT_INTENTS)}) and latency > 9.0 then 'direct_answer_latency_budget_exceeded' end], lambda x: x is not null) as alerts from r0)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = _read(spark, sf_dir, "events").select(
        "event_id", "ts", F.when(F.col("user_id") % 9 != 8, _pick("user_id", KBS)).alias("kb"), F.when(F.col("event_type") == "error", "error").otherwise(_pick("event_id", STATES)).alias("answer_state"), F.when(i % 23 != 0, _pick("event_id", INTENTS)).alias("intent"),
        F.when(i % 11 == 0, "structured_count").alias("mode"), F.when(i % 19 != 0, F.col("value")).alias("latency"), F.when(i % 13 != 0, i % 4).alias("accepted"), (i % 3).alias("citations"), (i % 5 == 0).alias("fallback"), (i % 9 == 0).alias("capped"),
        F.when(i % 10 == 0, 2).alias("unsupported"), F.when(i % 14 == 0, 1).otherwise(0).alias("failures"), (i * 7 % 300).alias("words"),
    )
    return observability.with_alerts(rows, "legal")


@_query(f"with {_RECORDS} select i as event_id, array_to_string(alerts, ',') as alerts from r where len(alerts) > 0")
def record_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break a rule, with all they break."""
    return _records(spark, sf_dir).where(F.size("alerts") > 0).select("event_id", F.array_join("alerts", ",").alias("alerts"))


_KEY = "coalesce(nullif({0}, ''), 'unknown')"
_TOTAL = {
    "source_limited": "state = 'source_limited_answer'", "true_out_of_scope": "state = 'true_out_of_scope'", "no_accepted_evidence": "coalesce(accepted, 0) <= 0", "fallback_used": "fallback", "confidence_cap": "capped", "unsupported_claim": "unsupported > 0", "citation_validation_failure": "failures > 0",
}
_STRUCTURED = "coalesce(intent in ('count', 'structured_list'), false) or coalesce(mode in ('structured_count', 'structured_list'), false)"
_SUMMARY = f"""a as (select *, coalesce(latency, 0) as l from w where coalesce(state, '') <> 'error')
select 'count' as metric, 'events' as key, count(*)::double as value from w union all select 'count', 'queries', count(*) from a union all select 'count', 'errors', (select count(*) from w) - count(*) from a union all select 'latency_max', 'all', coalesce(round(max(l), 3), 0) from a
union all select 'average', 'accepted_evidence', coalesce(round(avg(coalesce(accepted, 0)), 3), 0) from a union all select 'average', 'answer_words', coalesce(round(avg(words), 3), 0) from a
{" ".join(f"union all select 'rate', '{k}', coalesce(round(count(*) filter ({c}) / nullif(count(*), 0), 4), 0) from a" for k, c in _TOTAL.items())}
union all select 'rate', 'followup_transform_success', max(case when state = 'conversation_transform' then 1 else 0 end) from a
union all select 'rate', 'structured_search_exact_result', coalesce(round(count(*) filter (accepted > 0 and citations > 0) / nullif(count(*), 0), 4), 0) from a where {_STRUCTURED}
union all select 'alert', c, count(*) from (select unnest(alerts) as c from w) group by c
{" ".join(f"union all select '{m}', {_KEY.format(c)}, count(*) from a group by all" for m, c in (("answer_state", "state"), ("intent", "intent"), ("kb", "kb")))}
{" ".join(f"union all select 'latency_{n}{m}', {k}, round(quantile_cont(l, {s}), 3) from a group by all" for n, s in (("p50", 0.5), ("p95", 0.95)) for m, k in (("", "'all'"), ("_by_intent", _KEY.format("intent")), ("_by_kb", _KEY.format("kb"))))}"""


@_query(f"with {_RECORDS}, w as (select * from r), {_SUMMARY}")
def query_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates, averages, distributions, latencies and alerts of all records."""
    return observability.summary(_records(spark, sf_dir))


@_query(f"with {_RECORDS}, w as (select * from r where kb = 'legal-main' order by ts desc, i desc limit 500), {_SUMMARY}")
def recent_query_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the newest five hundred records of one knowledge base."""
    return observability.summary(_records(spark, sf_dir), 500, "legal-main")


_FLAGS = ["low_alpha_ratio", "tables_present", "extraction_error", "", "low_text_quality"]
_EVIDENCE = f"""with {_BM25}, h as (select query_id, doc_id, case when doc_id % 7 = 6 then null else round(case when text is null then 0.0 else {_QUALITY} end, 6) * (1 + query_id % 3) / 3 end as quality,
  case when doc_id % 11 = 10 then null when doc_id % 5 = 3 or query_id % 2 = 1 then []::varchar[] else ['scanned', {_picked('doc_id', _FLAGS)}] end as flags, case when doc_id % 29 = 0 then true end as poor
  from best join (select *, length(regexp_replace(text, '\\s+', '', 'g')) / w as m from (select *, len(regexp_extract_all(text, '\\S+')) as w from documents)) using (doc_id) where rank <= 1 + query_id % 4)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, q = F.col("doc_id"), F.col("query_id")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = _benchmark(spark, sf_dir, 4).where(F.col("rank") <= 1 + q % 4).select("query_id", "doc_id").join(docs, "doc_id")
    flags = F.when(i % 11 != 10, F.when((i % 5 == 3) | (q % 2 == 1), F.array().cast("array<string>")).otherwise(F.array(F.lit("scanned"), _pick("doc_id", _FLAGS))))
    return hits.select("query_id", "doc_id", F.when(i % 7 != 6, F.round(T.quality_score(F.col("text")), 6) * (1 + q % 3) / 3).alias("quality"), flags.alias("flags"), F.when(i % 29 == 0, True).alias("poor"))


@_query(f"""{_EVIDENCE}, l as (select *, coalesce(poor, false) or len(list_intersect(coalesce(flags, []), [{_in(observability.LOW_FLAGS)}])) > 0 or coalesce(quality < 0.55, false) as low from h),
f as (select query_id, string_agg(f, ',' order by f) as flags, bool_or(f in ({_in(observability.LIMITING_FLAGS)})) as limiting from (select distinct query_id, unnest(flags) as f from l) group by query_id),
p as (select query_id, count(*) as n_hits, count(*) filter (low) as n_low, min(quality) as worst, avg(quality) as mean from l group by query_id),
q as (select item_id as query_id, item_id % 4 < 3 as high_risk from benchmark union all select item_id + 1000000, true from benchmark where item_id % 10 = 0),
a as (select q.*, coalesce(n_hits, 0) as n_hits, coalesce(n_low, 0) as n_low, worst, mean, coalesce(flags, '') as flags, coalesce(n_low = n_hits, false) as every, coalesce(n_low = n_hits, false) and high_risk and coalesce(mean < 0.45, true) and coalesce(limiting, false) as source_limited from q left join p using (query_id) left join f using (query_id))
select query_id, n_hits, n_low, round(n_low / greatest(n_hits, 1), 6) as low_ratio, round(worst, 6) as worst, round(mean, 6) as mean, source_limited, case when every then 0.45::double when n_low > 0 then 0.65::double end as cap,
  concat_ws(',', case when every then 'all_final_evidence_low_extraction_quality' when n_low > 0 then 'some_final_evidence_low_extraction_quality' end, case when source_limited then 'high_risk_query_with_only_low_quality_evidence' end) as reasons, flags from a""")
def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the evidence of each question was extracted, and what that caps; some questions have none."""
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 4 < 3).alias("high_risk"))
    more = asked.where("query_id % 10 = 0").select(F.col("query_id") + 1000000, F.lit(True))
    out = observability.evidence_quality(asked.union(more), _evidence(spark, sf_dir))
    return out.withColumns({"reasons": F.array_join("reasons", ","), "flags": F.array_join("flags", ",")})


@_query(f"""{_EVIDENCE} select query_id, round(0.4 * least(count(quality) / count(*), 1) + 0.4 * least(greatest(coalesce(avg(quality), 0), 0), 1) + 0.2 * least(count(*) / 3, 1), 4)::double as confidence from h group by query_id""")
def cited_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence by the share of hits of known quality, their mean and their number."""
    per = _evidence(spark, sf_dir).groupBy("query_id").agg((F.count("quality") / F.count("*")).alias("coverage"), F.avg("quality").alias("score"), F.count("*").alias("n"))
    return per.select("query_id", F.round(observability.cited_confidence(*map(F.col, ("coverage", "score", "n"))), 4).alias("confidence"))


@_query(f"with k as ({ORACLE_SQL['cached_answers']}) select cache_key, count(*) as n_requests, count(*) filter (hit) as n_hits, count(*) filter (not hit) as n_misses, round(count(*) filter (hit) / count(*), 4) as hit_rate from k group by cache_key".replace("with k as (with recursive", "with recursive k as (with recursive"))
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of the cache of answers by kind of question."""
    return observability.cache_statistics(cached_answers(spark, sf_dir), "cache_key")


@_query(f"""{suites._CASES}, o as (select * from e union all select * replace ('passed' as query_class) from e where len(failures) = 0), m as (select query_class as g, {suites._GATES} from o group by query_class), c as (select 'all' as g, {suites._GATES} from e),
n as (select m.*, {suites._rank('latency', 0.95, 'o', ' and x.query_class = m.g')} as p95, passed / total as pass_rate from m), b as (select c.*, {suites._rank('latency', 0.95)} as p95, passed / total as pass_rate from c),
j as (select n.g, round(n.pass_rate, 4) as pass_rate, n.source_accuracy, n.p95, round(round(n.pass_rate, 4) - round(b.pass_rate, 4), 4) as pass_rate_delta, round(n.source_accuracy - b.source_accuracy, 4) as source_accuracy_delta, round(n.p95 - b.p95, 4) as latency_p95_delta, n.failed from n, b),
k as (select *, list_filter([case when failed > 0 then 'retrieval_gate_failed' end, case when pass_rate < 0.3 then 'hard_pass_rate_below_threshold' end, case when source_accuracy < 0.4 then 'hard_source_accuracy_below_threshold' end, case when p95 > 9.4 then 'hard_latency_p95_above_threshold' end,
  case when source_accuracy_delta < -0.02 then 'source_accuracy_regressed_vs_baseline' end, case when pass_rate_delta < -0.02 then 'pass_rate_regressed_vs_baseline' end, case when latency_p95_delta > 0.03 then 'latency_regressed_vs_baseline' end], lambda x: x is not null) as blockers from j)
select g as "group", pass_rate, source_accuracy, p95 as latency_p95, pass_rate_delta, source_accuracy_delta, latency_p95_delta, array_to_string(blockers, ',') as blockers, len(blockers) = 0 as eligible from k""")
def canary_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each class of the suite, and the cases that pass, may go to a canary, held against the whole suite as baseline."""
    rows = evaluation.evaluate(suites._suite(spark, sf_dir), suites._responses(spark, sf_dir))
    out = evaluation.canary(evaluation.gate_metrics(rows.unionByName(rows.where("passed").withColumn("query_class", F.lit("passed"))), "query_class"), evaluation.gate_metrics(rows), least_pass=0.3, least_accuracy=0.4, slowest=9.4, drop=0.02, slower=0.03)
    return out.withColumn("blockers", F.array_join("blockers", ","))
