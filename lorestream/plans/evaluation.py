"""An evaluation suite made of the benchmark, with answers made of its best documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.operators import evaluation
from lorestream.plans.queries import _BM25, _benchmark, _query, _read
from lorestream.streaming.state import place, written


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as JSON lines among comments and blank lines, and read back."""
    i, words = F.col("item_id"), F.split("text", " ")
    source = lambda n: F.concat(F.lit("SRC"), (i % n).cast("string"))
    expect = F.struct(
        F.when(i % 2 == 0, F.array(source(20))).alias("sources_any"), F.when(i % 7 == 0, F.lit(source(3))).alias("sources_all"), F.when(i % 3 == 0, F.array(F.upper(words[0]))).alias("entities_all"),
        F.when(i % 4 == 0, F.array(F.lit("zzz"), words[1])).alias("entities_any"), F.when(i % 5 == 0, F.array(source(9))).alias("codes_any"), F.when(i % 6 == 0, F.array(F.lit("src3"))).alias("not_contains"),
        F.when(i % 2 == 1, F.lit(3)).alias("min_citations"), F.lit(8.5).alias("max_latency_seconds"), F.when(i % 9 == 0, F.array(F.lit("grounded"), F.lit("partial"))).alias("answer_state_in"),
        F.when(i % 8 == 0, F.array(words[2])).alias("answer_contains_any"), F.when(i % 10 == 0, F.lit(40)).alias("max_sparse_ms"), F.when(i % 11 == 0, F.array(F.lit("bm25"))).alias("retrieval_backend_in"),
    )
    case = F.to_json(F.struct(F.concat(F.lit("c"), i.cast("string")).alias("id"), F.lit("kb").alias("kb_id"), F.col("text").alias("query"), F.when(i % 3 > 0, F.concat(F.lit("class"), (i % 3).cast("string"))).alias("query_class"), expect.alias("expect")))
    at = place(spark, "suite")
    _read(spark, sf_dir, "benchmark").select(F.concat(F.when(i % 10 == 0, F.lit("# next ten\n\n")).otherwise(F.lit("")), case).alias("value")).write.text(at)
    return evaluation.load_suite(spark, at)


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a service would have answered: the best document, citations of the three best, state and times by number."""
    i = F.col("query_id")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    best = _benchmark(spark, sf_dir, 3).join(docs, "doc_id")
    cited = F.struct("rank", F.struct(F.col("source"), F.substring("text", 1, 100).alias("text"), F.col("doc_id").alias("chunk_id")).alias("c"))
    per = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(cited)), lambda x: x["c"]).alias("citations"), F.max(F.when(F.col("rank") == 1, F.substring("text", 1, 400))).alias("answer"))
    state = F.when(i % 4 == 0, "grounded").when(i % 4 == 1, "source_limited_answer").when(i % 4 == 2, "partial")
    debug = F.struct((i % 60).alias("total_ms"), F.when(i % 2 == 0, "bm25").otherwise("fts").alias("lexical_backend"))
    meta = F.struct(state.alias("answer_state"), debug.alias("sparse_debug"), F.struct(F.when(i % 5 > 0, 100 * (i % 5)).alias("max_tokens")).alias("generation_decision"), F.struct(F.when(i % 3 == 0, "direct_support").alias("admission_status")).alias("evidence_admission"))
    body = F.struct(F.when(i % 17 == 0, "error").otherwise("success").alias("status"), F.col("answer"), F.when(i % 13 == 0, F.slice("citations", 1, 0)).otherwise(F.col("citations")).alias("citations"), ((i * 37) % 100 / 10).alias("_runner_latency_seconds"), meta.alias("metadata"))
    told = written(per.select(F.concat(F.lit("c"), i.cast("string")).alias("id"), F.to_json(body).alias("body")), "responses")  # metrics read it once for each percentile
    return told.select("id", F.parse_json("body").alias("response"))


_N = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ')"
_CASES = f"""with {_BM25}, r as (select query_id as i, list({{'source': source, 't': {_N.format("concat_ws(' ', source, substr(text, 1, 100), doc_id)")}}} order by rank) as c, max(case when rank = 1 then substr(text, 1, 400) end) as answer from best join documents using (doc_id) where rank <= 3 group by query_id),
s as (select i, case when i % 13 = 0 then []::varchar[] else list_transform(c, lambda x: x.t) end as cited, answer, string_split(b.text, ' ') as w, case i % 4 when 0 then 'grounded' when 1 then 'source_limited_answer' when 2 then 'partial' end as state, (i * 37) % 100 / 10 as latency from r join benchmark b on b.item_id = i),
t as (select *, {_N.format("concat_ws(' ', answer, nullif(array_to_string(cited, ' '), ''))")} as search, list_filter([case when i % 2 = 0 then 'src' || (i % 20) end, case when i % 7 = 0 then 'src' || (i % 3) end], lambda x: x is not null) as sources from s),
u as (select *, list_min(list_filter(list_transform(range(1, len(cited) + 1), lambda p: case when len(list_filter(sources, lambda x: contains(cited[p], x))) > 0 then p end), lambda x: x is not null)) as rank from t),
e as (select i, 'c' || i as id, coalesce('class' || nullif(i % 3, 0), 'unknown') as query_class, latency, cast(i % 60 as double) as sparse_ms, rank as source_rank, coalesce(round(1 / rank, 3), 0) as mrr, len(sources) > 0 as source_expected, rank is not null as source_hit,
  i % 5 = 0 as code_expected, i % 5 = 0 and contains(search, 'src' || (i % 9)) as code_hit, i % 3 = 0 or i % 4 = 0 as entity_expected,
  (i % 3 = 0 or i % 4 = 0) and (i % 3 <> 0 or contains(search, {_N.format('w[1]')})) and (i % 4 <> 0 or contains(search, 'zzz') or contains(search, {_N.format('w[2]')})) as entity_hit, len(cited) = 0 as no_evidence, coalesce(state = 'source_limited_answer', false) as source_limited,
  list_sort(list_filter([case when i % 17 = 0 then 'status' end, case when i % 9 = 0 and coalesce(state, '') not in ('grounded', 'partial') then 'answer_state_in' end, case when i % 2 = 1 and len(cited) < 3 then 'min_citations' end, case when i % 2 = 0 and not contains(search, 'src' || (i % 20)) then 'sources_any' end,
  case when i % 7 = 0 and not contains(search, 'src' || (i % 3)) then 'sources_all' end, case when i % 3 = 0 and not contains(search, {_N.format('w[1]')}) then 'entities_all' end, case when i % 4 = 0 and not (contains(search, 'zzz') or contains(search, {_N.format('w[2]')})) then 'entities_any' end,
  case when i % 5 = 0 and not contains(search, 'src' || (i % 9)) then 'codes_any' end, case when i % 8 = 0 and not contains({_N.format('answer')}, {_N.format('w[3]')}) then 'answer_contains_any' end, case when i % 6 = 0 and contains(search, 'src3') then 'not_contains' end, case when latency > 8.5 then 'max_latency_seconds' end,
  case when i % 10 = 0 and i % 60 > 40 then 'max_sparse_ms' end, case when i % 11 = 0 and i % 2 = 1 then 'retrieval_backend_in' end], lambda x: x is not null)) as failures from u)"""


def _rank(value: str, share: float, rows: str = "e", by: str = "") -> str:
    return f"(select round(quantile_cont({value}, {share}), 3) from {rows} x where true{by})"


_RATE = "round(count(*) filter ({0} and {1}) / nullif(count(*) filter ({1}), 0), 4) as {2}"
_GATES = f"""count(*) as total, count(*) filter (len(failures) = 0) as passed, count(*) filter (len(failures) > 0) as failed, {_RATE.format('source_hit', 'source_expected', 'source_accuracy')}, {_RATE.format('code_hit', 'code_expected', 'code_hit_rate')},
  {_RATE.format('entity_hit', 'entity_expected', 'entity_hit_rate')}, round(avg(case when source_expected then mrr end), 4) as mrr, round(avg(no_evidence::int), 4) as no_evidence_rate, round(avg(source_limited::int), 4) as source_limited_rate"""


@_query(f"{_CASES} select id, query_class, len(failures) = 0 as passed, array_to_string(failures, ',') as failures, source_rank, mrr, code_hit, entity_hit, no_evidence from e")
def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each case of the suite fails, and its metrics."""
    out = evaluation.evaluate(_suite(spark, sf_dir), _responses(spark, sf_dir))
    return out.select("id", "query_class", "passed", F.array_join("failures", ",").alias("failures"), F.col("source_rank").cast("long").alias("source_rank"), "mrr", "code_hit", "entity_hit", "no_evidence")


def _percentiles(by: str = "") -> str:
    return ", ".join(f"{_rank(v, s, by=by)} as {n}" for n, v, s in (("latency_p50", "latency", 0.5), ("latency_p95", "latency", 0.95), ("latency_p99", "latency", 0.99), ("sparse_p50", "sparse_ms", 0.5), ("sparse_p95", "sparse_ms", 0.95)))


@_query(f"{_CASES}, m as (select query_class as g, {_GATES} from e group by query_class) select g as \"group\", m.* exclude (g), {_percentiles(' and x.query_class = m.g')} from m union all select 'all', {_GATES}, {_percentiles()} from e".replace("m.* exclude (g)", "total, passed, failed, source_accuracy, code_hit_rate, entity_hit_rate, mrr, no_evidence_rate, source_limited_rate"))
def eval_gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, percentiles and hit rates of the suite, over all and by class."""
    rows = evaluation.evaluate(_suite(spark, sf_dir), _responses(spark, sf_dir))
    return evaluation.gate_metrics(rows).unionByName(evaluation.gate_metrics(rows, "query_class"))


@_query(f"""{_CASES}, m as (select {_GATES}, {_rank('latency', 0.95)} as latency_p95 from e), g as (select 'latency_p95' as gate, latency_p95 as value, 8.0::double as "limit", latency_p95 > 8.0 as bad from m union all select 'source_accuracy', source_accuracy, 0.8, source_accuracy < 0.8 from m
  union all select 'code_hit_rate', code_hit_rate, 0.8, code_hit_rate < 0.8 from m union all select 'entity_hit_rate', entity_hit_rate, 0.8, entity_hit_rate < 0.8 from m union all select 'cases', failed, 0.0, failed > 0 from m)
select 'all' as "group", gate, cast(value as double) as value, "limit" from g where bad""")
def eval_gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates the suite does not meet."""
    rows = evaluation.evaluate(_suite(spark, sf_dir), _responses(spark, sf_dir))
    return evaluation.gate_failures(evaluation.gate_metrics(rows), slowest=8.0)


@_query(f"""{_CASES}, a as (select i, latency, coalesce(state, 'missing') as state, case when i % 3 = 0 then 'direct_support' else 'missing' end as admission, len(cited) as citations, len(regexp_extract_all(answer, '\\S+')) as words, case when i % 5 > 0 then 100 * (i % 5) end as tokens from u)
select 'answer_states' as metric, state as key, cast(count(*) as double) as value from a group by state union all select 'admission', admission, count(*) from a group by admission union all select 'latency_count', 'all', count(*) from a union all select 'latency_max', 'all', max(latency) from a
union all select 'citation_count_avg', 'all', round(avg(citations), 3) from a union all select 'answer_words_avg', 'all', round(avg(words), 3) from a union all select 'tokens_min', 'all', min(tokens) from a union all select 'tokens_max', 'all', max(tokens) from a union all select 'tokens_avg', 'all', round(avg(tokens), 3) from a
union all select 'latency_p50', 'all', {_rank('latency', 0.5, 'a')} union all select 'latency_p95', 'all', {_rank('latency', 0.95, 'a')}""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies, states, citations, words and token limits of all responses."""
    return evaluation.regression_metrics(_responses(spark, sf_dir))
