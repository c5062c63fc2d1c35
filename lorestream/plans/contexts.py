"""Display orders, merged citations, distinct names and summaries of conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.operators import context
from lorestream.plans.fragments import _pick, _picked
from lorestream.plans.queries import _BM25, _benchmark, _query, _read

DATED = ["2024-03-01", "", "2023-12-31", "2024-03-01T10:00"]
_HITS = f"""with {_BM25}, h as (select query_id, doc_id, rank, case when query_id % 4 > 0 and doc_id % 5 < 3 then {_picked('doc_id', DATED)} end as "date", case when query_id % 4 > 0 and doc_id % 7 = 1 then '2024-02-' || (doc_id % 20 + 10) end as modified_at from best where rank <= 1 + query_id % 9),
o as (select *, row_number() over (partition by query_id order by coalesce(nullif("date", ''), modified_at) asc nulls last, rank) as dated, count(*) over (partition by query_id) as n from h)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, q = F.col("doc_id"), F.col("query_id")
    best = _benchmark(spark, sf_dir, 9).where(F.col("rank") <= 1 + q % 9)
    return best.select("query_id", "doc_id", "rank", F.when((q % 4 > 0) & (i % 5 < 3), _pick("doc_id", DATED)).alias("date"), F.when((q % 4 > 0) & (i % 7 == 1), F.concat(F.lit("2024-02-"), (i % 20 + 10).cast("string"))).alias("modified_at"))


@_query(f"""{_HITS} select query_id, doc_id, 'relevance' as ordering_strategy, rank as display_order from h union all select query_id, doc_id, 'chronological', dated from o
  union all select query_id, doc_id, 'lost_in_middle', case when n <= 2 then rank when rank = 2 then n when rank % 2 = 1 then (rank - 1) // 2 + 1 else n - (rank - 2) // 2 end from o""")
def display_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's best documents in the order each strategy shows them; some have dates."""
    hits = _hits(spark, sf_dir)
    shown = [context.ordered(hits, s).select("query_id", "doc_id", "ordering_strategy", F.col("display_order").cast("long").alias("display_order")) for s in context.STRATEGIES]
    return reduce(DataFrame.unionByName, shown)


_SPELT = "case doc_id % 4 when 0 then lower(source) when 1 then upper(source) when 2 then '  ' || source || ' ' else case when doc_id % 3 = 0 then ' ' else source end end"


@_query(f"""with {_BM25}, c as (select query_id, doc_id, rank, rank > 5 as later, trim({_SPELT}, ' ') as source from best join documents using (doc_id)), f as (select * from c where source <> '' qualify row_number() over (partition by query_id, lower(source) order by later, rank) = 1)
select query_id, doc_id, source, row_number() over (partition by query_id order by later, rank) as citation, case when later then null else rank end as hits from f""")
def merged_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the five best documents and of the rest merged, one for each source."""
    i, source = F.col("doc_id"), F.col("source")
    spelt = F.when(i % 4 == 0, F.lower(source)).when(i % 4 == 1, F.upper(source)).when(i % 4 == 2, F.concat(F.lit("  "), source, F.lit(" "))).otherwise(F.when(i % 3 == 0, " ").otherwise(source))
    cites = _benchmark(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("nth"), spelt.alias("source"))
    out = context.merged_citations(cites.where("nth <= 5").withColumn("hits", F.col("nth")), cites.where("nth > 5"))
    return out.select("query_id", "doc_id", "source", F.col("citation").cast("long").alias("citation"), "hits")


_NAME = "[A-Z][a-z]{2,}"
_NAMES = f"list_transform(regexp_extract_all(coalesce(text, ''), '{_NAME}'), lambda x, i: case i % 4 when 0 then upper(x) when 1 then ' ' || x || ' ' when 2 then lower(x) else case when i % 8 = 3 then '' else x end end)"


@_query(f"""with n as (select conv_id, turn, list_filter(list_transform({_NAMES}, lambda x: trim(x, ' ')), lambda x: x <> '') as n from conversations)
select conv_id, turn, array_to_string(list_filter(n, lambda x, i: list_position(list_transform(n, lambda y: lower(y)), lower(x)) = i), ',') as names from n""".replace("lambda x, i: case i % 4", "lambda x, i: case (i - 1) % 4").replace("when i % 8 = 3", "when (i - 1) % 8 = 3"))
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each turn once each, written in several ways."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_NAME), F.lit(0))
    spelt = F.transform(found, lambda x, i: F.when(i % 4 == 0, F.upper(x)).when(i % 4 == 1, F.concat(F.lit(" "), x, F.lit(" "))).when(i % 4 == 2, F.lower(x)).otherwise(F.when(i % 8 == 3, "").otherwise(x)))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(context.distinct_names(spelt), ",").alias("names"))


@_query(f"""with t as (select conv_id, turn, case when conv_id % 3 = 0 then substr(text, 1, 20) else text end as q from conversations where role = 'user'), e as (select distinct conv_id, unnest(regexp_extract_all(q, '{_NAME}')) as e from t),
n as (select conv_id, count(*) as n_entities from e group by conv_id), k as (select conv_id, string_agg(e, ', ' order by e) as topics from (select * from e qualify row_number() over (partition by conv_id order by e) <= 10) group by conv_id),
r as (select conv_id, string_agg(coalesce(q, ''), '; ' order by turn) as recent from (select * from t qualify row_number() over (partition by conv_id order by turn desc) <= 3) group by conv_id), c as (select conv_id, count(*) as n_turns from t group by conv_id),
s as (select conv_id, n_turns, coalesce(n_entities, 0) as n_entities, concat_ws('. ', 'Topics discussed: ' || topics, 'Conversation length: ' || n_turns || ' turns', 'Recent questions: ' || recent) as s from c left join n using (conv_id) left join k using (conv_id) left join r using (conv_id))
select conv_id, n_turns, n_entities, case when length(s) > 500 then regexp_replace(substr(s, 1, 500), ' [^ ]*$', '') || '...' else s end as summary from s""")
def conversation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation was about, in at most five hundred characters."""
    text = F.when(F.col("conv_id") % 3 == 0, F.substring("text", 1, 20)).otherwise(F.col("text"))
    turns = _read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.alias("query"))
    return context.conversation_summaries(turns, F.regexp_extract_all("query", F.lit(_NAME), F.lit(0)))
