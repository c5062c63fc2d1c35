"""Ingest and sync of the documents table: a first version, a second with changes, a third that dies before its commit."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.operators import ingest
from lorestream.plans.queries import _QUALITY, _query, _read
from lorestream.streaming.state import place

_GATE = "case when length(trim(coalesce(text, ''), ' ')) = 0 then 'empty' when length(trim(coalesce(text, ''), ' ')) < 200 then 'too_short' when q < 0.4 then 'low_quality' else 'accepted' end"


def _judged(name: str, rows: str) -> str:
    return f"""{name} as (select doc_id, text, {_GATE} as status from (select *, {_QUALITY} as q from (select *, length(regexp_replace(text, '\\s+', '', 'g')) / w as m
  from (select doc_id, text, len(regexp_extract_all(text, '\\S+')) as w from ({rows})))))"""


_SECOND = "case when doc_id % 14 = 0 then substr(text, 1, 150) when doc_id % 7 = 0 then text || chr(10) || 'revised' else text end"
_RUNS = f"""with {_judged("a", "select doc_id, text from documents where doc_id % 13 <> 0")}, {_judged("b", f"select doc_id, {_SECOND} as text from documents where doc_id % 11 <> 0")},
one as (select doc_id, 'new' as change, status, text from a), tracked as (select doc_id, text as before from one where status = 'accepted'),
diff as (select coalesce(b.doc_id, t.doc_id) as doc_id, b.text, b.status as gate, case when b.doc_id is null then 'deleted' when t.doc_id is null then 'new' when t.before <> coalesce(b.text, '') then 'modified' else 'unchanged' end as change
  from b full join tracked t on b.doc_id = t.doc_id), two as (select doc_id, change, case when change in ('new', 'modified') then gate else change end as status, text from diff)"""
_PAGES = "(len(string_split({0}, chr(10))) + 19) // 20"


class Interrupted(Exception):
    pass


def _die() -> None:
    raise Interrupted


def _store(spark: SparkSession, sf_dir: str) -> str:
    """A store after two syncs and a third that was broken off."""
    root, docs = place(spark, "store"), _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    text = F.col("text")
    second = F.when(F.col("file_id") % 14 == 0, F.substring(text, 1, 150)).when(F.col("file_id") % 7 == 0, F.concat(text, F.lit("\nrevised"))).otherwise(text)
    cut = ingest.pages_of(20)
    ingest.sync(docs.where("file_id % 13 <> 0"), root, 1, cut)
    ingest.sync(docs.where("file_id % 11 <> 0").withColumn("text", second), root, 2, cut)
    with contextlib.suppress(Interrupted):
        ingest.sync(docs.withColumn("text", F.upper(text)), root, 3, cut, before_commit=_die)
    return root


@_query(f"""{_RUNS}, live as (select doc_id, 2 as ingest_version, text from two where status = 'accepted' union all
  select doc_id, 1, one.text from one where status = 'accepted' and doc_id not in (select doc_id from two where status in ('accepted', 'deleted')))
select doc_id as file_id, cast(ingest_version as bigint) as ingest_version, cast({_PAGES.format('text')} as bigint) as n_chunks, md5(text) as digest from live""")
def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see of each file after two syncs and a broken one: version, chunks and their text."""
    chunks = ingest.current(spark, _store(spark, sf_dir))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n")
    return chunks.groupBy("file_id", F.col("ingest_version").cast("long").alias("ingest_version")).agg(F.count("*").alias("n_chunks"), F.md5(whole).alias("digest"))


@_query(f"""{_RUNS}, o as (select 1 as ingest_version, * from one union all select 2, * from two), s as (select ingest_version, count(*) filter (status = 'accepted') as n_indexed,
  count(*) filter (status not in ('accepted', 'unchanged', 'deleted')) as n_failed, cast(sum(case when status = 'accepted' then {_PAGES.format("coalesce(text, '')")} else 0 end) as bigint) as n_chunks from o group by ingest_version)
select cast(ingest_version as bigint) as ingest_version, n_indexed, n_failed, n_chunks, case when n_indexed > 0 and n_failed = 0 then 'success' when n_indexed > 0 then 'partial' else 'failed' end as result from s""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files indexed and refused, and chunks, of each committed version."""
    root = _store(spark, sf_dir)
    committed = ingest.read(spark, root, "versions").select("ingest_version").distinct()
    return ingest.summary(ingest.read(spark, root, "outcomes").join(committed, "ingest_version", "left_semi"))


@_query(f"""{_RUNS} select change, status, count(*) as n from two group by change, status""")
def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second sync found changed and what became of it."""
    second = ingest.read(spark, _store(spark, sf_dir), "outcomes").where("ingest_version = 2")
    return second.groupBy("change", "status").agg(F.count("*").alias("n"))
