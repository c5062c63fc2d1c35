"""Documents and pages as files of several kinds, read back by one loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.plans.queries import _PLAIN, _query, _read
from lorestream.sources import loader

_L = "string_split(coalesce(text, ''), chr(10))"
_PAGED = "list_transform(range(0, len({0}), {1}), lambda s: {0}[s + 1:s + {1}])"


@_query(f"""with d as (select doc_id as id, ['txt', 'csv', 'json', 'csv', 'xyz'][doc_id % 5 + 1] as kind, doc_id % 5 = 3 as broken, case when doc_id % 5 = 0 and coalesce(text, '') = '' then [] else {_L} end as l, lang from documents),
t as (select *, case when kind = 'txt' then l when kind = 'csv' then list_transform(l, lambda x, i: 'Row ' || i || ': n: ' || i || ' | line: ' || x) else ['{{', '  "lang": ' || to_json(lang) || ',', '  "lines": ['] || list_transform(l, lambda x, i: '    ' || to_json(x) || case when i < len(l) then ',' else '' end) || ['  ]', '}}'] end as lines from d),
p as (select id, kind, broken, case when kind = 'xyz' or broken then [] when kind = 'txt' then {_PAGED.format('lines', 50)} when kind = 'json' then {_PAGED.format('lines', 100)} else list_transform({_PAGED.format('lines', 50)}, lambda g: ['Columns: n, line', ''] || g) end as pages from t
  union all select 1000000000 + page_id, 'html', false, {_PAGED.format('h', 50)} from (select page_id, list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as h from pages where html is not null))
select id, kind, case when kind = 'xyz' then 'unsupported' when broken then 'corrupt' when len(pages) = 0 then 'empty' else 'ok' end as status, case when kind = 'xyz' or broken then 0 else greatest(1, len(pages)) end as n_pages,
  case when kind = 'xyz' or broken then null else cast(coalesce(list_sum(list_transform(pages, lambda g: len(g))), 0) as bigint) end as n_lines, md5(array_to_string(list_transform(pages, lambda g: array_to_string(g, chr(10))), chr(10))) as digest from p""")
def loaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text, CSV, JSON, broken CSV and an unknown kind, and web pages: what the loader makes of them."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    quoted = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(',"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))
    table = F.concat(F.lit("n,line\n"), F.array_join(quoted, "\n"))
    record = F.to_json(F.struct("lang", lines.alias("lines")), {"ignoreNullFields": "false"})
    i = F.col("doc_id") % 5
    content = F.when(i == 0, F.col("text")).when(i == 1, table).when(i == 2, record).when(i == 3, F.concat(F.lit('n\n1,2,"'), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    kind = F.element_at(F.array(*map(F.lit, ("txt", "csv", "json", "csv", "xyz"))), (i + 1).cast("int"))
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kind.alias("extension"), F.encode(content, "UTF-8").alias("content"))
    pages = _read(spark, sf_dir, "pages").where("html is not null").select((F.col("page_id") + 1_000_000_000).alias("id"), F.lit("html").alias("extension"), F.encode("html", "UTF-8").alias("content"))
    out = loader.file_pages(docs.unionByName(pages))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n")
    return out.groupBy("id", F.col("extension").alias("kind")).agg(F.first("status").alias("status"), F.count("page_number").alias("n_pages"), F.sum("n_lines").alias("n_lines"), F.md5(whole).alias("digest"))


@_query("""select doc_id, md5('lang: ' || coalesce(lang, 'None') || chr(10) || 'lines:' || chr(10) || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: '  - ' || x), chr(10)) || chr(10) || 'at:' || chr(10) || '  [0]:' || chr(10) || '    doc: ' || doc_id) as digest from documents""")
def json_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's record as an outline."""
    record = F.to_json(F.struct("lang", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.array(F.create_map(F.lit("doc"), F.col("doc_id"))).alias("at")), {"ignoreNullFields": "false"})
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(loader.json_outline(record)).alias("digest"))
