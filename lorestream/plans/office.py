"""Documents as office files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.plans.queries import _query, _read
from lorestream.sources import office

_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\\S'))"


@_query(f"""with d as (select doc_id, source, list_transform({_LINES}, lambda x: case when doc_id % 4 = 2 then regexp_replace(x, '^\\s+|\\s+$', '', 'g') else x end) as l, doc_id % 4 as kind from documents),
t as (select *, case kind when 0 then l when 1 then ['=== Sheet: Lines ===', '', 'Columns: n, line', ''] || list_transform(l, lambda x, i: 'Row ' || i || ': n: ' || i || ' | line: ' || x)
  when 2 then flatten(list_transform(range(0, len(l), 5), lambda s: ['--- Slide ' || (s // 5 + 1) || ' ---'] || l[s + 1:s + 5] || ['[Speaker note] note ' || (s // 5 + 1)])) else [] end as lines from d)
select doc_id, case kind when 3 then 'corrupt' else case when len(lines) = 0 then 'empty' else 'ok' end end as status, case kind when 3 then 0 when 2 then greatest(1, (len(l) + 4) // 5) else greatest(1, (len(lines) + 49) // 50) end as n_pages,
  case when kind < 3 then len(lines) end as n_lines, case when kind < 3 then md5(array_to_string(lines, chr(10))) end as digest, case when kind < 3 then source end as title from t""")
def office_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as DOCX, XLSX and PPTX, a quarter of them broken, and what is read from them."""
    kind = F.element_at(F.array(*map(F.lit, ("docx", "xlsx", "pptx", "docx"))), (F.col("doc_id") % 4 + 1).cast("int"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    made = _read(spark, sf_dir, "documents").select("doc_id", kind.alias("extension"), office.office_bytes(kind, lines, F.col("source")).alias("content"))
    broken = F.when(F.col("doc_id") % 4 == 3, F.expr("substring(content, 1, length(content) div 2)")).otherwise(F.col("content"))
    pages = office.office_pages(made.withColumn("content", broken))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n")
    per = pages.groupBy("doc_id").agg(F.first("status").alias("status"), F.count("page_number").alias("n_pages"), F.sum("n_lines").alias("n_lines"), F.md5(whole).alias("digest"), F.max("title").alias("title"))
    return per.withColumn("digest", F.when(F.col("status") != "corrupt", F.col("digest")))
