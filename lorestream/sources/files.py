"""Documents from files: text with encoding fallback, Markdown, JSON, CSV and HTML, in fixed-size pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUPPORTED = ("txt", "md", "json", "csv", "html", "htm")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size, extension, content) of all files below a folder; unsupported ones have supported = false."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), ext.alias("extension"), ext.isin(*SUPPORTED).alias("supported"), "content")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def pages(docs: DataFrame, key: str, text: str = "text", lines: int = 50) -> DataFrame:
    """(key, page_number, n_lines, text): pages of so many lines; an empty text is one empty page."""
    split = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("all"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / lines).cast("int")), lambda i: F.slice("all", i * lines + 1, lines))
    cut = split.select(key, F.posexplode(starts).alias("pos", "have"))
    return cut.select(key, (F.col("pos") + 1).alias("page_number"), F.size("have").alias("n_lines"), F.array_join("have", "\n").alias("text"))


def headings(text: Column) -> Column:
    """Array of (level, title) of Markdown lines that begin with #."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("#"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, "^#+", "")).alias("title")))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def html_lines(html: Column) -> Column:
    """Text lines of a page without scripts, styles, comments and tags; blank lines go."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<![^>]*>", "")
    bare = F.regexp_replace(bare, r"<[^>]*>", "\n")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def csv_lines(spark: SparkSession, path: str, lines: int = 50) -> DataFrame:
    """(path, page_number, text): rows as 'Row n: c1: v1 | c2: v2', in pages of so many rows."""
    rows = spark.read.option("header", "true").csv(path)
    told = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns))
    kept = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), told.alias("row"))
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("at")))
    line = F.concat(F.lit("Row "), F.col("n").cast("string"), F.lit(": "), F.col("row"))
    per = kept.groupBy("path", (F.floor((F.col("n") - 1) / lines) + 1).cast("int").alias("page_number"))
    return per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, item_index, total_items, content): an element of a list is a document, anything else is one."""
    raw = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))
    listed = F.when(F.ltrim("text").startswith("["), F.expr("from_json(text, 'array<string>')")).otherwise(F.array("text"))
    return raw.select("path", F.size(listed).alias("total_items"), F.posexplode(listed).alias("item_index", "content"))
