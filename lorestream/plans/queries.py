"""The registered queries, each beside the SQL that says the same.

A query takes (spark, sf_dir) and reads the tables it names, whole. SQL is None
where SQL cannot say it; tests hold those against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorestream.functions import text as T
from lorestream.operators import chunking, retrieval, tables
from lorestream.sources import files
from lorestream.streaming.state import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_LEN = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '{T.WORD}'), lambda t: length(t) >= 2 and t not in ({_in(T.STOPWORDS)}))"


_QUALITY = f"""case when length(text) >= 50 then least(1.0, 0.3 * least(length(text) / 5000, 1.0) + 0.2 * least(w / 1000, 1.0)
  + case when m between 4 and 7 then 0.2 when m between 3 and 8 then 0.1 else 0.0 end
  + 0.2 * least({_LEN.format('text', '.!?')} / 50, 1.0)
  + case when {_LEN.format('text', '.,;:!?')} > length(text) * 0.01 then 0.1 else 0.0 end) else 0.0 end"""
_SCORED = f"""select doc_id, text, {_QUALITY} as q from (select *, length(regexp_replace(text, '\\s+', '', 'g')) / w as m
  from (select doc_id, text, len(regexp_extract_all(text, '\\S+')) as w from documents))"""


# Texts


@_query(f"""select doc_id, round(q, 6) as quality, case when length(trim(coalesce(text, ''), ' ')) = 0 then 'empty'
  when length(trim(coalesce(text, ''), ' ')) < 200 then 'too_short' when q < 0.4 then 'low_quality' else 'accepted' end as reason from ({_SCORED})""")
def text_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document and the verdict of the ingest gate."""
    scored = _read(spark, sf_dir, "documents").select("doc_id", "text", T.quality_score(F.col("text")).alias("q"))
    return scored.select("doc_id", F.round("q", 6).alias("quality"), T.gate_reason(F.col("text"), F.col("q")).alias("reason"))


@_query(f"""select case when len(list_filter([{_in(T.ENGLISH)}], lambda e: list_contains(regexp_extract_all(lower(text), '\\S+')[1:200], e))) >= 5
  then 'en' else 'unknown' end as language, lang, count(*) as n from documents group by all""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language found against language given."""
    return _read(spark, sf_dir, "documents").groupBy(T.language(F.col("text")).alias("language"), "lang").agg(F.count("*").alias("n"))


@_query(f"""select doc_id, len(regexp_extract_all(text, '{T.URL}')) as n_urls, len(regexp_extract_all(text, '{T.EMAIL}')) as n_emails,
  md5(regexp_replace(regexp_replace(text, '{T.URL}', ' ', 'g'), '{T.EMAIL}', '[EMAIL]', 'g')) as digest from documents""")
def email_url_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and addresses of each document, and a digest of what stays."""
    text = F.col("text")
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return _read(spark, sf_dir, "documents").select("doc_id", count(T.URL).alias("n_urls"), count(T.EMAIL).alias("n_emails"), F.md5(T.redact_emails(T.redact_urls(text))).alias("digest"))


@_query("""select doc_id, length(t) as n_chars_left, md5(t) as digest from (select doc_id, regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(text, '\t', ' ', 'g'), ' +', ' ', 'g'), '\n{3,}', '\n\n', 'g'), ' *\n *', '\n', 'g'), '^ +| +$', '', 'g') as t from documents)""".replace("\t", "\\t").replace("\n{", "\\n{").replace("'\n\n'", "chr(10) || chr(10)").replace(" *\n *', '\n'", " *\\n *', chr(10)"))
def normalised_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of each document with its white space normalised."""
    t = T.normalise_space(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars_left"), F.md5(t).alias("digest"))


@_query("""select doc_id, len(l) as n_lines, len(k) as n_kept, md5(array_to_string(k, chr(10))) as digest from (select doc_id, l,
  list_filter(l, lambda x, i: i = 1 or trim(x, ' ') <> trim(l[i - 1], ' ')) as k from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document before and after consecutive repeats go."""
    kept = T.drop_repeated_lines(F.col("text"))
    lines = lambda c: F.size(F.split(c, "\n")).cast("long")
    return _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", lines(F.col("text")).alias("n_lines"), lines(kept).alias("n_kept"), F.md5(kept).alias("digest"))


@_query("""select doc_id, array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w: length(w) between 2 and 45), ' ') as kept from documents where text is not null""")
def word_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as words of 2 to 45 characters."""
    return _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.filter_words(F.col("text")).alias("kept"))


@_query("""select doc_id, 'doc_' || substr(sha1(source), 1, 16) as document_id, 'chunk_' || substr(md5(source || '_1_' || doc_id), 1, 8) || '_' || doc_id as chunk_id,
  round(cast('0x' || substr(sha256(source), 1, 8) as bigint) / 4294967295 * 100, 6) as bucket from documents where source is not null""")
def chunk_hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and rollout bucket that derive from names."""
    s = F.col("source")
    return _read(spark, sf_dir, "documents").where(s.isNotNull()).select("doc_id", T.document_id(s).alias("document_id"), T.chunk_id(s, F.lit(1), F.col("doc_id")).alias("chunk_id"), F.round(T.stable_bucket(s), 6).alias("bucket"))


@_query("""select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') as name,
  md5(regexp_replace(trim(regexp_replace(lower(url), '\\s+', ' ', 'g'), ' '), '[?!.,;:]+$', '')) as cache_key from pages""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of addresses and the cache key each would have as a query."""
    return _read(spark, sf_dir, "pages").select("page_id", T.source_name(F.col("url")).alias("name"), T.cache_key(F.col("url")).alias("cache_key"))


@_query("""with cut as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s, ' ') <> '') as s from conversations where text is not null)
select conv_id, turn, len(s) as n_sentences, case when len(s) = 0 then 0.0 else round(len(list_filter(s, lambda x: regexp_matches(x, '\\[[0-9]+\\]'))) / len(s), 3) end as coverage from cut""")
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each turn and the share that cite."""
    n = F.size(F.filter(F.split("text", "[.!?]+"), lambda s: F.trim(s) != "")).cast("long")
    return _read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", n.alias("n_sentences"), T.citation_coverage(F.col("text")).alias("coverage"))


_BARE = """regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<![^>]*>', '', 'gis'), '<[^>]*>', chr(10), 'g')"""
_PLAIN = f"""replace(replace(replace(replace(replace({_BARE}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')"""


@_query(f"""select page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is') as title, len(l) as n_lines, (len(l) + 49) // 50 as n_pages, md5(array_to_string(l, chr(10))) as digest
  from (select page_id, html, list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as l from pages where html is not null)""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, text lines and pages of fifty of each web page."""
    lines = files.html_lines(F.col("html"))
    n = F.size(lines).cast("long")
    return _read(spark, sf_dir, "pages").where("html is not null").select(
        "page_id", files.html_title(F.col("html")).alias("title"), n.alias("n_lines"), F.expr("(n_lines + 49) div 50").alias("n_pages"), F.md5(F.array_join(lines, "\n")).alias("digest")
    )


@_query("""select doc_id, cast(floor((pos - 1) / 50) + 1 as integer) as page_number, count(*) as n_lines, md5(string_agg(line, chr(10) order by pos)) as digest
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents) group by all""")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pages of fifty lines."""
    out = files.pages(_read(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", "page_number", F.col("n_lines").cast("long").alias("n_lines"), F.md5("text").alias("digest"))


@_query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 800 characters that overlap by 200."""
    return chunking.chunk(_read(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "total_chunks", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@_query("""select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by text having count(*) > 1""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts held more than once, by digest, with the first document of each."""
    docs = _read(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("key")


@_query("""select doc_id, source, text from documents where text is not null qualify row_number() over (partition by text order by doc_id) = 1""")
def first_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    docs = _read(spark, sf_dir, "documents").where("text is not null")
    first = docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("source", "text"), "doc_id").alias("row"))
    return first.select("doc_id", "row.source", "row.text")


# Structured answers


@_query("""select source, sum(m) as mentions, count(*) as files from (select source, len(regexp_extract_all(lower(text), '\\bthe\\b')) as m from documents) where m > 0 group by source""")
def mention_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and in how many documents, each source says a word."""
    found = tables.both_counts(_read(spark, sf_dir, "documents"), ["the"], ["doc_id", "source"])
    return found.groupBy("source").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("files"))


@_query("""select doc_id, least(a, b) as mentions from (select doc_id, len(regexp_extract_all(lower(text), '\\bthe\\b')) as a,
  len(regexp_extract_all(lower(text), '\\band\\b')) as b from documents) where a > 0 and b > 0""")
def entity_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name both of two entities, with the lesser count."""
    return tables.both_counts(_read(spark, sf_dir, "documents"), ["the", "and"], ["doc_id"]).withColumn("mentions", F.col("mentions").cast("long"))


@_query("""select doc_id, m as mentions, row_number() over (order by m desc, doc_id) as place from (select doc_id, len(regexp_extract_all(lower(text), '\\bthe\\b')) as m from documents)
  where m > 0 qualify place <= 100""")
def file_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred documents that name an entity most."""
    found = tables.both_counts(_read(spark, sf_dir, "documents"), ["the"], ["doc_id"]).orderBy(F.desc("mentions"), "doc_id").limit(100)
    return found.select("doc_id", F.col("mentions").cast("long").alias("mentions"), F.row_number().over(Window.orderBy(F.desc("mentions"), "doc_id")).cast("long").alias("place"))


@_query("""select doc_id, place, substr(text, greatest(1, place - 150), 300) as snippet from (select doc_id, text, instr(lower(text), 'license') as place from documents) where place > 0""")
def keyword_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of a keyword in each document that holds it."""
    return tables.snippets(_read(spark, sf_dir, "documents"), "license").withColumn("place", F.col("place").cast("long"))


@_query("""select source, count(*) as hits, array_to_string(list_sort(list(distinct cast(doc_id % 7 as integer))), ',') as pages, arg_min(substr(text, 1, 300), doc_id) as snippet,
  row_number() over (order by count(*) desc, source) as citation from documents where text ilike '%license%' group by source""")
def structured_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that hold a word, as numbered citations with pages and first snippet."""
    docs = _read(spark, sf_dir, "documents").where(F.lower("text").contains("license"))
    found = docs.select("source", (F.col("doc_id") % 7).cast("int").alias("page"), "text", F.col("doc_id").alias("pos"))
    return tables.structured_citations(found).withColumn("pages", F.array_join("pages", ",")).withColumn("citation", F.col("citation").cast("long"))


# Retrieval


_STATS = f"""bag as (select doc_id, {_tokens('text')} as b from documents), tot as (select count(*) as n, avg(len(b)) as mean from bag),
post as (select doc_id, len(b) as dl, unnest(b) as token from bag), tf as (select token, doc_id, dl, count(*) as tf from post group by all),
df as (select token, count(*) as df from tf group by token)"""


@_query(f"with {_STATS} select token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from df, tot")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and weight of every index term."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.term_stats(retrieval.postings(docs), docs.agg(F.count("*").alias("n"))).withColumn("idf", F.round("idf", 6))


_BM25 = f"""{_STATS}, asked as (select item_id as query_id, token, count(*) as qtf from (select item_id, unnest({_tokens('text')}) as token from benchmark) group by all),
bm as (select query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score from asked join tf using (token) join df using (token), tot group by all),
best as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from bm qualify rank <= 20)"""


def _benchmark(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The k best documents of each passage, ranked once; where they are few they go to the tables they are joined to, whose texts stay where they are."""
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    best = written(retrieval.bm25(queries, _read(spark, sf_dir, "documents").select("doc_id", "text"), k=k, digits=6), "best")
    return retrieval.near(best)(best)


@_query(f"with {_BM25} select query_id, doc_id, round(score, 6) as score, rank, round(1 / (1 + exp(-round(score, 6))), 6) as scaled from best")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage the twenty documents of highest BM25."""
    return _benchmark(spark, sf_dir).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"), F.round(retrieval.sigmoid(F.col("score")), 6).alias("scaled"))


_DENSE = """near as (select q.vec_id as query_id, e.vec_id as doc_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score
  from embeddings q, embeddings e where q.vec_id % 100 = 0), top as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from near qualify rank <= 10)"""


@_query(f"with {_DENSE} select query_id, doc_id, score, rank from top where score >= 0.1")
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hundredth vector the ten nearest by cosine, 0.1 at least."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.dense(queries, rows, k=10, digits=6).where("score >= 0.1").withColumn("rank", F.col("rank").cast("long"))


_LISTS = f"""{_BM25}, met as (select query_id, doc_id, count(*) as m from asked join tf using (token) group by all), terms as (select query_id, count(*) as t from asked group by query_id),
sparse as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from bm qualify rank <= 50),
cover as (select query_id, doc_id, round(m / t, 6) as score, row_number() over (partition by query_id order by round(m / t, 6) desc, doc_id) as rank from met join terms using (query_id) qualify rank <= 50),
lists as (select query_id, 'sparse' as retriever, doc_id, round(score, 6) as score, rank from sparse union all select query_id, 'cover', doc_id, score, rank from cover)"""
_FUSED = "fused as (select query_id, doc_id, {0} as raw, count(*) as n_lists from lists group by all), scaled as (select query_id, doc_id, n_lists, round(case when max(raw) over w > min(raw) over w then (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) else raw end, 9) as score from fused window w as (partition by query_id)), placed as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scaled qualify rank <= 20)"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two retrievers over all documents, fifty each: by BM25, and by the share of a query's terms that a document has."""
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scores = written(retrieval.bm25_scores(queries, _read(spark, sf_dir, "documents").select("doc_id", "text"), digits=6), "scores")
    terms = queries.select("query_id", F.size(F.array_distinct(T.tokens(F.col("query")))).alias("terms"))
    cover = scores.join(terms, "query_id").select("query_id", "doc_id", F.round(F.col("n_terms") / F.col("terms"), 6).alias("score"))
    lists = [retrieval.top_k(x, 50).withColumn("retriever", F.lit(name)) for name, x in (("sparse", scores.drop("n_terms")), ("cover", cover))]
    return lists[0].unionByName(lists[1])


@_query(f"with {_LISTS}, {_FUSED.format('sum(1 / (60 + rank))')} select query_id, doc_id, n_lists, round(score, 6) as score, rank from placed")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists fused by reciprocal rank."""
    out = retrieval.rrf(_lists(spark, sf_dir))
    return out.select("query_id", "doc_id", "n_lists", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@_query(f"with {_LISTS}, {_FUSED.format(chr(115) + 'um(case when retriever = ' + repr('sparse') + ' then 0.7 * score else 0.3 * score end)')} select query_id, doc_id, round(score, 6) as score, rank from placed")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists fused by weighted scores."""
    out = retrieval.weighted(_lists(spark, sf_dir), {"sparse": 0.7, "cover": 0.3})
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@_query(f"""with {_LISTS}, per as (select query_id, doc_id, count(distinct retriever) as n, count(*) as hits from lists group by all)
select query_id, sum(hits) as total, count(*) as unique_docs, count(*) filter (n > 1) as overlap, round(count(*) filter (n > 1) / count(*), 6) as jaccard from per group by query_id""")
def fusion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two lists agree."""
    return retrieval.fusion_stats(_lists(spark, sf_dir))


_PLACE = "case when n <= 2 then rank - 1 when rank = 2 then n - 1 when rank % 2 = 1 then (rank - 1) // 2 else n - 1 - (rank - 2) // 2 end"


@_query(f"with {_BM25} select query_id, doc_id, cast({_PLACE} as integer) as place from (select *, count(*) over (partition by query_id) as n from best)")
def lost_in_middle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents at both ends of the context."""
    return retrieval.lost_in_middle(_benchmark(spark, sf_dir)).select("query_id", "doc_id", "place")


@_query(f"""with {_BM25}, p as (select query_id, doc_id, rank, round(score, 6) as score, -least(0.12::double, 0.035::double * (row_number() over (partition by query_id, source order by round(score, 6) desc, rank) - 1)) as penalty
  from best join documents using (doc_id)) select query_id, doc_id, round(penalty, 6) as penalty, row_number() over (partition by query_id order by round(score + penalty, 9) desc, rank) as new_rank from p""")
def group_crowding_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks after later documents of one source lose a little."""
    ranked = _benchmark(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = retrieval.crowding_penalty(ranked, "source")
    return out.select("query_id", "doc_id", F.round("penalty", 6).alias("penalty"), F.col("new_rank").cast("long").alias("new_rank"))


@_query()
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each hundredth vector's fifty nearest, those unlike all before them."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    near = retrieval.dense(queries, rows, k=50).select("query_id", "doc_id", "rank").join(rows, "doc_id").select("query_id", "rank", "doc_id", "vector")
    return retrieval.greedy_dedup(near).select("query_id", "doc_id", "rank")


@_query(f"""with {_BM25} select query_id, doc_id, row_number() over (partition by query_id order by rank, doc_id) as citation,
  case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as preview from best join documents using (doc_id) where rank <= 5""")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered citations of each query's five best."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return retrieval.numbered(_benchmark(spark, sf_dir, 5).join(docs, "doc_id")).select("query_id", "doc_id", F.col("citation").cast("long").alias("citation"), "preview")


# Sessions


@_query("""select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as nth from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3)""")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation."""
    return tables.recent_turns(_read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.col("nth").cast("long").alias("nth"))


@_query("""select conv_id, count(*) as turns, count(*) filter (role = 'user') as asked, max(turn) - min(turn) as span, round(avg(length(text)), 6) as mean_chars from conversations group by conv_id""")
def turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each conversation."""
    return _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), (F.max("turn") - F.min("turn")).alias("span"), F.round(F.avg(F.length("text")), 6).alias("mean_chars")
    )


_BAG = f"list_distinct({_tokens('text')})"


@_query(f"""with t as (select conv_id, turn, role, {_BAG} as b from conversations), q as (select t.* from t where role = 'user' and len(b) > 0)
select conv_id, asked_turn, turn, score, row_number() over (partition by conv_id, asked_turn order by score desc, turn desc) as rank from (select t.conv_id, q.turn as asked_turn, t.turn,
  round(len(list_filter(q.b, lambda x: list_contains(t.b, x))) / len(q.b), 6) as score from t join q on t.conv_id = q.conv_id and t.turn < q.turn) where score > 0 qualify rank <= 3""")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the three earlier turns that share most of its words."""
    turns = _read(spark, sf_dir, "conversations")
    return tables.history_search(turns, turns.where("role = 'user'")).withColumn("rank", F.col("rank").cast("long"))


@_query("""select conv_id, arg_min(text, turn) as first_question, arg_max(text, turn) as last_question, count(*) as questions from conversations where role = 'user' group by conv_id""")
def meta_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last question of each conversation."""
    asked = _read(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_question"), F.max_by("text", "turn").alias("last_question"), F.count("*").alias("questions"))


@_query(f"""select v as verdict, role, count(*) as n from (select role, case when length(q) = 0 then 'empty' when length(q) > 4000 then 'too_long'
  when regexp_matches(q, '(?i)<script|javascript:|eval\\(|exec\\(') then 'unsafe' when not regexp_matches(q, '[\\p{{L}}\\p{{N}}_]') then 'symbols'
  when length(q) < 3 or c = 0 or w <= 3 and c <= 1 then 'generic' else 'ok' end as v from (select role, q, len(regexp_extract_all(q, '\\S+')) as w,
  len(list_filter(regexp_extract_all(lower(q), '\\S+'), lambda x: length(x) > 2 and x not in ({_in(T.STOPWORDS)}))) as c from (select role, trim(coalesce(text, ''), ' ') as q from conversations))) group by all""")
def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on turns as queries."""
    return _read(spark, sf_dir, "conversations").groupBy(tables.query_verdict(F.col("text")).alias("verdict"), "role").agg(F.count("*").alias("n"))


@_query()
def follow_up_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of questions."""
    return _read(spark, sf_dir, "conversations").where("role = 'user'").groupBy(tables.follow_up_class(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


# Operations


@_query("""select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 3) as p50, round(quantile_cont(value, 0.95), 3) as p95, max(value) as largest from events group by event_type""")
def latency_percentiles_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and percentiles by event type."""
    return tables.latency_by(_read(spark, sf_dir, "events"), "event_type", "value")


@_query("""select event_type, value as percentile from (select event_type, value, row_number() over (partition by event_type order by value) as nth, count(*) over (partition by event_type) as n from events where value is not null)
  where nth = round_even((n - 1) * 0.95, 0) + 1""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile by nearest rank."""
    return tables.nearest_rank(_read(spark, sf_dir, "events"), "event_type", "value", 0.95)


@_query("""with r as (select user_id, event_type = 'error' as bad, row_number() over (partition by user_id order by ts desc, event_id desc) <= 50 as new from events),
a as (select user_id, avg(bad::int) filter (new) as rate, avg(bad::int) filter (not new) as before, count(*) filter (not new) as n_before from r group by user_id),
t as (select *, round(case when n_before >= 20 then greatest(0.3, 2 * before + 0.05) else 0.3 end, 6) as threshold from a)
select user_id, round(rate, 6) as rate, round(before, 6) as before, n_before, threshold, rate > threshold as alert from t""")
def distribution_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose recent error rate is out of line with their past."""
    return tables.alerts(_read(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", 0.3)


@_query("""select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) > 3 as over_limit from events""")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are over three an hour for their user."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return _read(spark, sf_dir, "events").select("event_id", "user_id", (F.count("*").over(w) > 3).alias("over_limit"))


@_query("""with g as (select *, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g) select user_id, session, min(ts) as started, max(ts) as ended, count(*) as n from s group by user_id, session""")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in runs without a pause of half an hour."""
    return tables.sessions(_read(spark, sf_dir, "events"), "user_id", 1800)


@_query("""select event_type, count(*) as n, round(avg(value), 6) as mean from (select * from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 1000) group by event_type""")
def rolling_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over the newest thousand events of each type."""
    return tables.newest(_read(spark, sf_dir, "events"), 1000, "event_type", "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# Table maintenance and plain relational queries


_SNAP = "select o_orderkey, {0} as digest from orders where o_orderkey % {1} <> 0"


@_query(f"""select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.digest is null then 'new' when a.digest is null then 'deleted' when a.digest <> b.digest then 'modified' else 'unchanged' end as change
  from ({_SNAP.format("md5(o_orderstatus || case when o_orderkey % 5 = 0 then 'x' else '' end)", 11)}) a full join ({_SNAP.format("md5(o_orderstatus)", 7)}) b on a.o_orderkey = b.o_orderkey""")
def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of orders told apart: new, modified, deleted, unchanged."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    mark = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("")
    listing = orders.where("o_orderkey % 11 <> 0").select("o_orderkey", F.md5(F.concat("o_orderstatus", mark)).alias("digest"))
    tracker = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.md5("o_orderstatus").alias("digest"))
    return tables.classify_changes(listing, tracker, "o_orderkey", "digest")


@_query("""select o_orderkey, o_orderstatus from orders where o_orderkey % 3 <> 0 union all select o_orderkey, 'N' from orders where o_orderkey % 3 = 0""")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after rows of some keys were replaced."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return tables.upsert(orders, orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("N")), "o_orderkey")


@_query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, round(avg(l_discount), 6) as discount, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
  from lineitem where l_shipdate <= timestamp '2002-01-01' group by all""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of line items by flag and status."""
    rows = _read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '2002-01-01'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
    )


@_query("""select n_name, c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by rollup (n_name, c_mktsegment)""")
def orders_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation and segment with subtotals."""
    joined = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)""")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a large order: an anti join."""
    orders = _read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _read(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


# Index tokens, names and noise


_NOISE = " ".join(f"when regexp_matches(b, '{p}') then '{k}'" for k, p in T.NOISE_LINES.items())


@_query(f"""select kind, count(*) as n from (select case {_NOISE} end as kind from (select regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') as b from documents))
  where kind is not null group by kind""")
def noise_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise lines of all documents by kind."""
    lines = _read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(T.noise_kind(F.col("line")).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@_query("""select doc_id, md5(regexp_replace(text, '[^\\p{L}\\p{N}_\\s.,;:!?''\"()\\[\\]%$&@/+-]', '', 'g')) as digest from documents""")
def basic_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document without special characters."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.keep_basic(F.col("text"))).alias("digest"))


@_query("""select c_custkey, levenshtein(lower(c_name), lower(n_name)) as distance, round(1 - levenshtein(lower(c_name), lower(n_name)) / greatest(length(c_name), length(n_name)), 6) as similarity
  from customer join nation on c_nationkey = n_nationkey""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance and similarity of each customer's name and its nation's."""
    a, b = F.lower("c_name"), F.lower("n_name")
    both = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", F.levenshtein(a, b).cast("long").alias("distance"), F.round(T.similarity(a, b), 6).alias("similarity"))


@_query("""with t as (select p_partkey, p_name, regexp_extract_all(lower(p_name), '[a-z0-9]+') as c, regexp_extract_all(lower(p_brand), '[a-z0-9]+') as q, lower(p_name) as l from part)
select p_partkey, q = c or len(q) >= 2 and len(list_filter(q, lambda x: not list_contains(c, x))) = 0 or len(c) >= 2 and len(list_filter(c, lambda x: not list_contains(q, x))) = 0
  or len(q) = 1 and list_contains(c, q[1]) as same, len(list_distinct(c)) as n_tokens from t""")
def entity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part's brand names the part."""
    rows = _read(spark, sf_dir, "part")
    return rows.select("p_partkey", T.same_entity(F.col("p_brand"), F.col("p_name")).alias("same"), F.size(F.array_distinct(T.name_tokens(F.col("p_name")))).cast("long").alias("n_tokens"))


@_query("""select a.vec_id, b.vec_id as other_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the next."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", "other_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


# Search by filters and prefixes


@_query("""select doc_id, source from documents where source in ('src0', 'src1') and lang = 'en'""")
def equality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language and any of two sources."""
    docs = _read(spark, sf_dir, "documents")
    return docs.where((F.col("lang") == "en") & tables.matches_any(F.array("source"), ["src0", "src1"])).select("doc_id", "source")


@_query("""select doc_id from documents where lower(text) like '%license of%' or lower(text) like '%license%'""")
def keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a query or one of its longer words."""
    return _read(spark, sf_dir, "documents").where(tables.keyword_match("License of", F.col("text"))).select("doc_id")


@_query(f"""with b as (select doc_id, {_tokens('text')} as b from documents), c as (select doc_id, len(list_filter(b, lambda t: starts_with(t, 'comp'))) as x, len(list_filter(b, lambda t: starts_with(t, 'th'))) as y from b),
f as (select doc_id, x + y as hits, x > 0 and y > 0 as whole from c where x + y > 0), r as (select doc_id, hits, row_number() over (order by hits desc, doc_id) as rank from f where whole or not (select bool_or(whole) from f) qualify rank <= 50)
select doc_id, hits, rank, round(1 - (rank - 1) / greatest(max(rank) over () - 1, 1e-9), 6) as scaled from r""")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents with most tokens that begin with the terms."""
    return tables.prefix_search(_read(spark, sf_dir, "documents"), ["comp", "th"])


@_query(f"""with {_BM25}, e as (select item_id as query_id, min(doc_id) as doc_id from documents, benchmark where contains(documents.text, benchmark.text) group by item_id)
select q.query_id, min(b.rank) as first_rank, coalesce(round(1 / min(b.rank), 6), 0) as reciprocal from (select distinct query_id from best) q left join (select best.* from best join e using (query_id, doc_id)) b on q.query_id = b.query_id group by q.query_id""")
def first_expected_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage the rank of the first document that holds it."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scores = written(retrieval.bm25_scores(items.withColumnRenamed("passage", "query"), docs, digits=6), "scores")
    best = retrieval.top_k(scores, 20)
    held = retrieval.holders(items, docs, scores)
    return tables.first_expected(best, held, "query_id", "doc_id").withColumn("first_rank", F.col("first_rank").cast("long"))


# Upkeep of tables


@_query("""select o_orderstatus, count(*) as n from orders where not (o_totalprice < 50000) group by o_orderstatus""")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders left by status after cheap ones were deleted."""
    return tables.kept_after_delete(_read(spark, sf_dir, "orders"), F.col("o_totalprice") < 50000).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@_query("""with k as (select o_custkey, max(o_orderstatus) as s from orders where o_custkey % 2 = 0 group by o_custkey)
select o_orderkey from orders left join k using (o_custkey) where k.s is null or o_orderstatus = k.s""")
def keep_one_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, of even customers only those of the last status."""
    orders = _read(spark, sf_dir, "orders")
    keep = orders.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("o_orderstatus"))
    return tables.keep_one_job(orders, "o_custkey", "o_orderstatus", keep).select("o_orderkey")


@_query("""select o_orderkey, case when o_totalprice > 400000 then 'large' else o_orderpriority end as o_orderpriority, case when o_orderstatus = 'staging' then 'x' end as state from orders""")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority is set where the total is large."""
    rows = tables.update_where(_read(spark, sf_dir, "orders"), F.col("o_totalprice") > 400000, {"o_orderpriority": F.lit("large")})
    return tables.update_where(rows, F.col("o_orderstatus") == "staging", {"state": F.lit("x")}).select("o_orderkey", "o_orderpriority", "state")


@_query("""select state, count(*) as n from (select case when o_orderstatus = 'F' then 'ready' when o_orderkey % 3 = 0 then 'ready' else 'staging' end as state from orders) group by state""")
def commit_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by state after the staged ones of some keys were committed."""
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "F", "ready").otherwise("staging").alias("state"))
    staged = rows.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus")
    return tables.commit_job(rows, "o_orderkey", "o_orderstatus", staged).groupBy("state").agg(F.count("*").alias("n"))


@_query("""select coalesce(source, 'unknown') as source, count(*) as n, count(*) filter (text is null) as missing, sum(n_chars) as chars from documents group by 1""")
def backfilled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, missing texts and characters by source, absent sources filled in."""
    docs = _read(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("unknown")))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("missing"), F.sum("n_chars").alias("chars"))


@_query("""select p_brand, min(p_name) as p_name from part group by p_brand""")
def one_path_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name of each brand."""
    return tables.one_path_per_file(_read(spark, sf_dir, "part"), "p_brand", "p_name")


@_query("""select user_id, max(ts) as ts from events group by user_id order by max(ts) desc, user_id limit 20""")
def lru_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users a cache of twenty entries would hold."""
    return tables.newest_accessed(_read(spark, sf_dir, "events"), "user_id", "ts", 20)


@_query("""select conv_id, turn, turn_id from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as turn_id, count(*) over (partition by conv_id) as n from conversations) where turn_id > n - 5""")
def retained_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five turns of each conversation with ids that never repeat."""
    return tables.retained_turns(_read(spark, sf_dir, "conversations"), 5).select("conv_id", "turn", F.col("turn_id").cast("long").alias("turn_id"))


@_query("""with a as (select event_type, avg(value) as v from events where ts >= timestamp '2024-01-15' group by event_type), b as (select event_type, avg(value) as v from events where ts < timestamp '2024-01-15' and event_type <> 'error' group by event_type)
select coalesce(a.event_type, b.event_type) as event_type, round(a.v, 6) as now, round(b.v, 6) as before, round(round(a.v, 6) - round(b.v, 6), 6) as delta from a full join b on a.event_type = b.event_type""")
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by event type in two halves of the month, and how it moved."""
    events, mid = _read(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    mean = lambda rows: rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return tables.metric_deltas(mean(events.where(F.col("ts") >= mid)), mean(events.where((F.col("ts") < mid) & (F.col("event_type") != "error"))), "event_type", "v")


@_query("""select case when length(text) < 200 then 'low' when length(text) < 2000 then 'middle' else 'high' end as band, lang, count(*) as n from documents where text is not null group by all""")
def routing_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by band and language."""
    n = F.length("text")
    band = F.when(n < 200, "low").when(n < 2000, "middle").otherwise("high")
    return _read(spark, sf_dir, "documents").where("text is not null").groupBy(band.alias("band"), "lang").agg(F.count("*").alias("n"))
