"""Text functions over documents and turns with fragments, by number, that make every branch of a rule speak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.functions import text as T
from lorestream.operators import retrieval, tables
from lorestream.plans.queries import _in, _query, _read


def _pick(key: str, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _picked(key: str, values: list[str]) -> str:
    quote = lambda v: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {quote(v)}" for i, v in enumerate(values)) + " end"


LINES = ["Page 3\n", "x\n© 2020 All\n", "y\nhttp://a.b/c\n", "z\nPublished: 1/2/2020\n", "Memo DRAFT\nMemo  DRAFT\n", "all rights reserved here\n- 12 -\n", "a\tb   c\n\n\n\nd\nd\n d\n", ""]
_BARE = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
_KIND = " ".join(f"when regexp_matches({_BARE}, '{p}') then '{k}'" for k, p in T.NOISE_LINES.items())
_NOISY = f"(select doc_id, {_picked('doc_id', LINES)} || coalesce(text, '') || case when doc_id % 3 = 0 then chr(10) || 'Page 9' when doc_id % 3 = 1 then chr(10) || 'end CONFIDENTIAL' else '' end as text from documents)"
_STRIPPED = f"""k as (select doc_id, list_filter(l, lambda x, i: i = 1 or i = len(l) or case {_KIND} end is null) as k from (select doc_id, string_split(text, chr(10)) as l from n)),
s as (select doc_id, array_to_string(list_transform(k, lambda x, i: case when i < len(k) then regexp_replace(x, '{T.WATERMARK}', '') else x end), chr(10)) as text from k)"""
_SPACED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, chr(9), ' ', 'g'), ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' *\\n *', chr(10), 'g'), '^ +| +$', '', 'g')"


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    end = F.when(i % 3 == 0, "\nPage 9").when(i % 3 == 1, "\nend CONFIDENTIAL").otherwise("")
    return _read(spark, sf_dir, "documents").select("doc_id", F.concat(_pick("doc_id", LINES), F.coalesce("text", F.lit("")), end).alias("text"))


@_query(f"select case {_KIND} end as kind, count(*) as n from (select unnest(string_split(text, chr(10))) as x from {_NOISY}) group by 1")
def noise_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by kind of noise, null for none."""
    lines = _noisy(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(T.noise_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@_query(f"""with n as {_NOISY}, {_STRIPPED}, u as (select doc_id, regexp_replace(regexp_replace(text, '{T.URL}', ' ', 'g'), '{T.EMAIL}', '[EMAIL]', 'g') as text from s),
w as (select doc_id, array_to_string(list_filter(regexp_extract_all({_SPACED.format('text')}, '\\S+'), lambda w: length(w) between 2 and 45), ' ') as text from u), c as (select doc_id, string_split({_SPACED.format('text')}, chr(10)) as l from s)
select doc_id, md5(w.text) as cleaned, md5(array_to_string(list_filter(l, lambda x, i: i = 1 or trim(x, ' ') <> trim(l[i - 1], ' ')), chr(10))) as lines, md5(s.text) as stripped from w join c using (doc_id) join s using (doc_id)""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document cleaned whole, cleaned with its lines, and without noise only."""
    text = F.col("stripped")
    stripped = _noisy(spark, sf_dir).select("doc_id", T.strip_noise(F.col("text")).alias("stripped"))  # noise goes once, all three start from it
    return stripped.select("doc_id", F.md5(T.clean_stripped(text, urls=True, emails=True)).alias("cleaned"), F.md5(T.clean_stripped_lines(text)).alias("lines"), F.md5(text).alias("stripped"))


CODES = ["See § 501(c)(3) and the IRS, ", "Rule 42(a) on pre-trial boxes 7: ", "US companies' statuses ", "I a 5 THE ", ""]
_FOUND = f"regexp_extract_all({_picked('doc_id', CODES)} || text, '{'|'.join((T.SECTION_SIGN, T.CODE, T.COMPOUND))}')"
_CAPS = "regexp_matches({0}, '^[A-Z]{{2,}}$')"
_STEM = """case when length(t) < 5 then t when ends_with(t, 'ies') and length(t) > 5 then regexp_replace(t, 'ies$', 'y') when ends_with(t, 'es') then regexp_replace(t, '((?:[sxz]|ch|sh))es$', '\\1')
  when ends_with(t, 's') and not regexp_matches(t, '(?:[su]|i)s$') then regexp_replace(t, 's$', '') else t end"""


@_query(f"""with f as (select unnest({_FOUND}) as t from documents), k as (select case when {_CAPS.format('t')} then t else lower(t) end as t, {_CAPS.format('t')} as caps from f where (length(t) >= 2 or regexp_matches(t, '^[0-9]$')) and ({_CAPS.format('t')} or lower(t) not in ({_in(T.STOPWORDS)})))
select token, count(*) as n from (select case when caps then t else {_STEM} end as token from k) group by token""")
def legal_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index terms with section signs, codes and words in capitals, plurals taken off, and how often each occurs."""
    docs = _read(spark, sf_dir, "documents").select(F.concat(_pick("doc_id", CODES), F.col("text")).alias("text"))
    return docs.select(F.explode(T.legal_tokens(F.col("text"), stemmed=True)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_SLUG = """case when regexp_extract(title, '(?i)(?:section|article|chapter|part)\\s+([0-9]+(?:\\.[0-9]+)*)', 1) <> '' then regexp_extract(title, '(?i)(?:section|article|chapter|part)\\s+([0-9]+(?:\\.[0-9]+)*)', 1)
  else substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) end"""
TITLES = ["Section 4.2 ", "What? ", "(chapter  12) ", "--- "]


@_query(f"select doc_id, {_SLUG} as slug from (select doc_id, {_picked('doc_id', TITLES)} || substr(text, 1, 100) as title from documents where text is not null)")
def section_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section ids of titles: a number where there is one, else a slug."""
    titled = _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(_pick("doc_id", TITLES), F.substring("text", 1, 100)).alias("title"))
    return titled.select("doc_id", T.section_slug(F.col("title")).alias("slug"))


@_query("""with n as (select p_partkey, case p_partkey % 4 when 0 then ' "' || p_name || '." ' when 1 then replace(p_name, ' ', '   ') when 2 then 'A.B. ' || p_name else p_name end as raw from part), e as (select p_partkey, regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' '), '^[.,;:!?''"()-]+|[.,;:!?''"()-]+$', '', 'g') as name from n)
select p_partkey, name, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') as variants from (select *, [name, lower(name), upper(name), array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), replace(name, '.', ''), name || '''s'] as v from e)""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names freed of spaces and marks, and the forms a filter tries."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 4 == 0, F.concat(F.lit(' "'), name, F.lit('." '))).when(k % 4 == 1, F.replace(name, F.lit(" "), F.lit("   "))).when(k % 4 == 2, F.concat(F.lit("A.B. "), name)).otherwise(name)
    rows = _read(spark, sf_dir, "part").select("p_partkey", T.entity_name(raw).alias("name"))
    return rows.withColumn("variants", F.array_join(T.name_variants(F.col("name")), "|"))


_PAIR = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@_query(f"""with p as (select p_partkey, p_name, case p_partkey % 5 when 0 then upper(p_name) || '!' when 1 then string_split(p_name, ' ')[1] when 2 then 'the ' || p_name when 3 then 'no such' else 'small cold' end as asked from part),
t as (select p_partkey, p_partkey % 5 as form, {_PAIR.format('asked')} as q, {_PAIR.format('p_name')} as c from p)
select form, q = c or len(q) >= 2 and len(list_filter(q, lambda x: not list_contains(c, x))) = 0 or len(c) >= 2 and len(list_filter(c, lambda x: not list_contains(q, x))) = 0 or len(q) = 1 and list_contains(c, q[1]) as same, count(*) as n from t group by all""")
def entity_match_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of a name that match it and those that do not."""
    k, name = F.col("p_partkey"), F.col("p_name")
    asked = F.when(k % 5 == 0, F.concat(F.upper(name), F.lit("!"))).when(k % 5 == 1, F.split(name, " ")[0]).when(k % 5 == 2, F.concat(F.lit("the "), name)).when(k % 5 == 3, "no such").otherwise("small cold")
    return _read(spark, sf_dir, "part").groupBy((k % 5).alias("form"), T.same_entity(asked, name).alias("same")).agg(F.count("*").alias("n"))


_CITING = "text || case turn % 4 when 0 then ' So it is [1]. And [3][1] too! No.' when 1 then ' See [2]' when 2 then ' [12].' else '' end"


@_query(f"""with t as (select conv_id, turn, {_CITING} as text from conversations), c as (select conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[([0-9]{{1,6}})\\]', 1), lambda x: x::int))) as n, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s, ' ') <> '') as s from t)
select conv_id, turn, array_to_string(n, ',') as cited, case when len(s) = 0 then 0.0 else round(len(list_filter(s, lambda x: regexp_matches(x, '\\[[0-9]+\\]'))) / len(s), 3) end as coverage from c""")
def cited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that turns cite, and the share of their sentences that do."""
    t = F.col("turn")
    more = F.when(t % 4 == 0, " So it is [1]. And [3][1] too! No.").when(t % 4 == 1, " See [2]").when(t % 4 == 2, " [12].").otherwise("")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", more).alias("text"))
    return turns.select("conv_id", "turn", F.array_join(F.transform(T.citations(F.col("text")), lambda x: x.cast("string")), ",").alias("cited"), T.citation_coverage(F.col("text")).alias("coverage"))


@_query(f"""with a as (select conv_id * 100 + turn as answer_id, conv_id, unnest(list_distinct(list_transform(regexp_extract_all({_CITING}, '\\[([0-9]{{1,6}})\\]', 1), lambda x: x::int))) as n from conversations),
s as (select conv_id, row_number() over (partition by conv_id order by turn) as nth, role || turn as source from conversations) select answer_id, cast(n as integer) as n, source from a join s on a.conv_id = s.conv_id and a.n = s.nth""")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of turns joined to the turn of that number; numbers without one are invalid."""
    t = F.col("turn")
    more = F.when(t % 4 == 0, " So it is [1]. And [3][1] too! No.").when(t % 4 == 1, " See [2]").when(t % 4 == 2, " [12].").otherwise("")
    turns = _read(spark, sf_dir, "conversations")
    answers = turns.select((F.col("conv_id") * 100 + t).alias("answer_id"), "conv_id", F.concat("text", more).alias("text"))
    numbered = tables.retained_turns(turns, 1 << 30).select("conv_id", F.col("turn_id").cast("int").alias("nth"), F.concat("role", t.cast("string")).alias("source"))
    sources = answers.select("answer_id", "conv_id").join(numbered, "conv_id").select("answer_id", "nth", "source")
    return tables.cited_sources(answers, sources).select("answer_id", F.col("n").cast("int").alias("n"), "source")


@_query("""with b as (select case when doc_id % 5 = 0 then null else source end as source, case when doc_id % 4 = 0 then null else text end as text, n_chars from documents) select coalesce(source, 'unknown') as source, count(*) as n, count(*) filter (text is null) as missing, count(*) filter (source is null) as filled from b group by 1""")
def backfilled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources filled in where every fifth is missing, and texts that stay missing."""
    i = F.col("doc_id")
    docs = _read(spark, sf_dir, "documents").select(F.when(i % 5 != 0, F.col("source")).alias("given"), F.when(i % 4 != 0, F.col("text")).alias("text"))
    return docs.groupBy(F.coalesce("given", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("missing"), F.count_if(F.col("given").isNull()).alias("filled"))


@_query("""select state, o_orderpriority, count(*) as n from (select case when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 'ready' when o_orderstatus = 'P' then 'staging' else 'old' end as state, case when o_totalprice > 400000 then 'large' else o_orderpriority end as o_orderpriority from orders) group by all""")
def staged_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and priorities after two conditional updates, of staged rows and of large ones."""
    rows = _read(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "P", "staging").otherwise("old"))
    rows = tables.update_where(rows, (F.col("state") == "staging") & (F.col("o_orderkey") % 2 == 0), {"state": F.lit("ready")})
    rows = tables.update_where(rows, F.col("o_totalprice") > 400000, {"o_orderpriority": F.lit("large")})
    return rows.groupBy("state", "o_orderpriority").agg(F.count("*").alias("n"))


def _legal(column: str) -> str:
    kept = f"(length(t) >= 2 or regexp_matches(t, '^[0-9]$')) and ({_CAPS.format('t')} or lower(t) not in ({_in(T.STOPWORDS)}))"
    return f"list_transform(list_filter(regexp_extract_all({column}, '{'|'.join((T.SECTION_SIGN, T.CODE, T.COMPOUND))}'), lambda t: {kept}), lambda t: case when {_CAPS.format('t')} then t else lower(t) end)"


_TEXT = f"{_picked('doc_id', CODES)} || coalesce(text, '')"
_ASK = f"text || ' ' || {_picked('item_id', ['§ 501(c)(3)', 'IRS', '42(a) pre-trial', '7'])}"


@_query(f"""with bag as (select doc_id, {_legal(_TEXT)} as b from documents), tot as (select count(*) as n, avg(len(b)) as mean from bag), post as (select doc_id, len(b) as dl, unnest(b) as token from bag), tf as (select token, doc_id, dl, count(*) as tf from post group by all),
df as (select token, count(*) as df from tf group by token), asked as (select item_id as query_id, token, count(*) as qtf from (select item_id, unnest({_legal(_ASK)}) as token from benchmark) group by all),
bm as (select query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score from asked join tf using (token) join df using (token), tot group by all)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from bm qualify rank <= 10""")
def legal_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each passage with a code the ten documents of highest BM25 by the tokenizer that keeps codes and capitals."""
    ask = F.concat("text", F.lit(" "), _pick("item_id", ["§ 501(c)(3)", "IRS", "42(a) pre-trial", "7"]))
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), ask.alias("query"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(_pick("doc_id", CODES), F.coalesce("text", F.lit(""))).alias("text"))
    out = retrieval.bm25(queries, docs, k=10, tokenize=T.legal_tokens, digits=6)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
