"""Names of parts, customers and suppliers as entities, misspelt ones as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.operators import entities as E
from lorestream.plans.queries import _query, _read


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with the sizes of their parts summed, and of customers and suppliers, one each."""
    counted = _read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("count"))
    named = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(_read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))
    return E.candidate_totals(counted, named, limit=None)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a letter changed, a sign lost or a word added."""
    part = _read(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("query_id"), F.when(F.col("p_partkey") % 40 == 0, F.translate("p_name", "ei", "ai")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("?"))).alias("raw"))
    customer = _read(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("query_id"), F.when(F.col("c_custkey") % 200 == 0, F.replace("c_name", F.lit("Customer#"), F.lit("Custmer "))).otherwise(F.concat(F.lit("the "), F.col("c_name"))).alias("raw"))
    supplier = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("query_id"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("...")).when(F.col("s_suppkey") % 3 == 1, F.lit("Zyx qwv")).otherwise(F.lower("s_name")).alias("raw"))
    return part.unionByName(customer).unionByName(supplier)


_CLEAN = "regexp_replace(regexp_replace(trim({0}, ' '), '^[\"''`.,;:!?()\\[\\]{{}}]+|[\"''`.,;:!?()\\[\\]{{}}]+$', '', 'g'), '\\s+', ' ', 'g')"
_SOUND = """case when {0} = '' then '' else substr(upper(substr({0}, 1, 1)) || array_to_string(list_filter(list_filter(string_split(translate(upper({0}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), ''),
  lambda x, i: i > 1 and x <> string_split(translate(upper({0}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), '')[i - 1]), lambda x: x <> '0'), '') || '000', 1, 4) end"""
_LETTERS = "regexp_replace(t, '[^a-zA-Z]', '', 'g')"
_SOUNDS = f"list_filter(list_transform(list_filter(tokens, lambda t: length(t) >= 4), lambda t: {_SOUND.format(_LETTERS)}), lambda s: s <> '')"
_TOTALS = f"""totals as (select {_CLEAN.format('name')} as entity, cast(sum(n) as bigint) as count from (select p_name as name, p_size as n from part union all select c_name, 1 from customer union all select s_name, 1 from supplier) group by 1)"""
_ASKED = f"""asked as (select query_id, {_CLEAN.format('raw')} as entity from (
  select 'p' || p_partkey as query_id, case when p_partkey % 40 = 0 then replace(p_name, 'e', 'a') else ' ' || p_name || '?' end as raw from part where p_partkey % 20 = 0
  union all select 'c' || c_custkey, case when c_custkey % 200 = 0 then replace(c_name, 'Customer#', 'Custmer ') else 'the ' || c_name end from customer where c_custkey % 100 = 0
  union all select 's' || s_suppkey, case s_suppkey % 3 when 0 then '...' when 1 then 'Zyx qwv' else lower(s_name) end from supplier))"""
_NAMES = f"""with {_TOTALS}, {_ASKED}, known as (select *, {_SOUNDS} as sounds from (select *, regexp_extract_all(lower(entity), '[a-z0-9]+') as tokens from totals) where len(tokens) > 0),
q as (select *, {_SOUNDS} as sounds from (select *, regexp_extract_all(lower(entity), '[a-z0-9]+') as tokens from asked)),
kt as (select entity, count, unnest(list_distinct(tokens)) as key from known), ks as (select entity, count, unnest(list_distinct(sounds)) as key from known),
qt as (select query_id, unnest(list_distinct(tokens)) as key from q), by_token as (select distinct query_id, entity, count from qt join kt using (key)),
few as (select query_id, sounds from q where query_id not in (select query_id from by_token group by query_id having count(*) >= 80)),
by_sound as (select distinct query_id, entity, count from (select query_id, unnest(list_distinct(sounds)) as key from few) join ks using (key)),
found as (select * from by_token union select * from by_sound), top as (select entity, count from known order by count desc, entity limit 800),
every as (select * from found union all select q.query_id, top.entity, top.count from q, top where q.query_id not in (select query_id from found)),
pairs as (select query_id, entity from every qualify row_number() over (partition by query_id order by count desc, entity) <= 5000)"""


@_query(f"""{_TOTALS.replace('totals as', 'with totals as')} select entity, count, {_SOUND.format("regexp_replace(entity, '[^a-zA-Z]', '', 'g')")} as sound from totals""")
def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with what counts for them, and their sound."""
    return _known(spark, sf_dir).withColumn("sound", E.sound(F.col("entity")))


@_query(f"""{_NAMES} select query_id, count(*) as n, min(p.entity) as least, max(p.entity) as greatest, round(sum(list_aggregate(list_transform(q.tokens, lambda t: list_max(list_transform(k.tokens, lambda c: 1 - levenshtein(t, c) / greatest(length(t), length(c))))), 'sum') / len(q.tokens)), 4) as edit,
  round(sum(len(list_intersect(list_distinct(q.tokens), k.tokens)) / len(list_distinct(q.tokens))), 4) as overlap, round(sum(case when len(k.sounds) = 0 or len(list_filter(q.tokens, lambda t: length(t) >= 4)) = 0 then 0
  else len(list_filter(q.sounds, lambda s: list_contains(k.sounds, s))) / len(list_filter(q.tokens, lambda t: length(t) >= 4)) end), 4) as phonetic
  from pairs p join q using (query_id) join known k on k.entity = p.entity where len(q.tokens) > 0 group by query_id""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question its candidates by tokens, sounds or mere frequency, and the sums of three parts of their scores."""
    own = E.asked_names(_asked(spark, sf_dir)).where(F.size(E.T.name_tokens(F.col("asked"))) > 0)
    per = E.candidate_sums(own, _known(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("edit", "overlap", "phonetic")})
    return own.join(per, "asked").drop("asked")


@_query()
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name each question means, with tier and suggestions; held against brute force, as SQL has no matching blocks."""
    out = E.resolve(_asked(spark, sf_dir), _known(spark, sf_dir))
    return out.withColumns({"confidence": F.round("confidence", 6), "suggestions": F.array_join("suggestions", " | ")})


_META = """meta as (select source as file, sum(len(regexp_extract_all(lower(substr(text, 1, 60)), '\\bthe\\b'))) as count, bool_or(contains(text, 'the')) as named from documents where doc_id % 3 = 0 group by source)"""


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the word in the heads of some documents, and whether their texts hold its letters at all."""
    docs = _read(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    heads = F.sum(E.T.mentions(F.substring("text", 1, 60), "the"))
    return docs.groupBy(F.col("source").alias("file")).agg(heads.alias("count"), F.bool_or(F.contains("text", F.lit("the"))).alias("named"))


@_query(f"""with {_META} select file, cast(case when count <= 0 and named then 1 else count end as bigint) as count, count <= 0 and named as estimated from meta where case when count <= 0 and named then 1 else count end > 0""")
def fast_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source from metadata alone, some estimated."""
    return E.fast_counts(_metadata(spark, sf_dir))


@_query(f"""with {_META}, matched as (select file, cast(count as bigint) as declared from meta where count > 0 or named), scan as (select source as file, cast(sum(len(regexp_extract_all(lower(text), '\\bthe\\b'))) as bigint) as count from documents where source <> '' group by source)
select file, count, declared, 'metadata' as source from scan join matched using (file) where count > 0""")
def verified_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in whole texts of the sources that metadata matches, beside the declared counts."""
    docs = _read(spark, sf_dir, "documents").select(F.col("source").alias("file"), "text")
    return E.verified_counts(_metadata(spark, sf_dir), docs, "the")


@_query("""select source as file, cast(sum(len(regexp_extract_all(lower(text), '\\bthe\\b'))) as bigint) as count, cast(null as bigint) as declared, 'scan' as source from documents where source <> '' group by source having count > 0""".replace("having count", "having sum(len(regexp_extract_all(lower(text), '\\bthe\\b')))"))
def scanned_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in all texts where no metadata matches."""
    docs = _read(spark, sf_dir, "documents").select(F.col("source").alias("file"), "text")
    none = docs.select("file", F.lit(0).alias("count"), F.lit(False).alias("named"))
    return E.verified_counts(none, docs, "the")
