"""Evidence, claims, staged searches and sparse vectors over the given tables.

Questions are benchmark passages, altered by their number so that every rule is met;
answers are turns of conversations with claims added in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.functions import text as T
from lorestream.operators import evidence, retrieval, sparse, staged
from lorestream.plans.queries import _BM25, _benchmark, _in, _query, _read

_ASKED = """asked_as as (select item_id as query_id, case item_id % 8 when 0 then '' when 1 then '"' || string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] || '" ' || text when 2 then text || ' 42'
  when 3 then text || ' Zeb Quill' when 4 then substr(text, 1, 20) || ' alpha beta gamma delta epsilon' else text end as query, item_id % 3 = 0 as exact, item_id % 8 = 3 as entity, item_id % 8 = 2 as numeric,
  case when item_id % 5 = 0 then 'missing_detail' when item_id % 5 = 1 then 'requirement' else 'count' end as intent from benchmark)"""
_TERMS = f"""list_filter(list_transform(regexp_extract_all(lower(query), '{evidence.TERM.replace("'", "''")}'), lambda t: regexp_replace(t, '^[-_'']+|[-_'']+$', '', 'g')), lambda t: length(t) >= 3 and t not in ({_in(T.STOPWORDS)}))"""
_ADMITTED = f"""with {_BM25}, {_ASKED}, h as (select query_id, doc_id, query, exact, entity, numeric, round(1 / rank, 6) as score, lower(text) || chr(10) || lower(coalesce(source, '')) as hay,
  {_TERMS} as raw, list_filter(regexp_extract_all(query, '"([^"]{{2,}})"', 1), lambda p: trim(p, ' ') <> '') as phrases, regexp_extract_all(query, '{evidence.NUMBER}') as numbers, regexp_extract_all(query, '{evidence.NAMES}') as names
  from best join asked_as using (query_id) join documents using (doc_id)), t as (select *, list_filter(raw, lambda x, i: list_position(raw, x) = i)[1:16] as terms from h),
m as (select *, len(list_filter(terms, lambda x: contains(hay, x))) as n, greatest(1, len(terms)) as of, len(list_filter(terms, lambda x: contains(hay, x))) / greatest(1, len(terms)) as ratio from t),
j as (select *, case when len(phrases) > 0 and len(list_filter(phrases, lambda x: contains(hay, lower(x)))) = len(phrases) then 'exact|all phrases found|1' when numeric and len(numbers) > 0 and len(list_filter(numbers, lambda x: contains(hay, x))) = 0 then 'rejected|number not found|0'
  when entity and len(names) > 0 and len(list_filter(names, lambda x: contains(hay, lower(x)))) = 0 then 'rejected|entity not found|0' when len(terms) = 0 then 'partial|no query terms|score' when ratio >= {evidence.DIRECT} then 'direct|matched |ratio' when ratio >= {evidence.PARTIAL} and not exact then 'partial|matched |ratio'
  when score >= {evidence.RERANKED} and not exact then 'partial|high score|best' else 'rejected|weak |ratio' end as v from m),
a as (select query_id, doc_id, string_split(v, '|')[1] as support, string_split(v, '|')[2] || case when v like '%matched%' or v like '%weak%' then n || '/' || len(terms) else '' end as reason,
  round(case string_split(v, '|')[3] when '1' then 1.0 when '0' then 0.0 when 'score' then greatest(score, 0.25) when 'best' then score else ratio end, 6) as lexical_support, score as rerank from j)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("item_id"), F.col("text")
    words = F.split(text, " ")
    query = (
        F.when(i % 8 == 0, "").when(i % 8 == 1, F.concat(F.lit('"'), words[0], F.lit(" "), words[1], F.lit('" '), text)).when(i % 8 == 2, F.concat(text, F.lit(" 42")))
        .when(i % 8 == 3, F.concat(text, F.lit(" Zeb Quill"))).when(i % 8 == 4, F.concat(F.substring(text, 1, 20), F.lit(" alpha beta gamma delta epsilon"))).otherwise(text)
    )
    intent = F.when(i % 5 == 0, "missing_detail").when(i % 5 == 1, "requirement").otherwise("count")
    return _read(spark, sf_dir, "benchmark").select(i.alias("query_id"), query.alias("query"), (i % 3 == 0).alias("exact"), (i % 8 == 3).alias("entity"), (i % 8 == 2).alias("numeric"), intent.alias("intent"))


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    hits = _benchmark(spark, sf_dir).select("query_id", "doc_id", F.round(1 / F.col("rank"), 6).alias("score"))
    return evidence.admit(hits.join(_questions(spark, sf_dir), "query_id").join(docs, "doc_id"))


@_query(f"{_ADMITTED} select query_id, doc_id, support, reason, round(lexical_support, 4) as lexical_support, rerank from a")
def evidence_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each of the twenty best documents supports its question, or why not."""
    out = _admitted(spark, sf_dir)
    return out.select("query_id", "doc_id", "support", "reason", F.round(F.col("scores")["lexical_support"], 4).alias("lexical_support"), F.col("scores")["rerank"].alias("rerank"))


@_query(f"""{_ADMITTED}, q as (select query_id, intent from asked_as union all select query_id + 1000000, intent from asked_as where query_id % 10 = 0),
p as (select query_id, count(*) as n, count(*) filter (support <> 'rejected') as k, bool_or(support in ('exact', 'direct')) as firm from a group by query_id)
select query_id, case when k > 0 then case when firm then 'direct_support' else 'partial_support' end when n is null then 'insufficient_evidence' when intent = 'missing_detail' then 'missing_requested_detail' else 'background_only' end as status,
  coalesce(k, 0) as n_accepted, coalesce(n - k, 0) as n_rejected from q left join p using (query_id)""")
def admission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence of each question comes to, some questions having none."""
    asked = _questions(spark, sf_dir).select("query_id", "intent")
    more = asked.where("query_id % 10 = 0").select((F.col("query_id") + 1_000_000).alias("query_id"), "intent")
    return evidence.admission_status(asked.unionByName(more), _admitted(spark, sf_dir))


@_query(f"{_ADMITTED} select query_id, doc_id, source from best join documents using (doc_id) where (query_id, doc_id) in (select (query_id, doc_id) from a where support <> 'rejected')")
def accepted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits whose evidence was admitted."""
    hits = _benchmark(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("Unknown")).alias("source"))
    admitted = _admitted(spark, sf_dir).select("query_id", F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("Unknown")).alias("source"), "accepted")
    return evidence.accepted_documents(hits, admitted).select("query_id", F.col("chunk_id").alias("doc_id"), F.when(F.col("source") != "Unknown", F.col("source")).alias("source"))


_OVERLAY = "case when doc_id % 3 = 0 then source end as family, case when doc_id % 4 = 0 then '42' when doc_id % 4 = 1 then '' end as section, doc_id % 5 as f, doc_id % 7 as e, case when doc_id % 6 = 0 then 0.3 when doc_id % 6 < 4 then 0.9 end as quality, case doc_id % 4 when 0 then 'legal_precision' when 1 then 'evidence_archive' when 2 then 'product_ops' else 'general' end as profile"


@_query(f"""with {_BM25}, {_ASKED}, o as (select query_id, doc_id, lower(query) || case when doc_id % 2 = 0 then ' ' || lower(coalesce(source, '')) else '' end as q, query, intent, {_OVERLAY} from best join asked_as using (query_id) join documents using (doc_id)),
r as (select query_id, doc_id, (case when len(list_filter(list_filter(regexp_extract_all(q, '{evidence.IMPORTANT}'), lambda t: t not in ({_in(evidence.UNIMPORTANT)}))[1:12], lambda t: contains(lower(coalesce(family, '')), t))) > 0 then ['source_family_query_match'] else [] end
  || case when coalesce(section, '') <> '' and contains(q, section) then ['section_id_exact_match'] else [] end || case when intent = 'missing_detail' and f < 3 then ['answerable_field_match'] else [] end || case when intent = 'requirement' and f = 1 then ['requirement_field_match'] else [] end
  || case when intent = 'count' and e = 0 and list_contains(list_transform(regexp_extract_all(query, '{evidence.NAMES}'), lambda x: lower(x)), 'zeb quill') then ['entity_exact_match'] else [] end || case when profile = 'legal_precision' and coalesce(section, '') <> '' then ['legal_section_metadata'] else [] end
  || case when profile = 'evidence_archive' then ['archive_document_identity'] else [] end || case when profile = 'product_ops' and f < 3 then ['product_answerable_fields'] else [] end || case when quality < 0.5 then ['low_extraction_quality_penalty'] else [] end)::varchar[] as rules from o)
select query_id, doc_id, array_to_string(rules, ',') as rules, round(greatest(-0.1, least(0.35, list_sum(list_transform(rules || ['none'], lambda x: case x when 'source_family_query_match' then 0.08 when 'section_id_exact_match' then 0.18 when 'answerable_field_match' then 0.08
  when 'requirement_field_match' then 0.1 when 'entity_exact_match' then 0.12 when 'legal_section_metadata' then 0.05 when 'archive_document_identity' then 0.04 when 'product_answerable_fields' then 0.04 when 'none' then 0.0 else -0.05 end)))), 6)::double as boost from r""")
def evidence_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boost of each hit and the rules that give it."""
    i = F.col("doc_id")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    hits = _benchmark(spark, sf_dir).select("query_id", "doc_id").join(_questions(spark, sf_dir).select("query_id", "query", "intent"), "query_id").join(docs, "doc_id")
    hits = hits.withColumn("query", F.concat("query", F.when(i % 2 == 0, F.concat(F.lit(" "), F.lower(F.coalesce("source", F.lit(""))))).otherwise(F.lit(""))))
    overlay = hits.withColumns(
        {
            "source_family": F.when(i % 3 == 0, F.col("source")),
            "section_id": F.when(i % 4 == 0, "42").when(i % 4 == 1, ""),
            "document_id": F.concat(F.lit("d"), i.cast("string")),
            "answerable_fields": F.when(i % 5 == 0, F.array(F.lit("Price"))).when(i % 5 == 1, F.array(F.lit("requirement"))).when(i % 5 == 2, F.array(F.lit("date"))).otherwise(F.array().cast("array<string>")),
            "primary_entities": F.when(i % 7 == 0, F.array(F.lit("Zeb Quill"))).otherwise(F.array().cast("array<string>")),
            "quality": F.when(i % 6 == 0, 0.3).when(i % 6 < 4, 0.9),
            "profile": F.when(i % 4 == 0, "legal_precision").when(i % 4 == 1, "evidence_archive").when(i % 4 == 2, "product_ops").otherwise("general"),
        }
    )
    out = evidence.boosted(overlay)
    return out.select("query_id", "doc_id", F.array_join(F.map_keys("by_rule"), ",").alias("rules"), "boost")


# Claims

_SAID = """case turn % 4 when 0 then ' It costs $' || conv_id || '00 or 7 USD.' when 1 then ' Members must pay within 30 days of notice. It is done.' when 2 then ' On Jan ' || (conv_id % 28 + 1) || ', 2024 Section ' || (1000 + conv_id) || ' shall apply to three parties. Anna Maria Lopez signed.'
  else ' Sign by 3/4/2024; see code 4321.5. Guests are eligible.' end"""
_PACKETS = """select conv_id, turn, text || case turn % 3 when 0 then ' Costs: $' || conv_id || '00; 7-USD fee. Members pay in 30 days after notice.' when 1 then ' section ' || (1000 + conv_id) || ' parties three apply; guests eligible.' else ' Jan ' || (conv_id % 28 + 1) || ', 2024 by 3/4/2024' end as text from conversations where role <> 'assistant'"""
_CLAIMED = f"""with s as (select conv_id * 1000 + turn as answer_id, conv_id, text || {_SAID} as text from conversations where role = 'assistant'),
c as (select answer_id, conv_id, list_transform(regexp_extract_all(text, '{evidence.MONEY}'), lambda v: {{'kind': 'price', 'value': v}}) || list_transform(regexp_extract_all(text, '{evidence.DATE}'), lambda v: {{'kind': 'date', 'value': v}})
  || list_transform(regexp_extract_all(text, '{evidence.SECTION}'), lambda v: {{'kind': 'legal_code_section', 'value': v}}) || list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')),
  lambda x: x <> '' and regexp_matches(x, '{evidence.REQUIREMENT}')), lambda v: {{'kind': 'requirement', 'value': substr(v, 1, 300)}}) || list_transform(regexp_extract_all(text, '{evidence.NAMES}'), lambda v: {{'kind': 'named_entity', 'value': v}}) as l from s),
claim as (select answer_id, conv_id, i as nth, k[i].kind as kind, k[i].value as value from (select answer_id, conv_id, k, unnest(range(1, len(k) + 1)) as i from (select *, list_filter(l, lambda x, i: list_position(l, x) = i)[1:50] as k from c)))"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(answers, evidence): assistant turns with claims, other turns of the conversation as packets for each of them."""
    c, t = F.col("conv_id"), F.col("turn")
    cat = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    said = (
        F.when(t % 4 == 0, cat(" It costs $", c, "00 or 7 USD.")).when(t % 4 == 1, " Members must pay within 30 days of notice. It is done.")
        .when(t % 4 == 2, cat(" On Jan ", c % 28 + 1, ", 2024 Section ", c + 1000, " shall apply to three parties. Anna Maria Lopez signed.")).otherwise(" Sign by 3/4/2024; see code 4321.5. Guests are eligible.")
    )
    more = (
        F.when(t % 3 == 0, cat(" Costs: $", c, "00; 7-USD fee. Members pay in 30 days after notice.")).when(t % 3 == 1, cat(" section ", c + 1000, " parties three apply; guests eligible."))
        .otherwise(cat(" Jan ", c % 28 + 1, ", 2024 by 3/4/2024"))
    )
    turns = _read(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select((c * 1000 + t).alias("answer_id"), "conv_id", F.concat("text", said).alias("text"))
    packets = turns.where("role <> 'assistant'").select("conv_id", F.concat("text", more).alias("text"))
    return answers.drop("conv_id"), answers.select("answer_id", "conv_id").join(packets, "conv_id").select("answer_id", "text")


@_query(f"{_CLAIMED} select answer_id, nth, kind, value from claim")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, dates, sections, requirements and names that answers claim."""
    return evidence.claims(_answers(spark, sf_dir)[0], entities=True).withColumn("nth", F.col("nth").cast("long"))


_FLAT = "trim(regexp_replace(lower({0}), '[^a-z0-9$§.]+', ' ', 'g'), ' ')"
_KEEP = f"list_filter(string_split({_FLAT.format('value')}, ' '), lambda t: t <> '' and t not in ({_in(evidence.CLAIM_STOPWORDS)}) and (length(t) > 2 or regexp_matches(t, '^[0-9]+$')))[1:40]"
_CRITICAL = f"(regexp_matches(t, '^[0-9]+$') or t in ({_in(evidence.NUMBER_WORDS + evidence.TIME_WORDS)}))"
_CORE = f"(not regexp_matches(t, '^[0-9]+$') and t not in ({_in(evidence.NUMBER_WORDS)}))"


@_query(f"""{_CLAIMED}, pk as ({_PACKETS}), e as (select conv_id, list(lower(text)) as low, list({_FLAT.format('text')}) as flat, list_distinct(flatten(list(string_split({_FLAT.format('text')}, ' ')))) as w from pk group by conv_id),
x as (select answer_id, nth, kind, value, low, flat, w, {_KEEP} as k, {_FLAT.format('value')} as p from claim left join e using (conv_id)),
v as (select *, len(k) as n, len(list_filter(k, lambda t: list_contains(w, t))) as n_in, len(list_filter(k, lambda t: {_CRITICAL})) as n_c, len(list_filter(k, lambda t: {_CRITICAL} and len(list_filter(flat, lambda f: contains(f, t))) = 0)) as lost, len(list_filter(k, lambda t: {_CORE} and list_contains(w, t))) as core from x)
select answer_id, nth, kind, how, how <> 'none' as supported from (select *, case when len(list_filter(low, lambda f: contains(f, lower(value)))) > 0 then 'value' when p <> '' and len(list_filter(flat, lambda f: contains(f, p))) > 0 then 'plain' when kind <> 'requirement' then 'none' when n = 0 then 'overlap'
  when lost > 0 then 'none' when n_in / n >= 0.6 and n_in >= least(4, n) then 'overlap' when n_c > 0 and core >= 3 then 'core' else 'none' end as how from v)""")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the other turns of its conversation bear each claim out, and how."""
    answers, packets = _answers(spark, sf_dir)
    out = evidence.verdicts(evidence.claims(answers, entities=True), packets)
    return out.select("answer_id", F.col("nth").cast("long").alias("nth"), "kind", "how", "supported")


@_query(f"""with {_BM25}, d as (select rank % 3 = 0 as verified, round(score, 6) as score from best) select count(*) as total, count(*) filter (verified) as verified, coalesce(round(min(case when verified then score end), 6), 0) as least,
  coalesce(round(max(case when verified then score end), 6), 0) as greatest, coalesce(round(avg(case when verified then score end), 6), 0) as mean from d""")
def verification_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of verified hits in one row."""
    return evidence.verification_stats(_benchmark(spark, sf_dir).select((F.col("rank") % 3 == 0).alias("verified"), "score"))


# Staged and sparse search

_MET = "met as (select query_id, doc_id, count(*) as m from asked join tf using (token) group by all), terms as (select query_id, count(*) as t from asked group by query_id)"
_STAGES = f"""with {_BM25}, {_MET}, s as (select query_id, doc_id, case when m = t then 0 when 2 * m >= t then 1 else 2 end as own, row_number() over (partition by query_id order by m desc, doc_id) as rank from met join terms using (query_id) qualify rank <= 40),
hits as (select query_id, doc_id as item, rank, unnest(range(own, 3)) as stage from s where not (query_id % 4 = 0 and own = 0) and not (query_id % 16 = 1)), f as (select query_id, item, min(stage) as stage, min(rank) as rank from hits group by all),
u as (select query_id, stage, sum(count(*)) over (partition by query_id order by stage) as upto from f group by query_id, stage), r as (select query_id, min(case when upto >= 3 then stage end) as reached, min(stage) as first from u group by query_id)
select query_id, item, row_number() over (partition by query_id order by stage, rank, item) as place, stage, coalesce(reached, first) as won from f join r using (query_id) where stage <= coalesce(reached, 99) qualify place <= 10"""


@_query(f"select query_id, item, place, cast(stage as bigint) as stage, cast(won as bigint) as won from ({_STAGES})")
def staged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all terms of a passage, then half of them, then any, until three are found."""
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    terms = queries.select("query_id", F.size(F.array_distinct(T.tokens(F.col("query")))).alias("t"))
    met = retrieval.bm25_scores(queries, _read(spark, sf_dir, "documents").select("doc_id", "text"), digits=6).select("query_id", "doc_id", F.col("n_terms").alias("score"))
    best = retrieval.top_k(met, 40).join(terms, "query_id")
    own = F.when(F.col("score") == F.col("t"), 0).when(2 * F.col("score") >= F.col("t"), 1).otherwise(2)
    hits = best.withColumn("own", own).where("not (query_id % 4 = 0 and own = 0) and not (query_id % 16 = 1)").select("query_id", F.col("doc_id").alias("item"), "rank", F.explode(F.sequence("own", F.lit(2))).alias("stage"))
    out = staged.relaxed(hits, most=10)
    return out.select("query_id", "item", *(F.col(c).cast("long").alias(c) for c in ("place", "stage", "won")))


_SNIPPETS = "select conv_id as file, turn as chunk, substr(text, 1, 300) as snippet, {1} as relaxed from conversations where contains(lower(text), 'and') and {0} order by conv_id, turn limit 10"


@_query(f"select 'system' as who, * from ({_SNIPPETS.format(chr(114) + 'ole = ' + repr('system'), 'false')}) union all select 'nobody', * from ({_SNIPPETS.format('true', 'true')})")
def exact_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten turns with a word: of one role, and of nobody, which relaxes to all."""
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("chunk"), "text", "role")
    found = [staged.exact_snippets(turns, "and", F.col("role") == who).withColumn("who", F.lit(who)) for who in ("system", "nobody")]
    return found[0].unionByName(found[1])


@_query("""select doc_id, md5(concat_ws(chr(10), nullif(text, ''), nullif(source, ''), cast(doc_id as varchar), case when doc_id % 2 = 0 then 'Zeb Quill' end, case when doc_id % 2 = 0 then lang end)) as digest from documents""")
def sparse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the text that each document's sparse vector is made of."""
    even = F.col("doc_id") % 2 == 0
    names = F.when(even, F.array(F.lit("Zeb Quill"), F.lit(""), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("source_filename"), F.col("doc_id").alias("document_id"), names.alias("entity_names"))
    return rows.select("doc_id", F.md5(sparse.sparse_text(rows)).alias("digest"))


@_query()
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each passage the ten documents of highest sparse dot product of whole texts; held against brute force, as SQL lacks the hash."""
    queries = sparse.with_vectors(_read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), most=None, keep_text=False)
    docs = sparse.with_vectors(_read(spark, sf_dir, "documents").select("doc_id", "text"), most=None, keep_text=False)
    return sparse.dot_top_k(queries, docs, 10, 6)
