"""Evidence for questions and answers: admission of hits, boosts by rules, claims and what supports them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestream.functions import text as T

# Patterns of terms, names, numbers, amounts, dates, sections and requirements; words they leave out; thresholds.
TERM, NUMBER, NAMES = r"[a-z][a-z0-9_'-]{2,}", r"\b[0-9]+(?:\.[0-9]+)?\b", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b"
DIRECT, PARTIAL, RERANKED = 0.55, 0.25, 0.85
MONEY = r"(?i)\$\s?[0-9][0-9,]*(?:\.[0-9]+)?|\b[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:usd|dollars?)\b"
DATE = r"(?i)\b(?:[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{1,2},?\s+[0-9]{2,4})\b"
SECTION = r"(?i)\b(?:section|code|§)\s*[0-9]{3,5}(?:\.[0-9]+)?\b"
REQUIREMENT = r"(?i)\b(?:must|shall|required|requires|may not|prohibited|eligible|ineligible)\b"
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
TIME_WORDS = "hour hours day days deadline".split()
CLAIM_STOPWORDS = "a an and are as be for in is it of on or the to with".split()
IMPORTANT, UNIMPORTANT = r"[a-z0-9][a-z0-9_.-]{2,}", "what which where when does with from about this that the and".split()


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def content_terms(query: Column, most: int = 16) -> Column:
    """The first distinct terms of a query, lower case, without stopwords and marks at both ends."""
    bare = F.transform(_all(F.lower(query), TERM), lambda t: F.regexp_replace(t, "^[-_']+|[-_']+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & ~t.isin(T.STOPWORDS))), 1, most)


def quoted(query: Column) -> Column:
    """Phrases in double quotes."""
    return F.filter(F.transform(_all(query, r'"([^"]{2,})"', 1), lambda x: F.trim(x)), lambda p: p != "")


def support(query: Column, text: Column, source: Column, score: Column, exact: Column, entity: Column, numeric: Column) -> Column:
    """Struct of support (exact, direct, partial, rejected), reason and lexical: how a hit supports a query with these requirements."""
    hay = F.concat_ws("\n", F.lower(text), F.lower(source))
    holds = lambda x: F.contains(hay, F.lower(x))
    terms, phrases, numbers, names = content_terms(query), quoted(query), _all(query, NUMBER), _all(query, NAMES)
    matched = F.size(F.filter(terms, holds))
    ratio = matched / F.greatest(F.lit(1), F.size(terms))
    of = F.concat(matched.cast("string"), F.lit("/"), F.size(terms).cast("string"))

    def say(kind: str, reason: Column | str, lexical: Column | float) -> Column:
        return F.struct(F.lit(kind).alias("support"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.lit(lexical) if isinstance(lexical, float) else lexical).alias("lexical"))

    return (
        F.when((F.size(phrases) > 0) & F.forall(phrases, holds), say("exact", "all phrases found", 1.0))
        .when(numeric & (F.size(numbers) > 0) & ~F.exists(numbers, holds), say("rejected", "number not found", 0.0))
        .when(entity & (F.size(names) > 0) & ~F.exists(names, holds), say("rejected", "entity not found", 0.0))
        .when(F.size(terms) == 0, say("partial", "no query terms", F.greatest(score, F.lit(PARTIAL))))
        .when(ratio >= DIRECT, say("direct", F.concat(F.lit("matched "), of), ratio))
        .when((ratio >= PARTIAL) & ~exact, say("partial", F.concat(F.lit("matched "), of), ratio))
        .when((score >= RERANKED) & ~exact, say("partial", "high score", score))
        .otherwise(say("rejected", F.concat(F.lit("weak "), of), ratio))
    )


def admit(hits: DataFrame) -> DataFrame:
    """hits(query_id, query, text, source, score, exact, entity, numeric) with support, reason, accepted and scores by name."""
    judged = hits.withColumn("judged_", support(*(F.col(c) for c in ("query", "text", "source", "score", "exact", "entity", "numeric"))))
    scores = F.create_map(F.lit("rerank"), F.round("score", 6), F.lit("lexical_support"), F.round("judged_.lexical", 6))
    out = judged.withColumns({"support": F.col("judged_.support"), "reason": F.col("judged_.reason"), "scores": scores})
    return out.withColumn("accepted", F.col("support") != "rejected").drop("judged_")


def admission_status(queries: DataFrame, admitted: DataFrame) -> DataFrame:
    """(query_id, status, n_accepted, n_rejected) of queries(query_id, intent), those without a hit too."""
    per = admitted.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.coalesce(F.bool_or(F.col("support").isin("exact", "direct")), F.lit(False)).alias("firm"))
    both = queries.select("query_id", "intent").join(per, "query_id", "left")
    status = (
        F.when(F.col("n_accepted") > 0, F.when(F.col("firm"), "direct_support").otherwise("partial_support"))
        .when(F.coalesce("n", F.lit(0)) == 0, "insufficient_evidence").when(F.col("intent") == "missing_detail", "missing_requested_detail").otherwise("background_only")
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select("query_id", status.alias("status"), count(F.col("n_accepted")).alias("n_accepted"), count(F.col("n") - F.col("n_accepted")).alias("n_rejected"))


def accepted_documents(docs: DataFrame, admitted: DataFrame) -> DataFrame:
    """Rows of docs(query_id, chunk_id, source, ...) that were admitted for their query."""
    return docs.join(admitted.where("accepted").select("query_id", "chunk_id", "source"), ["query_id", "chunk_id", "source"], "left_semi")


def _rules() -> list[tuple[str, float, Column]]:
    """Name, amount and condition of each rule of the boost, over the columns of `boosted`."""
    q, fields, profile = F.lower("query"), F.transform("answerable_fields", lambda x: F.lower(x)), F.col("profile")
    important = F.slice(F.filter(_all(q, IMPORTANT), lambda t: ~t.isin(UNIMPORTANT)), 1, 12)
    asked = F.transform(_all(F.col("query"), NAMES), lambda x: F.lower(x))
    section = F.lower(F.coalesce("section_id", F.lit("")))
    detail = F.array(*map(F.lit, ("price", "date", "requirement")))
    return [
        ("source_family_query_match", 0.08, F.exists(important, lambda t: F.contains(F.lower(F.coalesce("source_family", F.lit(""))), t))),
        ("section_id_exact_match", 0.18, (section != "") & F.contains(q, section)),
        ("answerable_field_match", 0.08, (F.col("intent") == "missing_detail") & F.arrays_overlap(fields, detail)),
        ("requirement_field_match", 0.10, (F.col("intent") == "requirement") & F.array_contains(fields, "requirement")),
        ("entity_exact_match", 0.12, F.col("intent").isin("structured_list", "count") & F.arrays_overlap(asked, F.transform("primary_entities", lambda x: F.lower(x)))),
        ("legal_section_metadata", 0.05, (profile == "legal_precision") & (section != "")),
        ("archive_document_identity", 0.04, (profile == "evidence_archive") & (F.coalesce("document_id", F.lit("")) != "")),
        ("product_answerable_fields", 0.04, (profile == "product_ops") & (F.size("answerable_fields") > 0)),
        ("low_extraction_quality_penalty", -0.05, F.col("quality") < 0.5),
    ]


def boosted(hits: DataFrame, low: float = -0.1, high: float = 0.35) -> DataFrame:
    """hits(query, intent, profile, source_family, section_id, document_id, answerable_fields, primary_entities, quality)
    with `boost`, the clamped sum of the rules that apply, and `by_rule`, a map of these rules and their amounts."""
    all_ = F.array(*(F.struct(F.lit(n).alias("key"), F.lit(a).alias("value"), F.coalesce(c, F.lit(False)).alias("on")) for n, a, c in _rules()))
    on = F.filter(all_, lambda r: r["on"])
    by = F.map_from_entries(F.transform(on, lambda r: F.struct(r["key"], r["value"])))
    total = F.aggregate(F.map_values("by_rule"), F.lit(0.0), lambda s, x: s + x)
    return hits.withColumn("by_rule", by).withColumn("boost", F.round(F.greatest(F.lit(low), F.least(F.lit(high), total)), 6))


# Claims


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def plain(text: Column) -> Column:
    """Lower case, letters a-z, digits, $, § and dots, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9$§.]+", " "))


def claims(answers: DataFrame, entities: bool = False, most: int = 50) -> DataFrame:
    """(answer_id, nth, kind, value) of answers(answer_id, text): amounts, dates, sections, requirements and, if wanted, names; each once."""
    text = F.coalesce("text", F.lit(""))
    requirement = F.transform(F.filter(sentences(F.col("text")), lambda s: s.rlike(REQUIREMENT)), lambda s: F.substring(s, 1, 300))
    kinds = [("price", _all(text, MONEY)), ("date", _all(text, DATE)), ("legal_code_section", _all(text, SECTION)), ("requirement", requirement)]
    kinds += [("named_entity", _all(text, NAMES))] if entities else []

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    pairs = F.concat(*(named(kind, found) for kind, found in kinds))
    cut = answers.select("answer_id", F.posexplode(F.slice(F.array_distinct(pairs), 1, most)).alias("nth", "c"))
    return cut.select("answer_id", (F.col("nth") + 1).alias("nth"), "c.*")


def claim_tokens(text: Column, most: int = 40) -> Column:
    kept = F.filter(F.split(plain(text), " "), lambda t: (t != "") & ~t.isin(CLAIM_STOPWORDS) & ((F.length(t) > 2) | t.rlike("^[0-9]+$")))
    return F.slice(kept, 1, most)


def verdicts(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """found(answer_id, nth, kind, value) with `supported` and `how`: value, plain, overlap, core or none.

    evidence(answer_id, text): what was accepted for the answer, one row for each
    packet. Every packet is asked by itself for whole values, and the tokens of all
    packets of an answer together for requirements.
    """
    packets = evidence.select("answer_id", F.lower("text").alias("low"), plain(F.col("text")).alias("flat"))
    words = packets.select("answer_id", F.explode(F.split("flat", " ")).alias("t")).distinct()
    wanted = found.where("kind = 'requirement'").select("answer_id", "nth", F.posexplode(claim_tokens(F.col("value"))).alias("at", "t"))
    number = F.col("t").rlike("^[0-9]+$")
    critical, core = number | F.col("t").isin(NUMBER_WORDS) | F.col("t").isin(TIME_WORDS), ~number & ~F.col("t").isin(NUMBER_WORDS)
    have = wanted.join(words.withColumn("in_", F.lit(True)), ["answer_id", "t"], "left").withColumn("in_", F.coalesce("in_", F.lit(False)))
    inside = have.groupBy("answer_id", "nth").agg(
        F.count("*").alias("n_tokens"), F.count_if("in_").alias("n_in"), F.count_if(critical).alias("n_critical"), F.count_if(core & F.col("in_")).alias("n_core"))
    # Critical tokens count as found inside words too, as in "30days".
    met = wanted.where(critical).join(packets.select("answer_id", "flat"), "answer_id", "left").groupBy("answer_id", "nth", "at").agg(F.coalesce(F.bool_or(F.contains("flat", "t")), F.lit(False)).alias("met"))
    lost = met.groupBy("answer_id", "nth").agg(F.count_if(~F.col("met")).alias("n_lost"))
    value = found.select("answer_id", "nth", F.lower("value").alias("v"), plain(F.col("value")).alias("p")).join(packets, "answer_id")
    whole = value.groupBy("answer_id", "nth").agg(F.bool_or(F.contains("low", "v")).alias("as_value"), F.bool_or((F.col("p") != "") & F.contains("flat", "p")).alias("as_plain"))
    out = found.join(whole, ["answer_id", "nth"], "left").join(inside, ["answer_id", "nth"], "left").join(lost, ["answer_id", "nth"], "left")
    enough = (F.col("n_in") / F.col("n_tokens") >= 0.6) & (F.col("n_in") >= F.least(F.lit(4), F.col("n_tokens")))
    how = (
        F.when(F.col("as_value"), "value").when(F.col("as_plain"), "plain").when(F.col("kind") != "requirement", "none").when(F.col("n_tokens").isNull(), "overlap")
        .when(F.col("n_lost") > 0, "none").when(enough, "overlap").when((F.col("n_critical") > 0) & (F.col("n_core") >= 3), "core").otherwise("none")
    )
    return out.select("answer_id", "nth", "kind", "value", how.alias("how")).withColumn("supported", F.col("how") != "none")


def verification_stats(docs: DataFrame) -> DataFrame:
    """One row of docs(verified, score): how many, how many verified, and least, greatest and mean of their scores, 0 without any."""
    score = F.when(F.col("verified"), F.col("score"))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return docs.agg(F.count("*").alias("total"), F.count_if(F.col("verified")).alias("verified"), zero(F.min(score)).alias("least"), zero(F.max(score)).alias("greatest"), zero(F.avg(score)).alias("mean"))
