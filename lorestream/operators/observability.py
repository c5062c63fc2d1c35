"""What a service's records say: alerts on each query, a summary of them, quality of evidence, confidence and cache counts.

A record is a row for each query answered: (event_id, ts, kb, intent, mode, answer_state,
latency, accepted, citations, fallback, capped, unsupported, failures, words). Any of them
may be null; a number then counts as 0, a mark as false, a label as 'unknown'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestream.operators import tables

# Intents by kind, flags of poor extraction and those that limit a source.
RISKY_INTENTS = ("count", "structured_list", "requirement", "legal", "archive")
DIRECT_INTENTS = ("definition", "direct_answer", "factual")
STRUCTURED_INTENTS, STRUCTURED_MODES = ("count", "structured_list"), ("structured_count", "structured_list")
ANSWERED = ("grounded_answer", "direct_response")
LOW_FLAGS = ("low_text_quality", "low_alpha_ratio", "ocr_fragmented_lines", "replacement_characters", "extraction_error", "low_quality_chunk")
LIMITING_FLAGS = ("low_alpha_ratio", "ocr_fragmented_lines", "replacement_characters", "extraction_error")


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _marked(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _label(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown"))


def with_alerts(records: DataFrame, guarded: str = "", slowest: float = 9.0) -> DataFrame:
    """records with alerts, the codes of all rules each breaks; knowledge bases whose name starts with `guarded` must have evidence."""
    rules = {
        "answer_without_accepted_evidence": F.startswith(F.coalesce("kb", F.lit("")), F.lit(guarded)) & (_number("accepted") <= 0) & F.col("answer_state").isin(*ANSWERED),
        "fallback_used_for_high_risk_query": _marked("fallback") & F.col("intent").isin(*RISKY_INTENTS),
        "unsupported_claims_detected": _number("unsupported") > 0,
        "citation_validation_failures": _number("failures") > 0,
        "confidence_cap_applied": _marked("capped"),
        "direct_answer_latency_budget_exceeded": F.col("intent").isin(*DIRECT_INTENTS) & (_number("latency") > slowest),
    }
    return records.withColumn("alerts", F.array_compact(F.array(*(F.when(broken, code) for code, broken in rules.items()))))


def summary(records: DataFrame, window: int | None = None, kb: str | None = None) -> DataFrame:
    """(metric, key, value) of records with alerts: counts, rates, averages, distributions and latencies.

    Of one knowledge base if `kb` is given, over the newest `window` records if that is.
    Errors count as events and with their alerts, not as queries. Without any query
    rates, averages and overall latencies are 0, and there are no distributions.
    """
    rows = records if kb is None else records.where(F.col("kb") == kb)
    if window:
        rows = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(window)
    rows = rows.withColumn("asked", ~F.coalesce(F.col("answer_state") == "error", F.lit(False)))
    return _totals(rows).unionByName(_distributions(rows)).unionByName(_latencies(rows.where("asked")))


def _pair(metric: str, key: Column | str) -> Column:
    return F.struct(F.lit(metric).alias("metric"), (F.lit(key) if isinstance(key, str) else key).alias("key"))


def _totals(rows: DataFrame) -> DataFrame:
    state = F.col("answer_state")
    structured = F.coalesce(F.col("intent").isin(*STRUCTURED_INTENTS), F.lit(False)) | F.coalesce(F.col("mode").isin(*STRUCTURED_MODES), F.lit(False))
    of = lambda condition: F.count_if(F.col("asked") & condition)
    counts = {
        "source_limited": of(state == "source_limited_answer"), "true_out_of_scope": of(state == "true_out_of_scope"), "no_accepted_evidence": of(_number("accepted") <= 0), "fallback_used": of(_marked("fallback")),
        "confidence_cap": of(_marked("capped")), "unsupported_claim": of(_number("unsupported") > 0), "citation_validation_failure": of(_number("failures") > 0),
        "followup_transform_success": of(state == "conversation_transform"), "structured_search_exact_result": of(structured & (_number("accepted") > 0) & (_number("citations") > 0)),
    }
    per = rows.agg(
        F.count("*").alias("events"), of(F.lit(True)).alias("queries"), of(structured).alias("structured"), F.max(F.when(F.col("asked"), _number("latency"))).alias("slowest"),
        *(F.avg(F.when(F.col("asked"), _number(c))).alias(f"mean_{c}") for c in ("accepted", "words")), *(c.alias(name) for name, c in counts.items()),
    )
    total = F.col("queries")
    among = {"followup_transform_success": F.col("followup_transform_success"), "structured_search_exact_result": F.col("structured")}
    value = lambda metric, key, x: F.struct(F.lit(metric).alias("metric"), F.lit(key).alias("key"), x.cast("double").alias("value"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    told = [
        value("count", "events", F.col("events")), value("count", "queries", total), value("count", "errors", F.col("events") - total), value("latency_max", "all", zero(F.round("slowest", 3))),
        value("average", "accepted_evidence", zero(F.round("mean_accepted", 3))), value("average", "answer_words", zero(F.round("mean_words", 3))),
        *(value("rate", name, zero(F.round(F.col(name) / F.nullif(among.get(name, total), F.lit(0)), 4))) for name in counts),
        *(F.when(total == 0, value(metric, "all", F.lit(0.0))) for metric in ("latency_p50", "latency_p95")),
    ]
    return per.select(F.inline(F.array_compact(F.array(*told))))


def _distributions(rows: DataFrame) -> DataFrame:
    """One pass: each record gives its labels and alerts, counted before they are shuffled."""
    labels = F.array(_pair("answer_state", _label("answer_state")), _pair("intent", _label("intent")), _pair("kb", _label("kb")))
    codes = F.transform("alerts", lambda code: _pair("alert", code))
    told = rows.select(F.inline(F.concat(F.when(F.col("asked"), labels).otherwise(F.slice(labels, 1, 0)), codes)))
    return told.groupBy("metric", "key").agg(F.count("*").cast("double").alias("value"))


def _latencies(asked: DataFrame) -> DataFrame:
    """Percentiles by linear interpolation over all queries, by intent and by knowledge base; a group is windowed over distinct values."""
    groups = F.array(_pair("", "all"), _pair("_by_intent", _label("intent")), _pair("_by_kb", _label("kb")))
    values = asked.select(F.explode(groups).alias("of"), _number("latency").cast("double").alias("latency"))
    ends = [tables.interpolated(values, "of", "latency", share).select(F.concat(F.lit(name), "of.metric").alias("metric"), "of.key", F.col("percentile").alias("value")) for name, share in (("latency_p50", 0.5), ("latency_p95", 0.95))]
    return ends[0].unionByName(ends[1])


def evidence_quality(queries: DataFrame, hits: DataFrame, low: float = 0.55, limited: float = 0.45) -> DataFrame:
    """How well the evidence of queries(query_id, high_risk) was extracted, from hits(query_id, quality, flags, poor).

    A hit is low by its mark, by a flag or by its quality; unknown quality is not low by
    itself. A query without hits has none low and no cap. Flags are a fixed vocabulary.
    """
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    overlaps = lambda a, listed: F.exists(a, lambda x: F.coalesce(x.isin(*listed), F.lit(False)))
    is_low = _marked("poor") | overlaps(flags, LOW_FLAGS) | F.coalesce(F.col("quality") < low, F.lit(False))
    per = hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.count_if(is_low).alias("n_low"), F.min("quality").alias("worst"), F.avg("quality").alias("mean"),
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(flags))))).alias("flags"),
    )
    out = queries.select("query_id", _marked("high_risk").alias("high_risk")).join(per, "query_id", "left").withColumns({"n_hits": _number("n_hits"), "n_low": _number("n_low"), "flags": F.coalesce("flags", F.array().cast("array<string>"))})
    every, some = (F.col("n_hits") > 0) & (F.col("n_low") == F.col("n_hits")), F.col("n_low") > 0
    held_back = every & F.col("high_risk") & F.coalesce(F.col("mean") < limited, F.lit(True)) & overlaps(F.col("flags"), LIMITING_FLAGS)
    reasons = F.array(
        F.when(every, "all_final_evidence_low_extraction_quality").when(some, "some_final_evidence_low_extraction_quality"), F.when(held_back, "high_risk_query_with_only_low_quality_evidence"))
    return out.select(
        "query_id", "n_hits", "n_low", F.round(F.col("n_low") / F.greatest(F.col("n_hits"), F.lit(1)), 6).alias("low_ratio"), F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"),
        held_back.alias("source_limited"), F.when(every, 0.45).when(some, 0.65).alias("cap"), F.array_compact(reasons).alias("reasons"), F.slice("flags", 1, 20).alias("flags"),
    )


def cited_confidence(coverage: Column, score: Column, citations: Column) -> Column:
    """0 to 1: coverage and mean score at 0.4 each, citations at 0.2 with three as enough; each within 0 and 1, null as 0."""
    clamped = lambda x: F.least(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return 0.4 * clamped(coverage) + 0.4 * clamped(score) + 0.2 * clamped(citations / 3)


def cache_statistics(requests: DataFrame, *by: str) -> DataFrame:
    """Requests, hits, misses and their rate, of requests(hit); each miss stores an answer."""
    hits, n = F.count_if(_marked("hit")), F.count("*")
    return requests.groupBy(*by).agg(n.alias("n_requests"), hits.alias("n_hits"), (n - hits).alias("n_misses"), F.round(hits / F.nullif(n, F.lit(0)), 4).alias("hit_rate"))
