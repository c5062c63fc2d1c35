"""Evaluation suites as data: cases are records of any shape, predicates are rows, gates are aggregates.

A suite is JSON lines; cases and responses stay VARIANT and are read by path, so a
case may expect anything and a response may lack anything. What a case expects
becomes a row for each predicate with the values wanted; all predicates of all
cases are then one pass of higher-order functions over the joined responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.operators import tables

#: Predicates: the path of what is expected, what it is held against, and how.
PREDICATES: dict[str, tuple[str, str]] = {
    "status": ("status", "equal"), "answer_state_in": ("answer_state", "in"), "min_citations": ("n_citations", "least"),
    "sources_any": ("search", "any"), "sources_all": ("search", "all"), "entities_all": ("search", "all"), "entities_any": ("search", "any"), "codes_any": ("search", "any"),
    "answer_contains_any": ("answer", "any"), "not_contains": ("search", "none"), "max_latency_seconds": ("latency", "most"), "max_sparse_ms": ("sparse_ms", "most"), "retrieval_backend_in": ("backend", "in"),
}
CITATION = "array<struct<source:string,source_file:string,text:string,chunk_id:string,document_id:string>>"
GATES = {"source_accuracy": 0.8, "code_hit_rate": 0.8, "entity_hit_rate": 0.8}


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _strings(record: Column, path: str) -> Column:
    """A list of strings at a path; one value is a list of one, none a list of null."""
    return F.coalesce(F.try_variant_get(record, path, "array<string>"), F.array(F.try_variant_get(record, path, "string")))


def suite(lines: DataFrame) -> DataFrame:
    """(id, kb_id, query, query_class, record, status) of lines(value); blank lines and comments are left out, bad ones have a status."""
    kept = lines.select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    read = kept.select("value", F.try_parse_json("value").alias("record"))
    field = lambda name: F.try_variant_get("record", f"$.{name}", "string")
    told = read.select(field("id").alias("id"), field("kb_id").alias("kb_id"), field("query").alias("query"), F.coalesce(field("query_class"), F.lit("unknown")).alias("query_class"), "record")
    lacks = (F.coalesce("kb_id", F.lit("")) == "") | (F.coalesce("query", F.lit("")) == "")
    status = F.when(F.col("record").isNull(), "invalid_json").when(lacks, "incomplete").otherwise("ok")
    return told.withColumn("status", status).withColumn("id", F.coalesce("id", "query"))


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """A suite's cases; a bad line stops it."""
    cases = suite(spark.read.text(path))
    bad = cases.where("status <> 'ok'").groupBy("status").count().collect()
    if bad:
        raise ValueError(", ".join(f"{r['count']} lines {r['status']}" for r in bad))
    return cases.drop("status")


def observed(responses: DataFrame) -> DataFrame:
    """responses(id, response) with what predicates are held against: status, answer, search, citations, latency and so on."""
    at = lambda path, kind="string": F.try_variant_get("response", f"$.{path}", kind)
    out = responses.withColumn("citations", F.coalesce(at("citations", CITATION), F.array().cast(CITATION)))
    cited = F.transform("citations", lambda c: norm(F.concat_ws(" ", c["source"], c["source_file"], c["text"], c["chunk_id"], c["document_id"])))
    state = "metadata.evidence_conversation_state"
    more = F.concat(*(F.coalesce(_strings(F.col("response"), f"$.{state}.{k}"), F.array().cast("array<string>")) for k in ("source_families", "document_ids", "section_ids", "entities")))
    return out.withColumn("cited", cited).select(
        "id", at("status").alias("status"), norm(at("answer")).alias("answer"), "cited", F.size("citations").alias("n_citations"),
        norm(F.concat_ws(" ", at("answer"), F.array_join("cited", " "), F.array_join(F.filter(more, lambda x: x.isNotNull()), " "))).alias("search"),
        F.coalesce(at("_runner_latency_seconds", "double"), F.lit(0.0)).alias("latency"), at("metadata.answer_state").alias("answer_state"),
        at("metadata.sparse_debug.total_ms", "double").alias("sparse_ms"), at("metadata.sparse_debug.lexical_backend").alias("backend"),
        F.coalesce(at("metadata.context_stats.final", "int"), F.lit(0)).alias("final"),
    )


def expectations(cases: DataFrame) -> DataFrame:
    """(id, predicate, wanted): a row for each predicate that a case sets; status is success where it is not set."""
    rows = [
        F.struct(F.lit(name).alias("predicate"), F.coalesce(_wanted(name), F.array(F.lit("success")) if name == "status" else F.array().cast("array<string>")).alias("wanted"))
        for name in PREDICATES
    ]
    return cases.select("id", F.inline(F.filter(F.array(*rows), lambda r: F.size(r["wanted"]) > 0)))


def _wanted(name: str) -> Column:
    """What a case expects of a predicate; null where it expects nothing."""
    found = F.filter(_strings(F.col("record"), f"$.expect.{name}"), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def _held(wanted: Column, against: str, how: str) -> Column:
    value, number = F.col(against), wanted[0].cast("double")
    has = lambda w: F.contains(value, norm(w))
    return {
        "equal": lambda: value.eqNullSafe(wanted[0]), "in": lambda: F.coalesce(F.array_contains(wanted, value), F.lit(False)), "least": lambda: value >= number, "most": lambda: F.coalesce(value <= number, F.lit(True)),
        "any": lambda: F.exists(wanted, has), "all": lambda: F.forall(wanted, has), "none": lambda: ~F.exists(wanted, has),
    }[how]()


def evaluate(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """One row a case: passed, failures by name, and the metrics of the gates. A case without a response fails its status."""
    seen = observed(responses)
    asked = expectations(cases).join(seen, "id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("search", "answer")}).withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))
    held = F.lit(None).cast("boolean")
    for name, (against, how) in PREDICATES.items():
        held = F.when(F.col("predicate") == name, _held(F.col("wanted"), against, how)).otherwise(held)
    judged = asked.withColumn("held", held)
    failed = judged.groupBy("id").agg(F.array_sort(F.collect_set(F.when(~F.col("held"), F.col("predicate")))).alias("failures"))
    want = lambda *names: F.concat(*(F.coalesce(_wanted(n), F.array().cast("array<string>")) for n in names))
    both = cases.select("id", "kb_id", "query_class", want("sources_any", "sources_all").alias("sources"), _wanted("codes_any").alias("codes"), _wanted("entities_any").alias("entities_any"), _wanted("entities_all").alias("entities_all")).join(seen, "id", "left")
    hit = lambda c: F.exists("sources", lambda s: (norm(s) != "") & F.contains(c, norm(s)))
    places = F.transform("cited", lambda c, i: F.when(hit(c), i + 1))
    rank = F.when(F.size("sources") > 0, F.array_min(F.array_compact(places)))
    has = lambda w: F.contains(F.coalesce("search", F.lit("")), norm(w))
    some, every = F.coalesce("entities_any", F.array().cast("array<string>")), F.coalesce("entities_all", F.array().cast("array<string>"))
    out = both.join(failed, "id").withColumn("source_rank", rank)
    return out.select(
        "id", "kb_id", "query_class", (F.size("failures") == 0).alias("passed"), "failures", F.coalesce("latency", F.lit(0.0)).alias("latency"), "sparse_ms", "source_rank",
        F.coalesce(F.round(1 / F.col("source_rank"), 3), F.lit(0.0)).alias("mrr"), (F.size("sources") > 0).alias("source_expected"), F.col("source_rank").isNotNull().alias("source_hit"),
        (F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0).alias("code_expected"), F.coalesce(F.exists("codes", has), F.lit(False)).alias("code_hit"),
        ((F.size(some) > 0) | (F.size(every) > 0)).alias("entity_expected"), (((F.size(some) > 0) | (F.size(every) > 0)) & F.forall(every, has) & ((F.size(some) == 0) | F.exists(some, has))).alias("entity_hit"),
        ((F.coalesce("n_citations", F.lit(0)) == 0) & (F.coalesce("final", F.lit(0)) == 0)).alias("no_evidence"), F.coalesce(F.col("answer_state") == "source_limited_answer", F.lit(False)).alias("source_limited"),
    )


def gate_metrics(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Totals, percentiles and hit rates of evaluated rows, over all ('all') or by a column."""
    key = F.col(by) if by else F.lit("all")
    keyed = rows.withColumn("group", key)
    rate = lambda hit, of: F.round(F.count_if(F.col(hit) & F.col(of)) / F.nullif(F.count_if(F.col(of)), F.lit(0)), 4)
    share = lambda c: F.round(F.count_if(F.col(c)) / F.count("*"), 4)
    out = keyed.groupBy("group").agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), rate("source_hit", "source_expected").alias("source_accuracy"), rate("code_hit", "code_expected").alias("code_hit_rate"),
        rate("entity_hit", "entity_expected").alias("entity_hit_rate"), F.round(F.avg(F.when(F.col("source_expected"), F.col("mrr"))), 4).alias("mrr"), share("no_evidence").alias("no_evidence_rate"), share("source_limited").alias("source_limited_rate"),
    )
    for name, value, at in (("latency_p50", "latency", 0.5), ("latency_p95", "latency", 0.95), ("latency_p99", "latency", 0.99), ("sparse_p50", "sparse_ms", 0.5), ("sparse_p95", "sparse_ms", 0.95)):
        out = out.join(tables.interpolated(keyed, "group", value, at).withColumnRenamed("percentile", name), "group", "left")
    return out


def gate_failures(metrics: DataFrame, slowest: float = 20.0, gates: dict[str, float] | None = None) -> DataFrame:
    """(group, gate, value, limit): gates that metrics do not meet; a metric that nothing was measured for meets its gate."""
    rows = [F.struct(F.lit("latency_p95").alias("gate"), F.col("latency_p95").alias("value"), F.lit(slowest).alias("limit"), (F.col("latency_p95") > slowest).alias("bad"))]
    rows += [F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.lit(least).alias("limit"), (F.col(g) < least).alias("bad")) for g, least in (gates or GATES).items()]
    rows += [F.struct(F.lit("cases").alias("gate"), F.col("failed").cast("double").alias("value"), F.lit(0.0).alias("limit"), (F.col("failed") > 0).alias("bad"))]
    return metrics.select("group", F.inline(F.filter(F.array(*rows), lambda r: F.coalesce(r["bad"], F.lit(False))))).drop("bad")


def regression_metrics(responses: DataFrame) -> DataFrame:
    """(metric, key, value) of responses(id, response): latencies, counts by answer and admission state, mean citations and words, token limits."""
    at = lambda path, kind="string": F.try_variant_get("response", f"$.{path}", kind)
    rows = responses.select(
        at("_runner_latency_seconds", "double").alias("latency"), F.coalesce(at("metadata.answer_state"), F.lit("missing")).alias("answer_state"), F.coalesce(at("metadata.evidence_admission.admission_status"), F.lit("missing")).alias("admission"),
        F.size(F.coalesce(at("citations", "array<variant>"), F.array().cast("array<variant>"))).alias("citations"), F.size(F.filter(F.split(F.coalesce(at("answer"), F.lit("")), r"\s+"), lambda w: w != "")).alias("words"),
        at("metadata.generation_decision.max_tokens", "int").alias("tokens"), F.lit("all").alias("one"),
    )
    states = rows.select(F.inline(F.array(F.struct(F.lit("answer_states").alias("metric"), F.col("answer_state").alias("key")), F.struct(F.lit("admission").alias("metric"), F.col("admission").alias("key"))))).groupBy("metric", "key").agg(F.count("*").cast("double").alias("value"))
    names = {"latency_count": F.count("latency"), "latency_max": F.max("latency"), "citation_count_avg": F.round(F.avg("citations"), 3), "answer_words_avg": F.round(F.avg("words"), 3), "tokens_min": F.min("tokens"), "tokens_max": F.max("tokens"), "tokens_avg": F.round(F.avg("tokens"), 3)}
    once = rows.agg(*(c.cast("double").alias(n) for n, c in names.items()))
    flat = once.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.lit("all").alias("key"), F.col(n).alias("value")) for n in names))))
    for name, share in (("latency_p50", 0.5), ("latency_p95", 0.95)):
        flat = flat.unionByName(tables.interpolated(rows, "one", "latency", share).select(F.lit(name).alias("metric"), F.col("one").alias("key"), F.col("percentile").alias("value")))
    return states.unionByName(flat)


def canary(metrics: DataFrame, baseline: DataFrame, least_pass: float = 0.9, least_accuracy: float = 0.9, slowest: float = 20.0, drop: float = 0.02, slower: float = 2.0) -> DataFrame:
    """Whether each group of metrics may go to a canary, against a baseline of one row; blockers name all that is against it.

    A measure that a side lacks blocks nothing, but a group without any case has a pass rate of 0.
    """
    rate = lambda: F.coalesce(F.round(F.col("passed") / F.nullif(F.col("total"), F.lit(0)), 4), F.lit(0.0))
    now = metrics.withColumn("pass_rate", rate())
    then = baseline.select(F.struct(rate().alias("pass_rate"), "source_accuracy", "latency_p95").alias("then")).limit(1)
    both = now.join(F.broadcast(then), F.lit(True), "left")  # the one row of the baseline
    moved = both.select("*", *(F.round(F.col(c) - F.col(f"then.{c}"), 4).alias(f"{c}_delta") for c in ("pass_rate", "source_accuracy", "latency_p95")))
    against = {
        "retrieval_gate_failed": F.col("failed") > 0, "hard_pass_rate_below_threshold": F.col("pass_rate") < least_pass, "hard_source_accuracy_below_threshold": F.col("source_accuracy") < least_accuracy,
        "hard_latency_p95_above_threshold": F.col("latency_p95") > slowest, "source_accuracy_regressed_vs_baseline": F.col("source_accuracy_delta") < -drop,
        "pass_rate_regressed_vs_baseline": F.col("pass_rate_delta") < -drop, "latency_regressed_vs_baseline": F.col("latency_p95_delta") > slower,
    }
    blockers = F.array_compact(F.array(*(F.when(bad, code) for code, bad in against.items())))
    told = moved.withColumn("blockers", blockers)
    return told.select("group", "pass_rate", "source_accuracy", "latency_p95", "pass_rate_delta", "source_accuracy_delta", "latency_p95_delta", "blockers", (F.size("blockers") == 0).alias("eligible"))
