"""Structured answers, sessions, operations metrics and table maintenance, as joins, aggregations and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestream.functions import text as T


# Structured answers over texts


def entity_counts(docs: DataFrame, entities: list[str], keep: list[str]) -> DataFrame:
    """docs with one mention count for each entity, m0, m1, ...; only documents that name all of them."""
    out = docs.select(*keep, *(T.mentions(F.col("text"), e).alias(f"m{i}") for i, e in enumerate(entities)))
    return out.where(reduce(lambda a, b: a & b, [F.col(f"m{i}") > 0 for i in range(len(entities))]))


def both_counts(docs: DataFrame, entities: list[str], keep: list[str]) -> DataFrame:
    """docs that name all entities, with the least of their counts."""
    found = entity_counts(docs, entities, keep)
    counts = [F.col(f"m{i}") for i in range(len(entities))]
    return found.select(*keep, (F.least(*counts) if len(counts) > 1 else counts[0]).alias("mentions"))


def snippets(docs: DataFrame, keyword: str, width: int = 300) -> DataFrame:
    """(doc_id, place, snippet) of the first place of a keyword in each text that holds it, whatever its case."""
    at = F.instr(F.lower("text"), keyword.lower())
    return docs.where(at > 0).select("doc_id", at.alias("place"), F.col("text").substr(F.greatest(F.lit(1), at - width // 2), F.lit(width)).alias("snippet"))


def structured_citations(found: DataFrame) -> DataFrame:
    """Per source of found(source, page, text, pos): hits, pages and first snippet; most hits first."""
    per = found.groupBy("source").agg(F.count("*").alias("hits"), F.array_sort(F.collect_set("page")).alias("pages"), F.min_by(F.substring("text", 1, 300), "pos").alias("snippet"))
    return per.withColumn("citation", F.row_number().over(Window.orderBy(F.desc("hits"), "source")))  # one row for each source


# Sessions


def recent_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last n turns of each conversation, numbered from the oldest of them."""
    last = turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= n)
    return last.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("back")


def history_search(turns: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """Of earlier turns of the same conversation, the k that share most of the words of asked(conv_id, turn, text)."""
    bag = lambda c: F.array_distinct(T.tokens(F.col(c)))
    q = asked.select("conv_id", F.col("turn").alias("asked_turn"), bag("text").alias("q")).where(F.size("q") > 0)
    both = turns.select("conv_id", "turn", bag("text").alias("d")).join(q, "conv_id").where("turn < asked_turn")
    scored = both.select("conv_id", "asked_turn", "turn", F.round(F.size(F.array_intersect("q", "d")) / F.size("q"), 6).alias("score")).where("score > 0")
    order = Window.partitionBy("conv_id", "asked_turn").orderBy(F.desc("score"), F.desc("turn"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def follow_up_class(query: Column) -> Column:
    """What kind of turn a question is: meta, clarification, formatting, continuation, new."""
    q = F.trim(F.lower(F.regexp_replace(query, "[‘’]", "'")))
    short = F.size(T.words(q)) < 8
    return (
        F.when(q.rlike(r"\b(first|last|previous) (question|query)\b|what (did|have) (i|we) (ask|discuss)|summari[sz]e (our|the|this) conversation"), "meta")
        .when(q.rlike(r"what do you mean|clarify|don't understand|rephrase|what does that mean"), "clarification")
        .when(q.rlike(r"bullet points?|as a (table|list)|shorter|in (one|two|three) sentences?|reformat"), "formatting")
        .when(q.rlike(r"^(tell me more|more details|go on|continue|what about|how about|and |also )") | short & q.rlike(r"^(it|he|she|they|this|that|these|those|his|her|their)\b"), "continuation")
        .otherwise("new")
    )


def query_verdict(query: Column, longest: int = 4000) -> Column:
    """Validation of a query: ok, empty, too_long, unsafe, symbols, generic."""
    q = F.trim(F.coalesce(query, F.lit("")))
    content = F.filter(T.words(F.lower(q)), lambda w: ~w.isin(T.STOPWORDS) & (F.length(w) > 2))
    return (
        F.when(F.length(q) == 0, "empty")
        .when(F.length(q) > longest, "too_long")
        .when(q.rlike(r"(?i)<script|javascript:|eval\(|exec\("), "unsafe")
        .when(~q.rlike(r"[\p{L}\p{N}_]"), "symbols")
        .when((F.length(q) < 3) | (F.size(content) == 0) | (F.size(T.words(q)) <= 3) & (F.size(content) <= 1), "generic")
        .otherwise("ok")
    )


# Operations metrics


def latency_by(events: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, p50, p95 and maximum of a value by group, percentiles by linear interpolation."""
    out = events.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("largest"))
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        out = out.join(interpolated(events, group, value, share).withColumnRenamed("percentile", name), group, "left")
    return out.select(group, "n", "mean", "p50", "p95", "largest")


def nearest_rank(events: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """Percentile by nearest rank: the value at index round((n - 1) share), half to even. Windows run over distinct values."""
    counts = events.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    at = F.bround((F.sum("n").over(w) - 1) * share).cast("long")
    placed = counts.select(group, value, "n", F.sum("n").over(w.orderBy(value)).alias("upto"), at.alias("index"))
    return placed.where((F.col("index") < F.col("upto")) & (F.col("index") >= F.col("upto") - F.col("n"))).select(group, F.col(value).alias("percentile"))


def interpolated(events: DataFrame, group: str, value: str, share: float, digits: int = 3) -> DataFrame:
    """(group, percentile) by linear interpolation between the two nearest values. Windows run over distinct values."""
    counts = events.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    placed = counts.select(group, value, "n", F.sum("n").over(w.orderBy(value)).alias("upto"), ((F.sum("n").over(w) - 1) * share).alias("at"), (F.sum("n").over(w) - 1).alias("last"))
    inside = lambda i: (i < F.col("upto")) & (i >= F.col("upto") - F.col("n"))
    low = F.floor("at")
    ends = placed.groupBy(group).agg(F.max(F.when(inside(low), F.col(value))).alias("low"), F.max(F.when(inside(F.least(low + 1, F.col("last"))), F.col(value))).alias("high"), F.max(F.col("at") - low).alias("part"))
    return ends.select(group, F.round((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"), digits).alias("percentile"))


def newest(events: DataFrame, n: int, group: str, order: str, tie: str) -> DataFrame:
    """The newest n events of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc(tie))
    return events.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def alerts(events: DataFrame, group: str, bad: Column, limit: float, recent: int = 50, enough: int = 20) -> DataFrame:
    """Per group, the rate of bad among the newest against the rest: threshold max(limit, 2 b + 0.05) where the rest is enough."""
    w = Window.partitionBy(group).orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = events.withColumn("new", F.row_number().over(w) <= recent).withColumn("bad", bad)
    out = ranked.groupBy(group).agg(
        F.avg(F.when(F.col("new"), F.col("bad").cast("double"))).alias("rate"),
        F.avg(F.when(~F.col("new"), F.col("bad").cast("double"))).alias("before"),
        F.count_if(~F.col("new")).alias("n_before"),
    )
    top = F.when(F.col("n_before") >= enough, F.greatest(F.lit(limit), 2 * F.col("before") + 0.05)).otherwise(F.lit(limit))
    out = out.withColumn("threshold", F.round(top, 6)).withColumn("alert", F.col("rate") > F.col("threshold"))
    return out.select(group, F.round("rate", 6).alias("rate"), F.round("before", 6).alias("before"), "n_before", "threshold", "alert")


def sessions(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """(key, session, started, ended, n): runs of events with no longer pause."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    new = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


# Table maintenance


def classify_changes(listing: DataFrame, tracker: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, modified, deleted or unchanged, from one full outer join."""
    a = listing.select(key, F.col(digest).alias("now"), F.lit(True).alias("listed"))
    b = tracker.select(key, F.col(digest).alias("then"), F.lit(True).alias("tracked"))
    change = F.when(F.col("tracked").isNull(), "new").when(F.col("listed").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("then")), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def visible(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of the committed version of each file: versions(file_uuid, ingest_version, state) is the pointer."""
    ready = versions.where("state = 'ready'").groupBy("file_uuid").agg(F.max("ingest_version").alias("ingest_version"))
    return chunks.join(ready, ["file_uuid", "ingest_version"], "left_semi")


def kept_after_delete(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows for which `gone` is not true; a null condition deletes nothing."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def keep_one_job(rows: DataFrame, file: str, job: str, keep: DataFrame) -> DataFrame:
    """Of files named in keep(file, job) only the rows of that job; rows of them with a null job go, other files stay."""
    known = keep.select(F.col(file).alias("file_"), F.col(job).alias("job_"))
    return rows.join(known, F.col(file) == F.col("file_"), "left").where(F.col("file_").isNull() | (F.col(job) == F.col("job_"))).select(*rows.columns)


def update_where(rows: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """rows with the given columns set where the condition is true."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) if c in rows.columns else F.when(condition, v) for c, v in changes.items()})


def commit_job(rows: DataFrame, file: str, job: str, staged: DataFrame) -> DataFrame:
    """state 'staging' to 'ready' where (file, job) is among staged."""
    marks = staged.select(file, job).distinct().withColumn("listed_", F.lit(True))
    return rows.join(marks, [file, job], "left").withColumn("state", F.when(F.col("listed_") & (F.col("state") == "staging"), "ready").otherwise(F.col("state"))).drop("listed_")


def one_path_per_file(tracker: DataFrame, file: str, path: str) -> DataFrame:
    """The least path of each file id."""
    return tracker.groupBy(file).agg(F.min(path).alias(path))


def newest_accessed(cache: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """What a least-recently-used cache of n entries holds: the n keys used last, ties by key."""
    return cache.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(n)


def matches_any(values: Column, wanted: list[str]) -> Column:
    """Whether an array holds any of the wanted values."""
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def keyword_match(query: str, content: Column, shortest: int = 3) -> Column:
    """Whether a text holds the query, or any of its words of three characters or more, in any case."""
    low = F.lower(content)
    found = low.contains(query.lower())
    for w in query.lower().split():
        found = found | low.contains(w) if len(w) >= shortest else found
    return found


def prefix_search(docs: DataFrame, terms: list[str], k: int = 50) -> DataFrame:
    """(doc_id, hits, rank, scaled) of docs(doc_id, text) in which every term begins a token; any term where none has all.

    hits: tokens that begin with a term; scaled: 1 for the first, 0 for the last of those returned.
    """
    bag = docs.select("doc_id", T.tokens(F.col("text")).alias("bag"))

    def begun(term: str) -> Column:
        return F.size(F.filter("bag", lambda t: t.startswith(term)))

    counts = [begun(x) for x in terms]
    found = bag.select("doc_id", reduce(lambda a, b: a + b, counts).alias("hits"), reduce(lambda a, b: a & b, [c > 0 for c in counts]).alias("whole")).where("hits > 0")
    every = found.agg(F.coalesce(F.bool_or("whole"), F.lit(False)).alias("any_whole"))
    best = found.crossJoin(F.broadcast(every)).where("whole or not any_whole").orderBy(F.desc("hits"), "doc_id").limit(k)  # every is one row
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "doc_id")))  # of k rows
    span = F.max("rank").over(Window.partitionBy()) - 1
    return ranked.select("doc_id", F.col("hits").cast("long").alias("hits"), F.col("rank").cast("long").alias("rank"), F.round(1 - (F.col("rank") - 1) / F.greatest(span, F.lit(1e-9)), 6).alias("scaled"))


def retained_turns(turns: DataFrame, most: int) -> DataFrame:
    """The last turns of each conversation with ids that go on rising when older turns were trimmed."""
    w = Window.partitionBy("conv_id")
    numbered = turns.withColumn("turn_id", F.row_number().over(w.orderBy("turn"))).withColumn("n_turns", F.count("*").over(w))
    return numbered.where(F.col("turn_id") > F.col("n_turns") - most).drop("n_turns")


def cited_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, n, source): citations [n] of answers(answer_id, text) joined to sources(answer_id, nth, source); others are invalid and go."""
    named = answers.select("answer_id", F.explode(T.citations(F.col("text"))).alias("n"))
    return named.join(sources.withColumnRenamed("nth", "n"), ["answer_id", "n"])


def first_expected(ranked: DataFrame, expected: DataFrame, per: str, item: str) -> DataFrame:
    """Per query of ranked(per, item, rank) and expected(per, item): the first rank of an expected item and its reciprocal, null and 0 without one."""
    hits = ranked.join(expected.select(per, item).distinct(), [per, item]).groupBy(per).agg(F.min("rank").alias("first_rank"))
    return ranked.select(per).distinct().join(hits, per, "left").withColumn("reciprocal", F.coalesce(F.round(1 / F.col("first_rank"), 6), F.lit(0.0)))


def metric_deltas(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """(key, now, before, delta) of two metric tables; the delta is null where either lacks the metric."""
    a, b = now.select(key, F.col(value).alias("now")), before.select(key, F.col(value).alias("before"))
    return a.join(b, key, "full_outer").withColumn("delta", F.round(F.col("now") - F.col("before"), 6))
