"""Topics that guard what may be evidence: which topic a question falls under, which hits it admits, what makes up for those lost.

A topic is a mapping with topic_id, triggers and, where wanted, attributes, sources,
contents (patterns, all compared after `folded`) and extra (hits that may be added, 5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a question that leans on earlier turns looks like; intents that need exact evidence; penalties.
LEANING = (
    r"\b(?:this|that|it|these|those|previous|above|same|last answer|your answer|what you said|what you meant)\b",
    r"^(?:more|continue|go on|elaborate|expand|explain)\b", r"^(?:what|how|same)\s+(?:about|for)\b",
)
EXACT_INTENTS = ("requirement", "missing_detail")
OTHER_TOPIC, OTHER_FAMILY = -0.08, -0.05


def folded(text: Column) -> Column:
    """Lower case, with one space for each run of anything but a-z, 0-9, the section sign and full stops."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9§.]+", " ")


def leans_on_history(query: Column) -> Column:
    q = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"^\s+|\s+$", "")
    return q.rlike("|".join(LEANING))


def _holds(text: Column, patterns: list[str]) -> Column:
    """Whether folded text holds a pattern; blank patterns match nothing."""
    usable = [p for p in patterns if p.strip()]
    found = F.lit(False)
    for p in usable:
        found = found | (F.contains(text, folded(F.lit(p))) & (folded(F.lit(p)) != ""))
    return found


def topic(query: Column, history: Column, topics: list[dict]) -> Column:
    """Struct of topic_id and confidence, or null: the surest topic whose trigger is in the query, or in the history of one that leans on it.

    0.75 by a trigger; where a topic has attributes 0.95 with one of them in the query and 0.65 without. Of equals the first.
    """
    own = folded(query)
    told = F.nullif(folded(history), F.lit(""))
    seen = F.concat_ws(" ", F.nullif(own, F.lit("")), F.when(leans_on_history(query), told))
    found = F.lit(None).cast("struct<topic_id:string,confidence:double>")
    for t in reversed([t for t in topics if t.get("topic_id", "").strip()]):
        sure = F.when(_holds(own, t["attributes"]), 0.95).otherwise(0.65) if t.get("attributes") else F.lit(0.75)
        this = F.struct(F.lit(t["topic_id"].strip()).alias("topic_id"), sure.alias("confidence"))
        found = F.when(_holds(seen, t.get("triggers") or []) & (F.coalesce(found["confidence"], F.lit(0.0)) <= sure), this).otherwise(found)
    return found


def turn_topics(turns: DataFrame, topics: list[dict], back: int = 3) -> DataFrame:
    """(conv_id, turn, topic_id, confidence) of turns(conv_id, turn, text), the `back` turns before being the history; null where none."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    history = F.concat_ws(" ", *(F.lag("text", n).over(w) for n in range(back, 0, -1)))
    return turns.select("conv_id", "turn", "text", history.alias("history")).select("conv_id", "turn", topic(F.col("text"), F.col("history"), topics).alias("t")).select("conv_id", "turn", "t.topic_id", "t.confidence")


def belongs(topic_id: Column, source: Column, text: Column, topics: list[dict]) -> Column:
    """Whether a hit belongs to a topic: by source or content where it has patterns for them, always where it has neither."""
    out = F.lit(True)
    for t in topics:
        by = [_holds(folded(place), t[name]) for place, name in ((source, "sources"), (text, "contents")) if t.get(name)]
        if by:
            out = F.when(topic_id == t["topic_id"], by[0] | by[1] if len(by) == 2 else by[0]).otherwise(out)
    return out


def guard(hits: DataFrame, topics: list[dict]) -> DataFrame:
    """Those of hits(query_id, topic_id, source, text) that belong to the topic of their query; all where it has none."""
    return hits.where(F.col("topic_id").isNull() | belongs(F.col("topic_id"), F.col("source"), F.col("text"), topics))


def guard_report(hits: DataFrame, topics: list[dict]) -> DataFrame:
    """(query_id, topic_id, n_hits, n_matched, n_removed, strict_no_match): how the guard went for each query that has hits."""
    own = F.col("topic_id").isNull() | belongs(F.col("topic_id"), F.col("source"), F.col("text"), topics)
    per = hits.groupBy("query_id", "topic_id").agg(F.count("*").alias("n_hits"), F.count_if(own).alias("n_matched"))
    return per.withColumns({"n_removed": F.col("n_hits") - F.col("n_matched"), "strict_no_match": F.col("n_matched") == 0})


def supplemented(primary: DataFrame, candidates: DataFrame, topics: list[dict]) -> DataFrame:
    """primary, then the first candidates of the query's topic that it lacks, as many as the topic allows; both (query_id, topic_id, source, doc_id, text, rank).

    Hits are the same by folded source and doc_id. A query without a topic gets nothing. `added` marks the new ones.
    """
    key = ["query_id", "key_"]
    keyed = lambda rows: rows.withColumn("key_", F.concat_ws("::", folded(F.col("source")), F.col("doc_id").cast("string")))
    mine = candidates.where(F.col("topic_id").isNotNull() & belongs(F.col("topic_id"), F.col("source"), F.col("text"), topics))
    first = Window.partitionBy(*key).orderBy("rank", "doc_id")
    new = keyed(mine).join(keyed(primary).select(*key), key, "left_anti").withColumn("nth_", F.row_number().over(first)).where("nth_ = 1")
    allowed = F.lit(5)
    for t in topics:
        allowed = F.when(F.col("topic_id") == t["topic_id"], t.get("extra", 5)).otherwise(allowed)
    new = new.withColumn("nth_", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("nth_") <= allowed)
    return primary.withColumn("added", F.lit(False)).unionByName(new.select(*primary.columns, F.lit(True).alias("added")))


def suppression(intent: Column, exact: Column, matches: Column, facets: Column, own_facets: Column, topics: Column, family: Column) -> Column:
    """Penalty for a hit on a query that needs exact evidence (by intent or mark): none where it matches exactly or shares a facet, else by topic or source family."""
    none = lambda a: F.coalesce(F.size(a) <= 0, F.lit(True))
    needs = F.coalesce(intent.isin(*EXACT_INTENTS), F.lit(False)) | F.coalesce(exact, F.lit(False))
    shared = F.coalesce(F.arrays_overlap(facets, own_facets), F.lit(False))
    return (
        F.when(~needs | F.coalesce(matches, F.lit(False)) | shared, 0.0).when(~none(topics), OTHER_TOPIC)
        .when(F.coalesce(family, F.lit("")) != "", OTHER_FAMILY).otherwise(0.0)
    )
