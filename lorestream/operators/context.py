"""Contexts and conversations put in order: display order by strategy, merged citations, names once each, what a conversation was about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestream.operators import retrieval

#: Fields of a hit that may date it; the first that is not blank counts.
DATES = ("timestamp", "date", "created_at", "modified_at")
STRATEGIES = ("relevance", "chronological", "lost_in_middle")


def ordered(hits: DataFrame, strategy: str = "relevance", per: str = "query_id") -> DataFrame:
    """hits(per, rank, doc_id, any of DATES as strings) with display_order from 1 and ordering_strategy.

    By relevance as ranked; chronologically by date as text, then rank, undated last; or
    best at both ends. Equal ranks go by doc_id. An unknown strategy orders by relevance.
    """
    w = Window.partitionBy(per)
    ranked = hits.withColumn("display_order", F.row_number().over(w.orderBy("rank", "doc_id")))
    if strategy == "chronological":
        fields = [F.nullif(F.col(c), F.lit("")) for c in DATES if c in hits.columns]
        when = F.coalesce(*fields) if fields else F.lit(None).cast("string")
        ranked = ranked.withColumn("display_order", F.row_number().over(w.orderBy(F.asc_nulls_last(when), "rank", "doc_id")))
    elif strategy == "lost_in_middle":
        moved = retrieval.lost_in_middle(ranked.withColumnRenamed("rank", "rank_").withColumnRenamed("display_order", "rank"), per)
        ranked = moved.withColumn("display_order", F.col("place") + 1).drop("place", "rank").withColumnRenamed("rank_", "rank")
    return ranked.withColumn("ordering_strategy", F.lit(strategy))


def merged_citations(primary: DataFrame, secondary: DataFrame, per: str = "query_id") -> DataFrame:
    """Citations (per, source, nth, ...) of both lists, primary first, one for each source whatever its case; `citation` counts them from 1.

    Sources are trimmed, blank ones left out; columns that one list lacks are null. nth is a list's own order.
    """
    both = primary.withColumn("list_", F.lit(0)).unionByName(secondary.withColumn("list_", F.lit(1)), allowMissingColumns=True)
    named = both.withColumn("source", F.regexp_replace("source", r"^\s+|\s+$", "")).where("source <> ''").withColumn("key_", F.lower("source"))
    first = named.withColumn("seen_", F.row_number().over(Window.partitionBy(per, "key_").orderBy("list_", "nth"))).where("seen_ = 1")
    return first.withColumn("citation", F.row_number().over(Window.partitionBy(per).orderBy("list_", "nth", "key_"))).drop("list_", "key_", "seen_", "nth")


def distinct_names(names: Column) -> Column:
    """Names of an array once each whatever their case and outer space, as first written, in order; blank and null ones left out. For lists as long as a question's."""
    bare = F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"^\s+|\s+$", "")), lambda n: F.coalesce(n != "", F.lit(False)))
    low = F.transform(bare, F.lower)
    return F.filter(bare, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)


def conversation_summaries(turns: DataFrame, entities: Column, longest: int = 500, per: str = "conv_id") -> DataFrame:
    """(per, n_turns, n_entities, summary) of turns(per, turn, query): the first ten entities by name, turns, the last three queries.

    A summary over `longest` characters is cut at its last space within them, or there if it has none. Only ten
    entities and three queries of a conversation ever come together; turns that tie go by query.
    """
    named = turns.select(per, F.explode(F.array_distinct(entities)).alias("entity")).where("entity <> ''").distinct()
    n_named = named.groupBy(per).agg(F.count("*").alias("n_entities"))
    ten = named.withColumn("nth", F.row_number().over(Window.partitionBy(per).orderBy("entity"))).where("nth <= 10")
    topics = ten.groupBy(per).agg(F.array_join(F.array_sort(F.collect_list("entity")), ", ").alias("topics"))
    asked = turns.select(per, "turn", F.coalesce("query", F.lit("")).alias("query"))
    last = asked.withColumn("back", F.row_number().over(Window.partitionBy(per).orderBy(F.desc("turn"), F.desc("query")))).where("back <= 3")
    recent = last.groupBy(per).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("back"), "query"))), lambda x: x["query"]), "; ").alias("recent"))
    out = turns.groupBy(per).agg(F.count("*").alias("n_turns")).join(n_named, per, "left").join(topics, per, "left").join(recent, per, "left")
    told = F.concat_ws(". ", F.concat(F.lit("Topics discussed: "), "topics"), F.concat(F.lit("Conversation length: "), F.col("n_turns").cast("string"), F.lit(" turns")), F.concat(F.lit("Recent questions: "), "recent"))
    cut = F.concat(F.regexp_replace(F.substring(told, 1, longest), r" [^ ]*$", ""), F.lit("..."))
    return out.select(per, "n_turns", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.when(F.length(told) > longest, cut).otherwise(told).alias("summary"))
