"""Searches that relax by stages, as one plan for all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relaxed(hits: DataFrame, enough: int = 3, most: int = 50) -> DataFrame:
    """(query_id, item, place, stage, won) of hits(query_id, stage, rank, item), stages from 0.

    Stages are taken in order until `enough` different items are there; each item
    counts at its first stage. won: the stage that reached it, else the first with
    any item. place: from 1, by stage and rank, `most` at most.
    """
    first = hits.groupBy("query_id", "item").agg(F.min(F.struct("stage", "rank")).alias("at")).select("query_id", "item", "at.*")
    per = first.groupBy("query_id", "stage").agg(F.count("*").alias("n"))
    sofar = per.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy("stage")))
    won = sofar.groupBy("query_id").agg(F.min(F.when(F.col("upto") >= enough, F.col("stage"))).alias("reached"))
    label = hits.groupBy("query_id").agg(F.min("stage").alias("any_"))
    known = won.join(label, "query_id").select("query_id", F.coalesce("reached", "any_").alias("won"), F.coalesce("reached", F.lit(1 << 30)).alias("last_"))
    kept = first.join(known, "query_id").where(F.col("stage") <= F.col("last_"))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "rank", "item")))
    return placed.where(F.col("place") <= most).select("query_id", "item", "place", "stage", "won")


def exact_snippets(chunks: DataFrame, keyword: str, people: Column, most: int = 10, width: int = 300) -> DataFrame:
    """(file, chunk, snippet, relaxed) of chunks(file, chunk, text) that hold a keyword in any case, the first `most` by file and chunk.

    Only chunks of the people asked for; where none of those holds it, of all. A chunk given twice counts once.
    """
    at = F.instr(F.lower("text"), keyword.lower())
    found = chunks.where(at > 0).select("file", "chunk", F.substring("text", 1, width).alias("snippet"), F.coalesce(people, F.lit(False)).alias("theirs"))
    once = found.groupBy("file", "chunk").agg(F.max("theirs").alias("theirs"), F.min("snippet").alias("snippet"))
    any_ = once.agg(F.coalesce(F.bool_or("theirs"), F.lit(False)).alias("any_"))
    both = once.crossJoin(F.broadcast(any_))  # one row
    return both.where("theirs or not any_").orderBy("file", "chunk").limit(most).select("file", "chunk", "snippet", (~F.col("any_")).alias("relaxed"))
