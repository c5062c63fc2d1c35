"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt by hash into blocks of about `block_words` words.
Its target, in words, is made up of whole epochs of all its blocks, then of
blocks in permuted order, then of documents in permuted order within the one
block that the target ends in, whose last document is cut. These block copies
are quotas, exact per source. The tree halves the output shards again and again;
at each node the quotas that go left are one multivariate-hypergeometric draw,
so shards get what dealing all block copies blindly would give them, while every
block copy is used exactly once. Each shard then shuffles its copies locally.

Only block totals (one row for each 2^20 words or so) and, for one block a
source, document sizes are ordered, block totals in slots of the order; a
source's documents are never gathered, so one source may hold most rows. The
tree sees one row per source with a number for each shard: sources times shards
is to fit a task. Everything derives from hashes and a seed: reruns agree. What
the plan says of sources, blocks and the rows of last blocks is broadcast where
it has at most 65,536 rows and joined by shuffle otherwise.

Edge cases: null source is a source, last in order; null or wordless texts have
size 0 and are taken whole in every epoch their block is; an empty table gives
an empty result; rows that repeat doc_id, source and text are separate rows that
share a block and take alike where a target ends in it, so a target may stay
short by less than their number; different texts under one doc_id are separate
in all; other columns pass through `mix` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestream.llm.common import WORD, byte_slices, discard, materialize, steady

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def count_words(texts: pa.Array) -> np.ndarray:
    """Words of each text of an Arrow string array; 0 for null."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    out = np.zeros(len(texts), dtype=np.int64)
    if len(data):
        blank = _SPACE[data]
        begins = ~blank
        begins[1:] &= blank[:-1]
        first = offsets[:-1] - offsets[0]
        some = offsets[1:] > offsets[:-1]
        begins[first[some]] = ~blank[first[some]]
        sums = np.concatenate([[0], np.cumsum(begins)])
        out = sums[offsets[1:] - offsets[0]] - sums[first]
    if texts.null_count:
        out = np.where(texts.is_valid().to_numpy(zero_copy_only=False), out, 0)
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in byte_slices(batches):
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "tag")), pa.array(count_words(b.column("text")))], names=["doc_id", "source", "tag", "size"])


#: A source as a key that is never null, and a hash of the text, which tells rows of one doc_id apart.
KEY, TAG = "coalesce('=' || source, 'null')", "xxhash64(coalesce(text, ''))"


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tag, key, size in words) of docs(doc_id, source, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.expr(TAG).alias("tag"), "text")
    return own.mapInArrow(_sizes, "doc_id long, source string, tag long, size long").withColumn("key", F.expr(KEY))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, source_size, target) of sizes(source, size).

    Sources in order, null last, weigh `weights` in turn and share all words;
    no target exceeds `limit` times its source, and what is over is shared again
    by weight. With level L, target = min(limit * size, weight * L); of sources in
    order of limit * size / weight, L is the greatest of (all - caps before) /
    (weights from here on).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", turn).withColumn("cap", F.col("source_size") * limit)
    ranked = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    before = F.sum("cap").over(ranked) - F.col("cap")
    after = F.sum("weight").over(all_) - F.sum("weight").over(ranked) + F.col("weight")
    per = per.withColumn("level", (F.sum("source_size").over(all_) - before) / after).withColumn("level", F.max("level").over(all_))
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas[source] block copies over shards: an array [source, shard] with these row sums.

    Each node of the tree has a generator of its own, so a node's draw does not
    depend on the others. Shards differ by one block copy at most.
    """
    out = np.zeros((len(quotas), shards), dtype=np.int64)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        lo, hi, have = nodes.pop()
        if hi - lo == 1:
            out[:, lo] = have
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        ends = [total * (s - lo) // (hi - lo) for s in (lo, mid)]
        take = ends[1] - ends[0]
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals") if total else have * 0
        nodes += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _tree(shards: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key").reset_index(drop=True)
        dealt = split_quotas(rows["copies"].to_numpy(), shards, seed)
        return pd.DataFrame({"key": rows["key"], "until": list(dealt.cumsum(axis=1))})

    return run


def _before(rows: DataFrame, order: Column, value: Column, slots: int = 10) -> DataFrame:
    """rows with `before`: the sum of value over rows of the same key that come earlier by order, a 64-bit hash.

    Rows of a key are summed in 2^slots slots of the order, so no task has all of them.
    """
    cut = rows.withColumn("order", order).withColumn("slot", F.shiftright("order", 64 - slots)).withColumn("value", value)
    sums = cut.groupBy("key", "slot").agg(F.sum("value").alias("sum"))
    sums = sums.select("key", "slot", (F.sum("sum").over(Window.partitionBy("key").orderBy("slot")) - F.col("sum")).alias("ahead"))
    inside = Window.partitionBy("key", "slot").orderBy("order", *(c for c in ("block", "epoch") if c in rows.columns))
    out = cut.withColumn("inside", F.sum("value").over(inside) - F.col("value")).join(sums, ["key", "slot"])
    return out.withColumn("before", F.col("ahead") + F.col("inside")).drop("order", "slot", "value", "ahead", "inside")


def _bounded(table: DataFrame, most: int = 1 << 16) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= most else table


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tag"), "parts")


def _dealt(docs: DataFrame, weights: tuple[int, ...], limit: int, shards: int, block_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables that tell each row's copies: sizes (a row each), sources, blocks, and rows of blocks that targets end in."""
    sizes = materialize(with_sizes(steady(docs)), "sizes")
    goal = targets(sizes, weights, limit).select(
        F.expr(KEY).alias("key"), "source_size", "target", F.round("target").cast("long").alias("quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long").alias("parts")
    )
    goal = _bounded(materialize(goal, "sources"))
    rows = sizes.join(goal, "key").withColumn("block", _block(seed))

    # A row for each block: how often all of it is used, and how many words of it once more.
    once = F.greatest(F.col("source_size"), F.lit(1))
    blocks = rows.groupBy("key", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("quota").alias("quota"))
    blocks = _before(blocks.withColumn("epochs", F.expr("quota div greatest(source_size, 1)")), F.xxhash64(F.lit(seed + 1), "key", "block"), F.col("words"))
    blocks = blocks.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("words"), F.col("quota") - F.col("epochs") * once - F.col("before"))))
    blocks = blocks.withColumn("uses", F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)).where("uses > 0")
    blocks = materialize(blocks.select("key", "block", "words", "epochs", "rest", "uses"), "blocks")

    # Its copies, permuted, are dealt to shards by the quotas of the tree.
    shares = blocks.groupBy("key").agg(F.sum("uses").alias("copies")).groupBy(F.lit(0).alias("root")).applyInPandas(_tree(shards, seed), "key string, until array<long>")
    copies = blocks.select("*", F.explode(F.expr("sequence(1, uses)")).alias("epoch"))
    copies = _before(copies, F.xxhash64(F.lit(seed + 2), "key", "block", "epoch"), F.lit(1)).join(shares, "key")
    copies = copies.withColumn("shard", F.expr("size(filter(until, u -> u <= before))"))
    dealt = copies.groupBy("key", "block", "words", "epochs", "rest").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("uses"))
    dealt = materialize(dealt, "dealt")

    # Rows of the block that a target ends in are taken in permuted order. Equal rows of one doc_id come first and take
    # alike; what cannot be dealt evenly among them, rows that are alone take after them, the last one in part.
    ended = _bounded(dealt.where("rest > 0 and rest < words").select("key", "block", "rest"))
    units = rows.join(ended, ["key", "block"]).groupBy("key", "block", "rest", "doc_id", "tag", "size").agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    inside = Window.partitionBy("key", "block", many).orderBy(F.xxhash64(F.lit(seed + 3), "doc_id", "tag"), "doc_id", "tag").rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("left", F.col("rest") - F.sum(F.col("n") * F.col("size")).over(inside) + F.col("n") * F.col("size"))
    units = units.withColumn("each", F.when(many, F.greatest(F.lit(0), F.least(F.col("size"), F.expr("left div n")))))
    gone = F.coalesce(F.sum(F.col("n") * F.col("each")).over(Window.partitionBy("key", "block")), F.lit(0))
    last = F.coalesce("each", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("gone"))))
    edges = materialize(units.withColumn("gone", gone).select("key", "doc_id", "tag", last.cast("long").alias("last")), "edges")
    discard(blocks)
    return sizes, goal, dealt, edges


def _with_copies(rows: DataFrame, goal: DataFrame, dealt: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """rows(key, doc_id, tag, ...) with source_size, target and copies: (shard, place, words), words null for all."""
    found = rows.join(goal, "key").withColumn("block", _block(seed)).join(_bounded(dealt), ["key", "block"], "left")
    last = _bounded(edges.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("tag").alias("t"), "last"))
    found = found.join(last, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    used = f"transform(coalesce(uses, array()), u -> struct(u.shard as shard, xxhash64({seed + 4}, doc_id, tag, u.epoch) as place, if(u.epoch <= epochs, null, last) as words))"
    return found.withColumn("copies", F.expr(used)).drop("block", "words", "epochs", "rest", "uses", "k", "d", "t", "last", "quota", "parts")


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, shards: int = 16, block_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """Per row of docs(doc_id, source, text): size, source_size, target, taken, and copies.

    copies: array of (shard, place, words), one for each time the mix uses the
    row; words is how many of its first words that copy has.
    """
    sizes, goal, dealt, edges = _dealt(docs, weights, limit, shards, block_words, seed)
    out = _with_copies(sizes, goal, dealt, edges, seed)
    whole = "transform(copies, c -> struct(c.shard as shard, c.place as place, coalesce(c.words, size) as words))"
    out = out.withColumn("copies", F.expr(f"filter({whole}, c -> c.words > 0 or size = 0)"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.expr("aggregate(copies, 0L, (a, c) -> a + c.words)").alias("taken"), "copies")


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut each text after its first mix_words words where that is not null."""
    for batch in byte_slices(batches):
        wanted = batch.column("mix_words")
        if wanted.null_count < len(wanted):
            at = batch.schema.get_field_index("text")
            texts = batch.column("text").to_pylist()
            for i, n in enumerate(wanted.to_pylist()):
                if n is not None and texts[i]:
                    raw = texts[i].encode()
                    rest = raw.split(None, n)
                    tail = len(rest[n]) if len(rest) > n else 0
                    texts[i] = raw[: len(raw) - tail].rstrip(b" \t\n\x0b\x0c\r").decode()
            batch = batch.set_column(at, batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))
        yield batch


def mix(docs: DataFrame, shards: int = 16, part_words: int = 1 << 22, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, block_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """The mix itself: docs(doc_id, source, text, ...) with a row for each copy and a column shard.

    A shard of more than part_words words is dealt by hash into parts of about
    that size; a part is in one partition, in permuted order. The parts' order is
    part of the permutation, so texts move once, whatever a shard's size. n_chars,
    where docs has it, is that of the text left. Columns that docs has under the
    names key, tag, source_size, target, copies, and the joins' own, are set aside
    and return untouched.
    """
    spark = docs.sparkSession
    aside = [c for c in docs.columns if c not in ("doc_id", "source", "text", "n_chars", "shard")]
    own = docs.drop("shard").withColumnsRenamed({c: f"own_{i}" for i, c in enumerate(aside)})
    columns = own.columns
    sizes, goal, dealt, edges = _dealt(docs, weights, limit, shards, block_words, seed)
    words = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-words // (shards * part_words)))
    discard(sizes)
    used = _with_copies(own.withColumn("key", F.expr(KEY)).withColumn("tag", F.expr(TAG)), goal, dealt, edges, seed)
    used = used.select(*columns, F.explode("copies").alias("c")).select(*columns, F.col("c.shard").alias("shard"), F.col("c.place").alias("mix_place"), F.col("c.words").alias("mix_words"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    used = used.where((F.coalesce(F.col("mix_words"), F.lit(1)) > 0) | blank)
    part = F.floor(F.shiftrightunsigned("mix_place", 1) / float(1 << 63) * parts)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = used.withColumn("mix_part", part).repartition(n, "shard", "mix_part").sortWithinPartitions("shard", "mix_part", "mix_place")
    out = out.mapInArrow(_first_words, out.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    out = out.select(*columns, "shard").withColumnsRenamed({f"own_{i}": c for i, c in enumerate(aside)})
    return out.select(*(c for c in docs.columns if c != "shard"), "shard")
