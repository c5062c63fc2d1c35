"""Merkle manifest of a dataset: one digest for all rows, and for each row a proof that it is among them.

Each row is a leaf. Per group (source) the leaves, in order, and then the nodes
above them are hashed by runs of three until one is left; the groups' roots, in
order, are hashed likewise. H is SHA-256 in hexadecimal over concatenated inputs.

1. Leaves are hashed as built-in expressions in one pass over the texts and written
   to the shared folder; from there on only digests move.
2. A range sort by group and order gives each leaf its place: tasks number their own
   rows, and the counts by task and group, summed before each task, are the offsets.
   So a group of any size is spread over many tasks.
3. An aligned block is 3^7 places. It is a subtree of its own, so a postorder
   recursion over it returns its digest. Digests of blocks are the nodes of another
   such round, and so on until every group has one node; its roots are numbered and
   treated in the same way. Each round divides the rows by 2,187.
4. Downwards again: each block, joined to the siblings above it, is traversed once
   more; while the recursion unwinds, siblings are appended to the leaves they
   belong to, and then those above. The leaves' round streams its proofs to whoever
   reads them; they are not written.

Rounds are few: two for up to 4.7 million leaves of a group, four for 10^13. A lost
executor costs the tasks it had; every round's table lies in the shared folder.

Edge cases: an absent value hashes as `-`; rows without a group form one group, the
first; rows without an order come first in their group; rows of equal order are
ordered by digest, so repeated rows have equal leaves and proofs of their own places;
an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestream.llm.common import discard, materialize

WAYS = 3
SIBLINGS = "array<struct<before:string,after:string>>"
_SIBLINGS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def fold(digest: Column, siblings: Column) -> Column:
    """The root that a leaf's digest leads to with these siblings."""
    return F.aggregate(siblings, digest, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_text(siblings: Column) -> Column:
    """All siblings, level by level, from left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["before"], s["after"])), "")


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _height(n: int, places: int, depth: int) -> int:
    """Levels of a block of n nodes: to its top where the group goes on beyond it, else until one is left."""
    if places > WAYS**depth:
        return depth
    h = 0
    while WAYS**h < n:
        h += 1
    return h


def block_root(digests: list[str], height: int, paths: list[list[tuple[str, str]]] | None = None) -> str:
    """Digest of a block of this height; to paths[i] are appended the siblings on the way from node i up to it."""

    def climb(low: int, high: int, level: int) -> str:
        if not level:
            return digests[low]
        span = WAYS ** (level - 1)
        starts = range(low, high, span)
        parts = [climb(a, min(a + span, high), level - 1) for a in starts]
        if paths is not None:
            for i, a in enumerate(starts):
                beside = ("".join(parts[:i]), "".join(parts[i + 1 :]))
                for path in paths[a : min(a + span, high)]:
                    path.append(beside)
        return _hash(parts)

    return climb(0, len(digests), height)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Whole blocks of batches sorted by group and place: one begins at every multiple of their size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        places = batch.column("place").to_numpy()
        low = 0
        for at in np.flatnonzero(places % size == 0).tolist():
            if at > low:
                held.append(batch.slice(low, at - low))
            if held:
                yield pa.Table.from_batches(held)
            held, low = [], at
        if low < len(places):
            held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def _roots(depth: int):
    size = WAYS**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for t in _blocks(batches, size):
            key, place, places = (t.column(c)[0].as_py() for c in ("key", "place", "places"))
            digest = block_root(t.column("digest").to_pylist(), _height(t.num_rows, places, depth))
            out.append({"key": key, "place": place // size, "places": -(-places // size), "digest": digest})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out)

    return run


def _paths(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, WAYS**depth):
            above = [(x["before"], x["after"]) for x in t.column("above")[0].as_py() or ()]
            paths: list[list[tuple[str, str]]] = [[] for _ in range(t.num_rows)]
            block_root(t.column("digest").to_pylist(), _height(t.num_rows, t.column("places")[0].as_py(), depth), paths)
            told = pa.array([[{"before": a, "after": b} for a, b in [*p, *above]] for p in paths], _SIBLINGS)
            yield from t.drop_columns(["above"]).append_column("siblings", told).combine_chunks().to_batches()

    return run


def _by_block(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.repartition("key", F.expr(f"place div {WAYS**depth}")).sortWithinPartitions("key", "place")


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with `place`, from 0, in this order within its key, and `places`, the rows of its key; key is not null."""
    salt = F.monotonically_increasing_id()  # equal rows spread too
    tie = [key, *order, "salt_"]
    dealt = rows.withColumn("salt_", salt).repartitionByRange(*tie).sortWithinPartitions(*tie).drop("salt_")
    dealt = materialize(dealt.withColumn("at_", F.monotonically_increasing_id()), "sorted")
    task, nth = F.shiftright("at_", 33), F.col("at_").bitwiseAND((1 << 33) - 1)
    per = dealt.groupBy(key, task.alias("task_")).agg(F.count("*").alias("n_"), F.min(nth).alias("first_"))
    w = Window.partitionBy(key)
    per = per.select(key, "task_", "first_", F.sum("n_").over(w).alias("places"), (F.sum("n_").over(w.orderBy("task_")) - F.col("n_")).alias("before_"))
    joined = dealt.withColumn("task_", task).join(per, [key, "task_"])
    out = joined.withColumn("place", nth - F.col("first_") + F.col("before_")).drop("task_", "first_", "before_", "at_")
    kept = materialize(out, "numbered")
    discard(dealt)
    return kept


def _climb(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """Tables of nodes(key, place, places, digest) by round, the last with one node a key."""
    rounds = [nodes]
    most = nodes.agg(F.max("places")).first()[0] or 0
    while True:
        above = _by_block(rounds[-1].select("key", "place", "places", "digest"), depth).mapInArrow(_roots(depth), "key string, place long, places long, digest string")
        rounds.append(materialize(above, "nodes"))
        most = -(-most // WAYS**depth)
        if most <= 1:
            return rounds


def _descend(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """nodes with `siblings`, given those of their blocks: above(key, place, siblings)."""
    parents = above.select("key", F.col("place").alias("block_"), F.col("siblings").alias("above"))
    own = nodes.withColumn("block_", F.expr(f"place div {WAYS**depth}")).join(parents, ["key", "block_"]).drop("block_")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return _by_block(own.select(*nodes.columns, "above"), depth).mapInArrow(_paths(depth), f"{schema}, siblings {SIBLINGS}")


def prove(leaves: DataFrame, group: str, order: str, depth: int = 7) -> DataFrame:
    """leaves(group, order, leaf, ...) with subroot, root and siblings, those of the leaf first.

    Folding a leaf with its siblings gives the root: `fold`. `leaf` is a digest;
    columns named key, place, places, digest, above, subroot, root or siblings are
    replaced. A block has 3^depth places.
    """
    own = leaves.drop("key", "place", "places", "digest", "subroot", "root", "siblings", "above")
    keyed = own.withColumn("key", F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))))
    first = numbered(keyed, "key", order, "leaf").withColumnRenamed("leaf", "digest")
    rounds = _climb(first, depth)
    roots = numbered(rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "key", "name")
    higher = _climb(roots, depth)
    top = higher[-1]
    found = top.select("key", "place", F.array().cast(SIBLINGS).alias("siblings"))
    read = [*rounds[1:], *higher]
    for nodes in reversed(higher[:-1]):
        found = materialize(_descend(nodes, found, depth), "paths")
        read.append(found)
    whole = found.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("place"), "siblings", F.col("digest").alias("subroot"))
    known = materialize(whole.crossJoin(F.broadcast(top.select(F.col("digest").alias("root")))), "roots")  # top is one row
    found = known
    for nodes in reversed(rounds[1:-1]):
        read.append(found)
        found = materialize(_descend(nodes, found, depth), "paths")
    discard(*(x for x in read if x is not known))
    out = _descend(first, found, depth).join(known.select("key", "subroot", "root"), "key")
    return out.withColumnRenamed("digest", "leaf").drop("key", "place", "places")


def manifest(docs: DataFrame) -> DataFrame:
    """op12's columns: doc_id, leaf, subroot, root, digest of the proof, and what a tampered copy folds to."""
    value = F.col
    bare = [value(c) for c in LEAF[:-1]]
    spoilt = F.crc32(value("doc_id").cast("string").cast("binary")) % 2 == 0
    own = leaf(*bare, value("text"))
    other = F.when(spoilt & value("text").contains("\n"), leaf(*bare, F.replace(value("text"), F.lit("\n"), F.lit(""))))
    leaves = materialize(docs.select("doc_id", "source", own.alias("leaf"), other.alias("tampered")), "leaves")
    out = prove(leaves, "source", "doc_id")
    discard(leaves)
    folded = fold(F.coalesce("tampered", "leaf"), value("siblings"))
    told = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(value("siblings")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", value("folded_root") == value("root"))
