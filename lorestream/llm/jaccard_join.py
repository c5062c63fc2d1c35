"""Exact Jaccard join of documents on word shingles, in pivot regions.

Under Jaccard distance almost all documents are at distance 1 from any other
document, so documents as pivots would leave everything in one region. The
pivots here are the one-element sets {s}: a document x is at 1 - 1/|x| from the
pivots of its own shingles and at 1 from all others, so its nearest pivots are
its shingles, ties broken by one order of all shingles. For documents x, y within
distance d the triangle inequality bounds the shingles that only one of them has,
hence x and y meet in the region of one of the first |x| - ceil((1-d)|x|) + 1
pivots of x: that window is where x is replicated. The order puts the corpus's
most frequent shingles last (a list of bounded size; any order is exact), so
shared passages make no regions.

Regions join recursively: regions with the same members are one; those with many
members are split by the hash of the member into blocks, joined block by block.
A region of two members is dropped where their sizes differ too much, or where
what follows this pivot in both is too little: if an earlier pivot is shared too,
the pair meets there. Within a region the size bound and a parity bitmap prune
pairs: bitmaps differ in at most as many bits as shingle sets differ in elements.
Candidates are then verified on whole sets. Regions of a few members give all
their pairs at once; the others take two rounds so that a group of n near copies
does not cost n^2 verifications: first each document's nearest candidate, then
every candidate pair that the links found so far do not already connect.
Documents with equal sets are one member throughout. Components come from
`components`.

No cap drops anything: all documents, all shingles, all regions take part.

Edge cases: null, empty or wordless texts have n_shingles 0 and link with
nothing; texts of fewer words than a shingle are one shingle; rows with a null
doc_id are returned with a null component and link with nothing; repeated rows
are equal sets; texts that share a doc_id each follow their own links, as
members are sets, numbered apart; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorestream.llm.common import byte_slices, components, discard, materialize, steady, text_bytes, whole_groups
from lorestream.llm.rolling import GOLDEN, Rolling, U, mix

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20
_MAP_SMALL = 1_000_000


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The set of word shingles of each text, as rising unsigned 64-bit hashes."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < _BLOCK):
            size += len(texts[hi]) + 1
            hi += 1
        buf = _LOWER[np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", dtype=np.uint8)]
        blank = _BLANK[buf]
        start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        stop = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
        hashes = Rolling(buf)(start, stop)
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        cuts = np.searchsorted(start, ends)
        n = len(hashes) - words + 1
        if n > 0:
            grams = np.zeros(n, dtype=np.uint64)
            for i in range(words):
                grams = grams * U(GOLDEN) + hashes[i : i + n]
            grams = mix(grams)
        at = 0
        for end in cuts.tolist():
            if end - at >= words:
                yield np.unique(grams[at : end - words + 1])
            elif end > at:
                few = U(end - at)
                for h in hashes[at:end]:
                    few = few * U(GOLDEN) + h
                yield mix(np.array([few], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
            at = end
        lo = hi


def _frequent(words: int):
    """(shingle, documents) of shingles seen in three or more documents of one block of a task."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        s, n = np.unique(np.concatenate(held), return_counts=True)
        s, n = s[n > 2], n[n > 2]
        return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in byte_slices(batches):
            for s in shingle_sets(text_bytes(batch), words):
                held.append(s)
                size += len(s)
                if size > 2_000_000:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the set's members in each of 64 or more cells, a power of two near twice the set's size."""
    cells = max(64, 1 << int(2 * len(s) - 1).bit_length())
    at = (s >> U(7)) & U(cells - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


_ROWS = "doc_id long, tag long, n_shingles long, s1 long, s2 long, bits binary, pivots array<long>"


def _members(words: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, place = frequent.value
        for batch in byte_slices(batches):
            out: list[tuple] = []
            for s in shingle_sets(text_bytes(batch), words):
                n = len(s)
                if not n:
                    out.append((0, 0, 0, None, None))
                    continue
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()
                window = n + (-percent * n) // 100 + 1
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    often = late[at] == s
                    first = s[~often][:window]
                    if len(first) < window:
                        rest = s[often]
                        first = np.concatenate([first, rest[np.argsort(place[at[often]])][: window - len(first)]])
                else:
                    first = s[:window]
                out.append((n, *digest, bitmap(s), first.view(np.int64)))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in _ROWS.split(", ")])

    return run


def _fold(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def _near(ids, sizes, bits, labels, percent: int, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a region that size and bitmap cannot exclude; with labels, only of different ones."""
    lens = np.array([len(b) for b in bits])
    for width in np.unique(lens):
        mine = np.flatnonzero(lens == width)
        x = np.frombuffer(b"".join(bits[i] for i in mine), dtype=np.uint64).reshape(len(mine), -1)
        others, y = mine, x
        double = np.flatnonzero(lens == 2 * width)
        if len(double):
            y = np.concatenate([x, _fold(np.frombuffer(b"".join(bits[i] for i in double), dtype=np.uint64).reshape(len(double), -1))])
            others = np.concatenate([mine, double])
        step = max(1, 2_000_000 // max(1, len(others) * x.shape[1]))
        for lo in range(0, len(mine), step):
            rows = mine[lo : lo + step]
            apart = np.bitwise_count(x[lo : lo + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
            total = sizes[rows][:, None] + sizes[others][None, :]
            least = -(-percent * total // (100 + percent))
            good = apart <= total - 2 * least
            good &= 100 * np.minimum(sizes[rows][:, None], sizes[others][None, :]) >= percent * np.maximum(sizes[rows][:, None], sizes[others][None, :])
            good &= ids[rows][:, None] != ids[others][None, :]
            if labels is not None:
                good &= labels[rows][:, None] != labels[others][None, :]
            if nearest:
                some = np.flatnonzero(good.any(axis=1))
                best = np.where(good[some], apart[some], np.iinfo(np.int64).max).argmin(axis=1)
                a, b = ids[rows[some]], ids[others[best]]
                yield a, b
                back = np.flatnonzero(good[:, len(mine) :].any(axis=0))  # the wider ones' nearest among these
                if len(back):
                    best = np.where(good[:, len(mine) :][:, back], apart[:, len(mine) :][:, back], np.iinfo(np.int64).max).argmin(axis=0)
                    yield ids[double[back]], ids[rows[best]]
            else:
                i, j = np.nonzero(good)
                yield ids[rows[i]], ids[others[j]]


def _candidates(percent: int, nearest: bool, few: int = 0):
    """Pairs of each region; in the round of the nearest, regions of at most `few` members give all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "region"):
            region, ids, sizes = (table.column(c).to_numpy() for c in ("region", "member", "n_shingles"))
            labels = None if nearest else table.column("label").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region))
            small, large = np.minimum.reduceat(sizes, cuts[:-1]), np.maximum.reduceat(sizes, cuts[:-1])
            two = np.diff(cuts) == 2
            possible = ~two | (100 * small >= percent * large)
            if labels is not None:
                possible &= np.minimum.reduceat(labels, cuts[:-1]) != np.maximum.reduceat(labels, cuts[:-1])
            bits = table.column("bits")
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for k in np.flatnonzero(possible).tolist():
                lo, hi = int(cuts[k]), int(cuts[k + 1])
                found += _near(ids[lo:hi], sizes[lo:hi], bits.slice(lo, hi - lo).to_pylist(), None if labels is None else labels[lo:hi], percent, nearest and hi - lo > few)
            if found:
                a, b = (np.concatenate(c) for c in zip(*found))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            sets = pa.array([s.tobytes() for s in shingle_sets(text_bytes(batch), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("member"), sets], names=["member", "shingles"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(byte_slices(batches, "x"), "y"):
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("member").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("member").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_linked(percent), "a long, b long")


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")


def _set_members(known: DataFrame) -> DataFrame:
    """A row for each set: s1, s2, its smallest doc_id (set_id) with the tag of that text, and its member number.

    That is set_id, but for sets whose smallest doc_id also has other texts: all but one of those get a 64-bit hash.
    """
    sets = known.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "tag")).alias("least")).select("s1", "s2", F.col("least.doc_id").alias("set_id"), F.col("least.tag").alias("set_tag"))
    first = sets.groupBy("set_id").agg(F.min(F.struct("s1", "s2")).alias("first"))
    plain = F.col("first") == F.struct("s1", "s2")
    return sets.join(first, "set_id").select("s1", "s2", "set_id", "set_tag", F.when(plain, F.col("set_id")).otherwise(F.xxhash64("set_id", "s1", "s2")).alias("member"))


def _repeats(rows: DataFrame) -> bool:
    """Whether any doc_id has one text twice."""
    return not rows.groupBy("doc_id", "tag").count().where("count > 1").isEmpty()


def join_classes(docs: DataFrame, words: int = 4, percent: int = 85, often: int = 64, listed: int = 1 << 16, block: int = 1024, few: int = 8) -> DataFrame:
    """Per row of docs(doc_id, text): n_shingles, set_id, component_id, class_id and tag.

    Two documents link when 100 * shared shingles >= percent * all their
    shingles; component_id is the smallest doc_id reachable by links, set_id the
    smallest doc_id with the same set, class_id the component's number, which
    differs between components even where doc_ids repeat (null for empty sets),
    tag a hash of the text. The `listed` most frequent shingles among
    those in `often` documents or more come last in the order of pivots. Regions
    of more than `block` documents are joined block by block; those of at most
    `few` need no second round.
    """
    spark = docs.sparkSession
    own = _own(steady(docs))
    counted = own.mapInArrow(_frequent(words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    top = counted.orderBy(F.desc("n"), "shingle").limit(listed).select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(top)
    frequent = spark.sparkContext.broadcast((top[order], len(top) - order))

    rows = materialize(own.mapInArrow(_members(words, percent, frequent), _ROWS), "rows")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    repeats = _repeats(known)
    sets_ = materialize(_set_members(known), "sets")

    # Only pivots of two members or more, of possible sizes, make regions; all others go before anything else is carried.
    leads = (F.col("doc_id") == F.col("set_id")) & (F.col("tag") == F.col("set_tag"))
    members = known.join(sets_, ["s1", "s2"]).where(leads)
    seats = members.select("member", F.col("n_shingles").cast("int").alias("n_shingles"), F.posexplode("pivots").alias("nth", "pivot"))
    size = F.col("n_shingles")
    met = seats.groupBy("pivot").agg(F.count("*").alias("n"), F.min(size).alias("small"), F.max(size).alias("large"))
    met = met.where((F.col("n") > 2) | (F.col("n") == 2) & (100 * F.col("small") >= percent * F.col("large"))).select("pivot")
    shared = seats.join(met, "pivot")
    shared = materialize(shared.dropDuplicates(["pivot", "member"]) if repeats else shared, "shared")

    regions = shared.groupBy("pivot").agg(
        F.count("*").alias("n"), F.min("member").alias("lo"), F.max("member").alias("hi"), F.bit_xor(F.xxhash64("member")).alias("mark"),
        F.min(size).alias("small"), F.max(size).alias("large"), F.min(size - F.col("nth")).alias("rest"),
    )
    possible = (100 * F.col("small") >= percent * F.col("large")) & ((100 + percent) * F.col("rest") >= percent * (F.col("small") + F.col("large")))
    regions = regions.where((F.col("n") > 2) | (F.col("n") == 2) & possible).groupBy("n", "lo", "hi", "mark").agg(F.min("pivot").alias("pivot"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = shared.select("pivot", "member").join(regions.select("pivot", "n", blocks.alias("blocks")), "pivot").withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "member"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "member", F.xxhash64("pivot", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), (F.col("n") > few).alias("many")
    )
    placed = materialize(placed, "placed")
    bits = members.select("member", "n_shingles", "bits").join(placed.select("member").distinct(), "member", "left_semi")
    bits = bits.dropDuplicates(["member"]) if repeats else bits
    seated = materialize(placed.join(bits, "member").select("region", "member", "many", "n_shingles", "bits"), "seats")
    discard(shared, placed)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arranged = lambda df: df.repartition(parts, "region").sortWithinPartitions("region")
    first = materialize(arranged(seated.drop("many")).mapInArrow(_candidates(percent, True, few), "a long, b long").distinct(), "candidates")
    wanted = first.select(F.col("a").alias("member")).union(first.select("b")).distinct()
    wanted = materialize(sets_.join(wanted, "member", "left_semi").select(F.col("set_id").alias("doc_id"), F.col("set_tag").alias("tag"), "member"), "wanted")
    small = wanted.count() <= _MAP_SMALL
    sets = own.join(F.broadcast(wanted) if small else wanted, ["doc_id", "tag"]).select("member", "text").mapInArrow(_set_rows(words), "member long, shingles binary")
    sets = materialize(sets.dropDuplicates(["member"]) if repeats else sets, "shingles")
    links = materialize(_verified(first, sets, percent), "links")
    label = components(links).select(F.col("id").alias("member"), F.col("component").alias("label"))
    labelled = seated.where("many").drop("many").join(label, "member", "left").withColumn("label", F.coalesce("label", "member"))
    second = arranged(labelled).mapInArrow(_candidates(percent, False), "a long, b long").distinct()
    every = materialize(links.union(_verified(second, sets, percent)), "links")
    discard(seated, first, wanted, sets, links)

    component = components(every)
    linked = sets_.join(component, F.col("member") == F.col("id")).select("s1", "s2", "set_id", "component")
    least = linked.groupBy("component").agg(F.min("set_id").alias("component_id"))
    linked = linked.join(least, "component").select("s1", "s2", "component", "component_id")
    found = sets_.join(linked, ["s1", "s2"], "left").select("s1", "s2", "set_id", F.coalesce("component_id", "set_id").alias("component_id"), F.coalesce("component", "member").alias("class_id"))
    columns = ["doc_id", "n_shingles", "set_id", "component_id", "class_id", "tag"]
    out = known.select("doc_id", "tag", "n_shingles", "s1", "s2").join(found, ["s1", "s2"]).select(*columns)
    id_ = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", id_.alias("set_id"), id_.alias("component_id"), F.lit(None).cast("long").alias("class_id"), "tag")
    out = materialize(out.unionByName(alone), "classes")
    discard(rows, sets_, every)
    return out


def one_of_each_class(docs: DataFrame, words: int = 5, percent: int = 80, **how) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each component of `join_classes`, that of smallest doc_id.

    Of rows with this doc_id and several texts in the component the text of least
    hash stays, of repeated rows one. Rows without shingles stay, one of each
    (doc_id, text); rows with a null doc_id all stay. Other columns pass through;
    `tag` and `nth` replace columns of these names.
    """
    found = join_classes(docs, words, percent, **how).where("doc_id is not null")
    first = found.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "tag")).alias("first")).select("first.*")
    first = first.unionByName(found.where("class_id is null").select("doc_id", "tag").distinct())
    own = docs.drop("tag", "nth")
    tagged = own.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit("")))).join(first, ["doc_id", "tag"], "left_semi")
    if _repeats(found):
        order = Window.partitionBy("doc_id", "tag").orderBy(F.xxhash64(*own.columns))
        tagged = tagged.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return tagged.select(*own.columns).unionByName(own.where("doc_id is null"))
