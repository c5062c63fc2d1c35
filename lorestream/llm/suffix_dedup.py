"""Suffix-array de-duplication of repeated byte strings, exact over the whole corpus.

A byte goes if it lies in a string of `length` bytes that also starts earlier,
at a smaller doc_id or earlier in the same document, judged on the input.

The suffix array is sparse and distributed:

1. Every window of `length` bytes owns its smallest k-gram (by a mixed rolling
   hash, leftmost first), its anchor. Equal windows have equal anchors, and one
   anchor serves a run of neighbouring windows, about one in forty bytes.
2. Anchors whose k-gram hash occurs once in the corpus cannot repeat. The rest
   bring their run's bytes (its stretch). Equal stretches collapse to the
   earliest by a 128-bit digest; all later copies repeat it whole.
3. Earliest stretches that share an anchor but differ meet in one task, and the
   suffixes that are windows are sorted there deep-shallow: multikey sorting by
   8-byte symbols to a shallow depth, then a blind trie for every group of
   suffixes that still agree. Equal windows end in one leaf; all but the
   earliest repeat. An anchor with very many different stretches is never one
   task's work: its windows are aggregated by digest instead.

Anchors are hash-partitioned, counts are combined before the shuffle, joins on
anchors and digests can be split where a key is hot, and texts are shuffled once.

Edge cases: null text is empty; texts shorter than `length` lose nothing; rows
with a null doc_id keep everything and are nobody's earlier copy; identical
rows are one document and get the same result; different texts under one
doc_id are ordered by a hash of the text; other columns pass through
`remove_repeats` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorestream.llm.common import byte_slices, steady, text_bytes, whole_groups
from lorestream.llm.rolling import GOLDEN, Rolling, U, mix

GRAM = 28
_SEGMENT = 1 << 17
_SHALLOW = 32
#: What a task works on at once: compressed bytes of text, stretches, windows and rows of a batch it hands on.
_PACKED, _HELD, _WINDOWS, _ROWS = 1 << 18, 1 << 18, 1 << 18, 1 << 16


def _segments(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Overlapping pieces such that each window lies in exactly one."""
    for at in range(0, max(1, len(text) - length + 1), _SEGMENT):
        yield at, text[at : at + _SEGMENT + length - 1]


def _packs(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    pack: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for at, part in _segments(text, length):
            if size and size + len(part) > _SEGMENT + length:
                yield pack
                pack, size = [], 0
            pack.append((i, at, part))
            size += len(part)
    if pack:
        yield pack


def _anchors(texts: list[bytes], length: int, digests: bool) -> Iterator[dict[str, np.ndarray]]:
    """Runs of windows with one anchor: row, start, windows, gram and (h1, h2) of the run's bytes."""
    width = length - GRAM + 1
    for pack in _packs(texts, length):
        buf = np.frombuffer(b"".join(p for _, _, p in pack), dtype=np.uint8)
        roll = Rolling(buf, 0)
        gram = roll.grams(GRAM)
        n = len(gram)
        ranked = (gram & U(0xFFFFFFFFFFFFFFFF ^ 0xFFFFF)) | np.arange(n, dtype=np.uint64)
        blocks = -(-n // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = ranked
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
        m = n - width + 1
        least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
        place = (least & U(0xFFFFF)).astype(np.int64)
        sizes = np.array([len(p) for _, _, p in pack])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        good = np.zeros(m + 1, dtype=np.int32)
        np.add.at(good, first, 1)
        np.add.at(good, first + sizes - length + 1, -1)
        valid = np.cumsum(good[:m]) > 0
        begins = valid.copy()
        begins[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
        begins[first] = True
        start = np.flatnonzero(begins)
        ends = valid.copy()
        ends[:-1] &= begins[1:] | ~valid[1:]
        stop = np.flatnonzero(ends) + 1
        which = np.searchsorted(first, start, side="right") - 1
        out = {
            "row": np.array([r for r, _, _ in pack])[which],
            "start": start - first[which] + np.array([a for _, a, _ in pack])[which],
            "windows": stop - start,
            "gram": gram[place[start]].view(np.int64),
        }
        if digests:
            end = stop + length - 1
            one, two = roll(start, end), Rolling(buf, 1)(start, end)
            out["h1"] = (one ^ gram[place[start]]).view(np.int64)
            out["h2"] = two.view(np.int64)
        yield out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames, for the shuffles that carry them."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for part in byte_slices(batches):
        packed = pa.array([squeeze.compress(t) for t in text_bytes(part)], pa.binary())
        own = [(n, part.column(n)) for n in part.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([c for _, c in own] + [packed], names=[n for n, _ in own] + ["packed"])


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    open_up = zstandard.ZstdDecompressor()
    return [open_up.decompress(x) for x in batch.column("packed").to_pylist()]


def _gram_rows(length: int):
    """Anchors of each document; n is 2 for those it has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            ids = batch.column("doc_id").to_numpy()
            for x in _anchors(text_bytes(batch), length, False):
                _, at, n = np.unique(_pair(x["row"], x["gram"]), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x["gram"][at]), pa.array(ids[x["row"][at]]), pa.array(np.minimum(n, 2))], names=["gram", "doc_id", "n"])

    return run


_STRETCH = "kind int, h1 long, h2 long, gram long, doc_id long, tag long, start int, windows int"


def _stretches(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [np.int32, *[np.int64] * 5, np.int32, np.int32]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _STRETCH.split(", ")])


def _split_copies(h1, h2, gram, doc, tag, start, windows) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The earliest stretch of each digest, and the later ones, both without repeated places."""
    cols = [c for c in (h1, h2, gram, doc, tag, start, windows)]
    o = np.lexsort((start, tag, doc, h2, h1))
    cols = [c[o] for c in cols]
    same = np.zeros(len(o), dtype=bool)
    same[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
    twice = same.copy()
    twice[1:] &= (cols[3][1:] == cols[3][:-1]) & (cols[4][1:] == cols[4][:-1]) & (cols[5][1:] == cols[5][:-1])
    return [c[~same] for c in cols], [c[same & ~twice] for c in cols]


def _joined(doc, tag, start, windows, length) -> tuple[np.ndarray, ...]:
    """Neighbouring or overlapping runs of repeated windows as one run."""
    o = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[o], tag[o], start[o], start[o] + windows[o] + length - 1
    if not len(doc):
        return doc, tag, start, stop
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > stop[:-1])
    at = np.flatnonzero(new)
    return doc[at], tag[at], start[at], np.maximum.reduceat(stop, at)


def _stretch_rows(length: int):
    """Stretches on repeated anchors. Copies that one block of a task can see itself leave as kind 0, dealt by
    their own place, so that a digest has at most one row of kind 1 from each block."""

    def block(held: list[list[np.ndarray]], copies: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        first, later = _split_copies(*(np.concatenate(c) for c in zip(*held)))
        for at in range(0, len(first[0]), _ROWS):
            part = [c[at : at + _ROWS] for c in first]
            yield _stretches([np.ones(len(part[0])), *part])
        doc, tag, start, stop = _joined(*(np.concatenate(c) for c in zip(*copies, tuple(later[3:]))), length)
        for at in range(0, len(doc), _ROWS):
            d, t, lo, hi = (c[at : at + _ROWS] for c in (doc, tag, start, stop))
            spread = mix(d.view(np.uint64) + lo.astype(np.uint64) * U(GOLDEN)).view(np.int64)
            zero = np.zeros(len(d), dtype=np.int64)
            yield _stretches([zero, spread, zero, zero, d, t, lo, hi - lo - length + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        copies: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in byte_slices(batches, "packed", _PACKED):
            texts = _unpacked(batch)
            ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            lists = batch.column("grams")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            wanted = np.unique(_pair(np.repeat(np.arange(len(texts)), np.diff(offsets)), flat))
            found: list[list[np.ndarray]] = []
            for x in _anchors(texts, length, True):
                key = _pair(x["row"], x["gram"])
                hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                r = x["row"][hit]
                found.append([x["h1"][hit], x["h2"][hit], x["gram"][hit], ids[r], tags[r], x["start"][hit], x["windows"][hit]])
            if not found:
                continue
            first, later = _split_copies(*(np.concatenate(c) for c in zip(*found)))
            held.append(first)
            copies.append(tuple(later[3:]))
            size += len(first[0])
            if size > _HELD:
                yield from block(held, copies)
                held, copies, size = [], [], 0
        if held:
            yield from block(held, copies)

    return run


def _classify(length: int):
    """Of batches sorted by digest: kind 1 rows, the earliest of each digest; kind 0 rows, runs that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "h1"):
            cols = [c.to_numpy() for c in table.columns]
            one = cols[0] == 1
            first, later = _split_copies(*(c[one] for c in cols[1:]))
            yield _stretches([np.ones(len(first[0])), *first])
            known = [np.concatenate([a, c[~one]]) for a, c in zip(later, cols[1:])]
            doc, tag, start, stop = _joined(*known[3:], length)
            zero = np.zeros(len(doc), dtype=np.int64)
            yield _stretches([zero, zero, zero, zero, doc, tag, start, stop - start - length + 1])

    return run


def _pair(row: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A row of the batch and a k-gram hash as one number; a clash only keeps an anchor that is unique."""
    return mix(gram.view(np.uint64) + row.astype(np.uint64) * U(GOLDEN))


def _bytes_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "doc_id", "tag", "start", "bytes"]
        for batch in byte_slices(batches, "packed", _PACKED):
            texts, tags = _unpacked(batch), batch.column("tag").to_pylist()
            rows: list[tuple] = []
            size = 0
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                seen = set()
                for p in parts:
                    key = (p["gram"], p["start"], p["windows"])
                    if p["tag"] == tags[i] and key not in seen:
                        seen.add(key)
                        rows.append((p["gram"], batch.column("doc_id")[i].as_py(), p["tag"], p["start"], texts[i][p["start"] : p["start"] + p["windows"] + length - 1]))
                        size += len(rows[-1][-1])
                if size > 4 << 20:
                    yield _rows(rows, names)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, names)

    return run


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class BlindTrie:
    """Orders equal-length strings by inner nodes that hold only a depth and the bytes there.

    Descending compares one byte a node and skips what lies between; the leaf
    reached is compared once to find the true depth. Equal strings share a leaf.
    """

    __slots__ = ("root", "text", "length")

    def __init__(self, text: bytes, length: int) -> None:
        self.root, self.text, self.length = None, text, length

    def add(self, at: int) -> None:
        text, length = self.text, self.length
        if self.root is None:
            self.root = [at]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, kids = node
            node = kids.get(text[at + depth]) or next(iter(kids.values()))
        other = node[0]
        mine, its = text[at : at + length], text[other : other + length]
        if mine == its:
            node.append(at)
            return
        x = int.from_bytes(mine, "big") ^ int.from_bytes(its, "big")
        differ = length - (x.bit_length() + 7) // 8
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < differ:
            parent, node = node, node[1][mine[node[0]]]
        if isinstance(node, tuple) and node[0] == differ:
            node[1][mine[differ]] = [at]
            return
        new = (differ, {its[differ]: node, mine[differ]: [at]})
        if parent is None:
            self.root = new
        else:
            parent[1][mine[parent[0]]] = new

    def leaves(self) -> Iterator[list[int]]:
        """Classes of equal strings, in order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node:
                yield node


def equal_windows(text: bytes, at: np.ndarray, group: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Classes of two or more equal windows text[at : at + length] within each group, in suffix order.

    Yields arrays of indices into `at`.
    """
    buf = np.frombuffer(text + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
    n = len(buf) - 7
    symbol = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        symbol |= buf[i : n + i] << U(56 - 8 * i)
    order = np.argsort(group, kind="stable")
    part = group[order]
    for depth in range(0, min(_SHALLOW, length), 8):  # multikey, all groups of one depth at once
        key = symbol[at[order] + depth]
        if depth + 8 > length:
            key &= U(0xFFFFFFFFFFFFFFFF) << U(8 * (depth + 8 - length))
        o = np.lexsort((key, part))
        order, part, key = order[o], part[o], key[o]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        part = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        order, part = order[~alone], part[~alone]
        if not len(order):
            return
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        mine = order[lo:hi]
        if length <= _SHALLOW:
            yield mine
            continue
        trie = BlindTrie(text, length)
        index = {}
        for i, p in zip(mine.tolist(), at[mine].tolist()):
            trie.add(p)
            index[p] = i
        for leaf in trie.leaves():
            if len(leaf) > 1:
                yield np.array([index[p] for p in leaf])


def _window_digests(parts: list[bytes], length: int) -> np.ndarray:
    """A 64-bit hash of every window of every part, in order."""
    out = []
    for pack in _packs(parts, length):
        sizes = np.array([len(p) for _, _, p in pack])
        windows = sizes - length + 1
        first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows), windows)
        at = first + np.arange(windows.sum())
        out.append(Rolling(np.frombuffer(b"".join(p for _, _, p in pack), dtype=np.uint8), 0)(at, at + length))
    return np.concatenate(out)


def _by_windows(tables: Iterator[pa.Table], length: int) -> Iterator[pa.Table]:
    """Parts of tables sorted by gram, of whole grams, with at most _WINDOWS windows or one gram."""
    for table in tables:
        grams = table.column("gram").to_numpy()
        ends = np.cumsum(pc.binary_length(table.column("bytes")).to_numpy().astype(np.int64) - length + 1)
        cuts = np.append(np.flatnonzero(grams[1:] != grams[:-1]) + 1, len(grams))
        at = 0
        while at < len(grams):
            before = ends[at - 1] if at else 0
            whole = cuts[cuts > at]
            to = int(whole[max(0, np.searchsorted(ends[whole - 1], before + _WINDOWS, side="right") - 1)])
            yield table.slice(at, to - at)
            at = to


def _sorted_repeats(length: int):
    """Repeated windows among stretches that share an anchor, from batches sorted by it.

    Windows whose hash is unique beside their anchor cannot repeat and are not sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_windows(whole_groups(batches, "gram"), length):
            grams, ids, tags, begin = (table.column(c).to_numpy() for c in ("gram", "doc_id", "tag", "start"))
            o = np.lexsort((begin, tags, ids, grams))
            new = np.ones(len(o), dtype=bool)
            new[1:] = np.any([x[o[1:]] != x[o[:-1]] for x in (grams, ids, tags, begin)], axis=0)
            o = o[new]
            ids, tags, begin = ids[o], tags[o], begin[o]
            _, group = np.unique(grams[o], return_inverse=True)
            parts = table.column("bytes").take(pa.array(o)).to_pylist()
            sizes = np.array([len(p) for p in parts])
            first = np.cumsum(sizes) - sizes
            windows = sizes - length + 1
            owner = np.repeat(np.arange(len(parts)), windows)
            inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            key = mix(_window_digests(parts, length) + group[owner].astype(np.uint64) * U(GOLDEN))
            by = np.argsort(key)
            twin = key[by[1:]] == key[by[:-1]]
            some = np.zeros(len(key), dtype=bool)
            some[by[1:]] = twin
            some[by[:-1]] |= twin
            some = np.flatnonzero(some)
            starts = begin[owner] + inside
            repeated = np.zeros(len(owner), dtype=bool)
            for same in equal_windows(b"".join(parts), (first[owner] + inside)[some], group[owner[some]], length):
                same = some[same]
                repeated[same] = True
                repeated[same[np.lexsort((starts[same], tags[owner[same]], ids[owner[same]]))[0]]] = False
            yield _runs(ids, tags, owner, starts, repeated, length)

    return run


def _runs(ids, tags, owner, starts, repeated, length) -> pa.RecordBatch:
    """Byte ranges covered by runs of repeated windows."""
    begins = repeated.copy()
    begins[1:] &= ~repeated[:-1] | (owner[1:] != owner[:-1])
    ends = repeated.copy()
    ends[:-1] &= ~repeated[1:] | (owner[1:] != owner[:-1])
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends)
    who = owner[lo]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[who]), pa.array(tags[who]), pa.array(starts[lo].astype(np.int32)), pa.array((starts[hi] + length).astype(np.int32))],
        names=["doc_id", "tag", "start", "stop"],
    )


def _window_rows(length: int):
    """One row per window with a 128-bit digest, for anchors with very many stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("bytes").to_pylist()):
                windows = len(text) - length + 1
                d = [hashlib.blake2b(text[w : w + length], digest_size=16).digest() for w in range(windows)]
                start = batch.column("start")[i].as_py() + np.arange(windows, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.binary()), pa.array([batch.column("doc_id")[i].as_py()] * windows, pa.int64()), pa.array([batch.column("tag")[i].as_py()] * windows, pa.int64()), pa.array(start)],
                    names=["digest", "doc_id", "tag", "start"],
                )

    return run


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with packed and tag, a hash of the text, in place of text."""
    own = docs.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    schema = StructType([f for f in own.schema.fields if f.name != "text"]).add("packed", "binary")
    return own.mapInArrow(_pack, schema)


def repeated_ranges(docs: DataFrame, packed: DataFrame, length: int = 100, crowd: int = 1 << 15) -> DataFrame:
    """(doc_id, tag, start, stop): byte ranges, overlapping ones included, whose union goes.

    docs has doc_id (integer, not null) and text; packed has doc_id, tag and packed of packed_texts. crowd: an anchor with more
    different stretches than this is worked on by window digests, in many tasks.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = docs.mapInArrow(_gram_rows(length), "gram long, doc_id long, n long")
    often = anchors.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    grams = anchors.select("gram", "doc_id").join(often, "gram").groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    found = packed.join(grams, "doc_id").select("doc_id", "tag", "packed", "grams").mapInArrow(_stretch_rows(length), _STRETCH)
    known = found.repartition(n, "h1", "h2").sortWithinPartitions("h1").mapInArrow(_classify(length), _STRETCH)
    place = F.struct("doc_id", "tag", "start")
    copies = known.where("kind = 0").select("doc_id", "tag", "start", (F.col("start") + F.col("windows") + F.lit(length - 1)).alias("stop"))
    firsts = known.where("kind = 1")
    contested = firsts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    parts = (
        firsts.join(contested, "gram")
        .select("doc_id", F.struct(F.when(F.col("n") > crowd, F.lit(1)).otherwise(F.lit(0)).alias("hot"), "tag", "start", "windows", "gram").alias("part"))
        .groupBy("doc_id", "part.hot")
        .agg(F.collect_list("part").alias("parts"))
    )
    schema = "gram long, doc_id long, tag long, start int, bytes binary"
    few, many = (packed.join(parts.where(F.col("hot") == h), "doc_id").select("doc_id", "tag", "packed", "parts").mapInArrow(_bytes_rows(length), schema) for h in (0, 1))
    span = "doc_id long, tag long, start int, stop int"
    by_sort = few.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_sorted_repeats(length), span)
    windows = many.mapInArrow(_window_rows(length), "digest binary, doc_id long, tag long, start int")
    seen = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    by_digest = windows.join(seen, "digest").where(place != F.col("first")).select("doc_id", "tag", "start", (F.col("start") + F.lit(length)).alias("stop"))
    return copies.unionByName(by_sort).unionByName(by_digest)


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "packed", _PACKED):
        out: list[tuple] = []
        for text, tag, ranges in zip(_unpacked(batch), batch.column("tag").to_pylist(), batch.column("ranges").to_pylist()):
            kept, at, spans, stop = [], 0, 0, -1
            for r in sorted((r["start"], r["stop"]) for r in ranges or () if r["tag"] == tag):
                if r[0] > stop:
                    kept.append(text[at : r[0]])
                    spans += 1
                stop = at = max(stop, r[1])
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in _RESULT.split(", ")]
        keep = [(n, batch.column(n)) for n in batch.schema.names if n not in ("tag", "packed", "ranges")]
        yield pa.RecordBatch.from_arrays([c for _, c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[n for n, _ in keep] + names)


def remove_repeats(docs: DataFrame, length: int = 100, crowd: int = 1 << 15) -> DataFrame:
    """docs(doc_id, text, ...), text replaced by n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    kept_text is the remaining bytes as text; a character of which only some
    bytes went is dropped from it (kept_sha256 is of the exact bytes). These
    columns, and tag, packed and ranges, replace columns of docs of their names.
    """
    taken = [x.split()[0] for x in _RESULT.split(", ")] + ["tag", "packed", "ranges"]
    own = steady(docs).drop(*taken).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = own.where("doc_id is not null")
    packed = packed_texts(known)
    packed = packed.where("doc_id is not null")
    ranges = repeated_ranges(known.select("doc_id", "text"), packed, length, crowd).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "stop")).alias("ranges"))
    joined = packed.join(ranges, "doc_id", "left").select(*packed.columns, "ranges")
    nameless = packed_texts(own.where("doc_id is null")).withColumn("ranges", F.lit(None).cast(joined.schema["ranges"].dataType))
    schema = StructType([f for f in packed.schema.fields if f.name not in ("tag", "packed")] + StructType.fromDDL(_RESULT).fields)
    return joined.mapInArrow(_cut, schema).unionByName(nameless.mapInArrow(_cut, schema))
