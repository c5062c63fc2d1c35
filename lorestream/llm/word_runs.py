"""Periodic runs of words, found by the LZ blocks of each text.

A run is a stretch of words with smallest period q and at least `least` words and
`times` periods that no neighbouring word extends. Each task takes its texts in
slices of about 1 MB, a longer text alone, and works on all texts of a slice at
once; words of different texts are different symbols, so nothing crosses texts:

1. Prefix doubling sorts the suffixes; only groups that are not single are sorted
   again. The ranks of each level stay: equal ranks at level k are equal stretches
   of 2^k words, so a few lookups extend any two places forwards or backwards.
2. The suffix array and its LCP give, for each place, the longest factor that also
   starts earlier (LPF) and where; the smaller places before and after it in the
   suffix array are found by pointer jumping.
3. LPF gives the LZ blocks. A run of four periods or more crosses or touches an end
   of a block, one side of that end holds two periods, and its period is at most
   the length of the block on that side; or it lies strictly inside a block.
   Main's extensions to both sides of each end find the first kind, over all ends
   and periods at once. Equal stretches keep their smallest period.
4. The second kind are copies: blocks from left to right, runs in buckets by start,
   those inside a block's earlier place are copied.

Steps 1 to 3 are array operations over whole slices, step 4 and the walk from
block to block are loops. One pass over each row, no shuffle; memory is about
200 bytes a word of the longest text.

Edge cases: null, empty and wordless texts have no runs, four nulls and digests of
the empty string; repeated rows give repeated results; a null doc_id is kept; other
columns pass through, and result columns replace clashing ones. `with_runs` needs
text alone; `planted` says how many words from where on are overwritten.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestream.llm.common import byte_slices, steady, text_bytes

RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Suffixes:
    """Suffix array of several texts of symbols that they do not share; ends[i] is the end of the text of place i."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n = len(symbols)
        self.starts, self.ends = starts, ends
        self.order = np.argsort(symbols, kind="stable")
        first = np.empty(n, dtype=bool)
        first[:1] = True
        sorted_ = symbols[self.order]
        first[1:] = sorted_[1:] != sorted_[:-1]
        heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n, dtype=np.int32)
        rank[self.order] = heads
        #: parted[r]: the level at which r's suffix and the one before it part.
        self.levels, self.parted = [rank], np.where(first, 0, -1)
        open_ = self._shared(np.arange(n), first)
        step = 1
        while len(open_):
            at = self.order[open_]
            then = at + step
            inside = then < ends[at]
            key = rank[at].astype(np.int64) * (n + 1)
            key[inside] += rank[then[inside]] + 1
            by = np.argsort(key, kind="stable")
            self.order[open_] = at[by]
            key = key[by]
            first = np.empty(len(key), dtype=bool)
            first[0] = True
            first[1:] = key[1:] != key[:-1]
            new = open_[first]
            self.parted[new[self.parted[new] < 0]] = len(self.levels)
            heads = open_[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            rank = rank.copy()
            rank[self.order[open_]] = heads
            self.levels.append(rank)
            open_ = self._shared(open_, first)
            step *= 2

    @staticmethod
    def _shared(places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of runs of equal keys that begin where `first`, those of more than one place."""
        single = first.copy()
        single[:-1] &= first[1:]
        return places[~single]

    def common(self, a: np.ndarray, b: np.ndarray, top: int | None = None) -> np.ndarray:
        """How many symbols are the same from places a and b on; under 2^top where top is given."""
        a, b, n = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1 if top is None else top, -1, -1):
            rank, last = self.levels[k], len(self.ends) - 1
            same = (rank[np.minimum(a, last)] == rank[np.minimum(b, last)]) & (a <= last) & (b <= last)
            size = same.astype(np.int64) << k
            a += size
            b += size
            n += size
        return n

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are the same before places a and b, of one text."""
        a, b, n, low = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64), self.starts[np.minimum(a, len(self.starts) - 1)]
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            x, y = a - (1 << k), b - (1 << k)
            same = (x >= low) & (y >= low)
            same &= rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)]
            size = same.astype(np.int64) << k
            a -= size
            b -= size
            n += size
        return n

    def lcp(self) -> np.ndarray:
        """Symbols that each suffix shares with the one before it in order."""
        out = np.zeros(len(self.order), dtype=np.int64)
        todo = np.flatnonzero(self.parted > 0)
        todo = todo[np.argsort(-self.parted[todo], kind="stable")]
        level = self.parted[todo]
        out[todo] = np.int64(1) << (level - 1)
        a, b = self.order[todo - 1] + out[todo], self.order[todo] + out[todo]
        last = len(self.order) - 1
        for k in range(len(self.levels) - 2, -1, -1):
            m = int(np.searchsorted(-level, -(k + 1), side="left"))  # those that part above level k + 1
            if m:
                x, y, rank = a[:m], b[:m], self.levels[k]
                same = (x <= last) & (y <= last) & (rank[np.minimum(x, last)] == rank[np.minimum(y, last)])
                size = same.astype(np.int64) << k
                x += size
                y += size
        out[todo] = b - self.order[todo]
        return out

    def longest_previous(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of the longest factor that also starts earlier in its text, and where."""
        n = len(self.order)
        lcp = self.lcp()
        best, where = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        for turned in (False, True):
            places = self.order[::-1] if turned else self.order
            shared = np.concatenate([[0], lcp[:0:-1]]) if turned else lcp
            value = np.concatenate([[-1], places])
            least = np.concatenate([[0], shared])
            to = np.where(least > 0, np.arange(-1, n), 0)
            open_ = np.flatnonzero(value[to] > value)
            while len(open_):
                at = to[open_]
                low, further = np.minimum(least[open_], least[at]), to[at]
                least[open_], to[open_] = low, further
                open_ = open_[value[further] > value[open_]]
            better = np.flatnonzero(least[1:] > best[places])
            best[places[better]] = least[1:][better]
            where[places[better]] = value[to[1:][better]]
        return best, where


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks: each as long as the longest previous factor, or one symbol."""
    follow, at, out = (np.arange(len(length)) + np.maximum(length, 1)).tolist(), 0, []
    while at < len(follow):
        out.append(at)
        at = follow[at]
    return np.array(out, dtype=np.int64)


def _periods(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, p) with p from 1 to counts[i]."""
    which = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return which, np.arange(len(which)) - np.repeat(ends - counts, counts) + 1


def _at_ends(s: Suffixes, cut: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that cross or touch an end of a block."""
    found, rank = [], s.levels[0]
    for after in (True, False):
        if after:  # a block begins with two periods
            which, p = _periods(sizes // 2)
            a, b = cut[which], cut[which] + p
            same = rank[a] == rank[b]
        else:  # two periods come before the end of a block
            which, p = _periods(sizes - 1)
            b = cut[which] + sizes[which]
            a = b - p
            same = rank[a - 1] == rank[b - 1]
        a, b, p = a[same], b[same], p[same]
        right = s.common(a, b) if after else None
        left = s.common_before(a, b)
        keep = (right if after else left) >= p
        a, b, p, left = a[keep], b[keep], p[keep], left[keep]
        # At the end of a text b lies behind it, where nothing follows.
        right = right[keep] if after else np.where(b < s.ends[a], s.common(a, b), 0)
        long = left + right + p >= np.maximum(least, times * p)
        found.append((a[long] - left[long], b[long] + right[long], p[long]))
    start, end, period = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def find_runs(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) by start, then period, of texts laid end to end; `times` is 4 at least."""
    if times < 4:
        raise ValueError("ends of blocks are shown to find runs of four periods or more")
    if not len(symbols):
        return []
    s = Suffixes(symbols, starts, ends)
    length, where = s.longest_previous()
    cut = blocks(length)
    sizes = np.diff(np.append(cut, len(symbols)))
    first = list(zip(*(x.tolist() for x in _at_ends(s, cut, sizes, least, times))))
    bucket: dict[int, set[tuple[int, int]]] = {}
    for a, b, p in first:
        bucket.setdefault(a, set()).add((b, p))
    order = sorted(bucket)
    long = np.flatnonzero(sizes >= least + 2) if order else []
    for at, size, source in zip(cut[long].tolist(), sizes[long].tolist(), where[cut[long]].tolist()) if len(long) else ():
        by = bisect_right(order, source)
        while by < len(order) and order[by] < source + size:
            inside = [(b, p) for b, p in bucket[order[by]] if b < source + size]
            if inside:
                to = order[by] + at - source
                if to not in bucket:
                    bucket[to] = set()
                    insort(order, to)
                bucket[to].update((b + at - source, p) for b, p in inside)
            by += 1
    return [(a, b, p) for a in order for b, p in sorted(bucket[a], key=lambda x: x[1])]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbols: list[int] = []
    base, sizes = 0, []
    for words in texts:
        known: dict[bytes, int] = {}
        for w in words:
            known.setdefault(w, base + len(known))
        symbols.extend(map(known.__getitem__, words))
        base += len(known)
        sizes.append(len(words))
    ends = np.cumsum(sizes)
    return np.array(symbols, dtype=np.int64), np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)


def _spotted(names: list[str], plant: tuple[str, str] | None, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            texts = [t.split() for t in text_bytes(batch)]
            if plant:
                marks = (batch.column(c).to_pylist() for c in plant)
                for words, seed, shape in zip(texts, *marks):
                    if seed is not None and words:
                        a = seed % len(words)
                        p = 1 + (len(words) - a) // shape
                        part = words[a : a + p]
                        words[a:] = (part * (-(-(len(words) - a) // p)))[: len(words) - a]
            symbols, starts, ends = _numbered(texts)
            found: list[list[dict]] = [[] for _ in texts]
            keep: list[bytearray | None] = [None] * len(texts)
            bounds = np.cumsum([0, *map(len, texts)])
            for a, b, p in find_runs(symbols, starts, ends, least, times):
                i = int(np.searchsorted(bounds, a, side="right")) - 1
                low = int(bounds[i])
                found[i].append({"start": a - low, "length": b - a, "period": p})
                keep[i] = keep[i] or bytearray(repeat(1, len(texts[i])))
                keep[i][a - low + p : b - low] = bytes(b - a - p)
            left = [b" ".join(compress(w, k) if k else w).decode() for w, k in zip(texts, keep)]
            own = [(n, batch.column(n)) for n in names]
            new = [pa.array(list(map(len, texts)), pa.int64()), pa.array(found, _RUNS), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([c for _, c in own] + new, names=[n for n, _ in own] + ["n_words", "runs", "collapsed"])

    return run


def with_runs(docs: DataFrame, least: int = 6, times: int = 4, planted: tuple[Column, Column] | None = None) -> DataFrame:
    """docs(text, ...) with n_words, its runs by start and period, and `collapsed`: its words but for what repeats after a run's first period.

    planted: (seed, shape), whole numbers; where the seed is not null, words from seed % n on repeat the
    first 1 + (n - seed % n) // shape of them before runs are sought.
    """
    own = steady(docs).drop("n_words", "runs", "collapsed")
    names = own.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    if planted:
        own = own.withColumns({"planted_seed": planted[0].cast("long"), "planted_shape": planted[1].cast("long")})
    return own.mapInArrow(_spotted(names, ("planted_seed", "planted_shape") if planted else None, least, times), f"{schema}, {RESULT}")


def summary(docs: DataFrame) -> DataFrame:
    """op11's columns: doc_id, n_runs, the longest run, digests of all runs and of the collapsed text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    found = with_runs(docs.select("doc_id", "text"), planted=(F.when(h % 10 == 0, g), 3 + g % 8)).drop("text")
    top = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1))
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
        .otherwise(F.when(x["period"] < y["period"], -1).otherwise(F.when(x["period"] > y["period"], 1).otherwise(0))),
    )[0]
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    told = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    out = found.withColumn("top", F.when(F.size("runs") > 0, top))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
