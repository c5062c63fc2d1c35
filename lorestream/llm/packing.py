"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most `capacity` tokens; only longer ones are
cut. Bins are filled from the histogram of piece lengths alone: each bin starts
with the longest length left and takes the combination of further lengths,
found by subset-sum dynamic programming on bitsets, that leaves least slack; the
combination is removed as often as the counts allow. The histogram has at most
`capacity` entries and every combination uses up one of them (or leaves fewer of
it than fit a bin), so the plan has a size bound whatever the data's size. Pieces
find their place in it by their rank among pieces of equal length.

Ranks come from row numbers within (length, hash bucket), plus counts of earlier
buckets, so that no length, however common, is one task's work. Texts are read
and tokenized once; only piece rows move.

Edge cases: null text is empty and gives one piece, the closing id; repeated
rows, also under one doc_id, are packed separately; the empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorestream.llm.common import byte_slices, materialize, release, steady

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMO, _KEPT, _LONGEST = 300_000, 60_000, 64
#: What the fast way knows: text up to U+017F without the one letter that lower case makes two of, and common
#: typographic marks; normal form leaves it as it is. Then the tokenizer's own parts, spelled out for these characters.
_PLAIN = re.compile("[\x00-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*")
_L, _N, _S = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PARTS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+")
_OWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Token ids of texts, part by part: right for tokenizers that lower case, drop white space and never cross it.

    Where the tokenizer cuts at `_OWN`, plain texts are cut so here and each different part goes to its byte-pair
    model alone; other texts are cut at white space and their words go through the whole tokenizer.

    Ids are packed little-endian 32-bit. A memo of two generations serves all tasks of a Python worker: when the
    newer is full the older goes, and words met again move to the newer. Long words are not kept; after a task only the
    words met first, mostly the common ones, stay.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        cut = json.loads(self.tokenizer.pre_tokenizer.__getstate__() if self.tokenizer.pre_tokenizer else "{}").get("pretokenizers", [])
        kinds = [n["type"] for n in json.loads(self.tokenizer.normalizer.__getstate__()).get("normalizers", [])] if self.tokenizer.normalizer else []
        self.by_parts = kinds == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": _OWN} and cut[0]["invert"]
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {i: spell(chr(i))[0][0] for i in [*range(0x180), *range(0x2010, 0x2028), 0x20AC]}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        release()

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(words), 4096):
            for e in self.tokenizer.encode_batch_fast(words[lo : lo + 4096], add_special_tokens=False):
                yield struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() and part.isprintable() else part.translate(self.spelled))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[str], parts: set[str]) -> None:
        """Words between white space as they are met, and parts of plain texts."""
        self.known.update((x, self._part(x)) for x in parts)
        plain = {w: _PARTS.findall(w.lower()) for w in words if self._plain(w)}
        self.known.update((w, b"".join(map(self._part, own))) for w, own in plain.items())
        other = list(words.difference(plain))
        self.known.update(zip(other, self._encoded(other)))

    def _plain(self, text: str) -> bool:
        return self.by_parts and (text.isascii() or _PLAIN.fullmatch(text) is not None) and "<|" not in text

    def _new(self, split: list[list[str]]) -> set[str]:
        """What the memo does not know; of that, what its older half knows goes to the newer."""
        missing = set().union(*split).difference(self.known)
        again = self.older.keys() & missing
        self.known.update((w, self.older[w]) for w in again)
        return missing - again

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = list(map(self._plain, texts))
        split = [_PARTS.findall(t.lower()) if p else t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for t, p in zip(texts, plain)]
        if len(self.known) > _MEMO:
            self.older, self.known = self.known, {}
        parts = self._new(list(itertools.compress(split, plain)))
        words = self._new([s for s, p in zip(split, plain) if not p]) - parts
        self.learn(words, parts)
        out = [b"".join(map(self.known.__getitem__, own)) for own in split]
        for w in itertools.chain(words, parts):
            if len(w) > _LONGEST:
                del self.known[w]
        return out

    def rest(self) -> None:
        """Keep the words met first, as fresh objects side by side: old ones would hold whole blocks of memory each."""
        words, ids = list(itertools.islice(self.known, _KEPT)), list(itertools.islice(self.known.values(), _KEPT))
        words, ids, ends = " ".join(words), b"".join(ids), [0, *itertools.accumulate(map(len, ids))]
        self.known, self.older = {}, {}
        if len(ends) > 1:
            self.known = dict(zip(words.split(" "), (ids[x:y] for x, y in itertools.pairwise(ends))))


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _tokenized(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        step, nth = 4 * capacity, 0  # nth: of the task's pieces, which deals rows alike to different buckets
        for batch in byte_slices(batches):
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part), nth))
                    nth += 1
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])
        ids_of.rest()
        release()

    return run


def fullest(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """Of lengths (falling) with counts, those whose sum comes nearest to room without passing it.

    Bit s of a state says that some choice so far has sum s.
    """
    mask = (1 << (room + 1)) - 1
    states, items = [1], []
    for length, count in zip(lengths, counts):
        if length > room:
            continue
        count, power = min(count, room // length), 1
        while count and not states[-1] >> room & 1:
            many = min(power, count)
            states.append(states[-1] | (states[-1] << length * many) & mask)
            items.append((length, many))
            count -= many
            power *= 2
        if states[-1] >> room & 1:
            break
    at = states[-1].bit_length() - 1
    chosen: list[int] = []
    for (length, many), before in zip(reversed(items), reversed(states[:-1])):
        if not before >> at & 1:
            at -= length * many
            chosen += [length] * many
    return chosen


def bin_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of one bin) until the histogram is used up."""
    left = {length: n for length, n in histogram.items() if n > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        top = order[0]
        left[top] -= 1
        bin_ = [top] + fullest(order, [left[x] for x in order], capacity - top)
        left[top] += 1
        used = {x: bin_.count(x) for x in set(bin_)}
        times = min(left[x] // n for x, n in used.items())
        out.append((times, bin_))
        for x, n in used.items():
            left[x] -= n * times
        order = [x for x in order if left[x]]
    return out


def _slots(bins: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of (length, rank), each for one place in the copies of one bin: first key, first sequence, offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, bin_ in bins:
        offset = 0
        for length in bin_:
            rank = used.get(length, 0)
            rows.append(((length << 40) + rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    key, first, offset = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((), (), ())))
    return key, first, offset


def _placed(slots: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, offset = slots
        for b in batches:
            mine = (b.column("length").to_numpy() << 40) + b.column("rank").to_numpy()
            at = np.searchsorted(key, mine, side="right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(first[at] + mine - key[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, buckets: int = 1024) -> DataFrame:
    """Per piece of docs(doc_id, text): its ids' place and checksum, sequence_id and offset there.

    tokenizer: file for the tokenizers library, of a tokenizer that drops white
    space and never crosses it.
    """
    own = steady(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(own.mapInArrow(_tokenized(tokenizer, capacity, end_id), f"{_PIECES}, nth long"), "pieces")
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "nth"))
    ranked = dealt.withColumn("nth", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("bucket", "before", "nth")
    return ranked.mapInArrow(_placed(_slots(bin_plan(histogram, capacity), capacity)), f"{_PIECES}, sequence_id long, offset long")
