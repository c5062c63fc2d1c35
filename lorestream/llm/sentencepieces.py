"""Encoding and decoding with a sentencepiece file, by a table of distinct chunks.

A text becomes its marked form, a mark for each space and one in front. Where no
piece of the vocabulary holds a mark after another character, no merge crosses the
place before a run of marks, and likewise none crosses a newline where no piece
holds one. So the text falls into chunks, a run of marks or a newline each with
what follows up to the next, whose ids do not depend on each other. Both conditions
are tested when the file is read, as is that text is not rewritten.

Each task takes its texts in slices of about 1 MB. The chunks of a slice go into a
table of distinct ones: those met for the first time are segmented by the library,
all at once, and the table holds their ids. Texts are then joined from the table by
position, and decoded from the joined ids. The table stays for the next slices, up to
about 64 MB. A table for the whole corpus would have to be joined to every word of
every text, in a shuffle larger than the texts; one for each task moves nothing.

Long texts are joined in parts of 100,000 chunks, and their digests are fed part by
part where `digests` is all that is asked. A chunk is segmented whole: a text of one
unbroken word takes the library about 100 bytes a character.

Edge cases: a null text is an empty one, whose ids are begin and end; repeated rows
give repeated results; a null doc_id is kept; other columns pass through, and result
columns replace clashing ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorestream.llm.common import at_rest, byte_slices, steady

MARK = "▁"
_CHUNK = re.compile("▁+[^▁\n]*|\n[^▁\n]*")
_BYTES, _PART = 64_000_000, 100_000


class Pieces:
    """A sentencepiece file whose pieces stay within chunks, with the table of chunks met so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [m.id_to_piece(i) for i in range(size) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("pieces of this file cross marks or newlines")
        if m.encode(" \ta  ﬁ ", out_type=str)[:2] != [MARK * 2, "<0x09>"] or m.normalize("a  ﬁ ") not in ("a  ﬁ ", "▁a▁▁ﬁ▁"):
            raise ValueError("this file rewrites texts, or takes them without a mark in front")
        self.begin, self.end = m.bos_id(), m.eos_id()
        self.decoded = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        # A newline in front keeps the library's own mark away from the chunk.
        self.skip = len(m.encode("\n"))
        self.forget()

    def forget(self) -> None:
        #: The table: the number of each chunk; its ids are flat[ends[number - 1] : ends[number]].
        self.table: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)
        self.held = 0

    def learn(self, chunks: list[str]) -> None:
        """Have all these chunks in the table."""
        if self.held > _BYTES:
            self.forget()
        table = self.table
        new = list({c for c in chunks if c not in table})
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            found = self.model.encode(["\n" + c for c in part], num_threads=1)
            sizes = np.array(list(map(len, found)))
            flat = np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(sizes.sum()))
            inner = np.ones(len(flat), dtype=bool)
            for i in range(self.skip):
                inner[np.cumsum(sizes) - sizes + i] = False
            table.update(zip(part, range(len(table) + 1, len(table) + 1 + len(part))))
            self.flat = np.concatenate([self.flat, flat[inner]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes - self.skip)])
            self.held += 160 * len(part) + 2 * sum(map(len, part)) + 4 * len(flat)

    def join(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these chunks one after the other, and how many each has."""
        self.learn(chunks)
        at = np.fromiter(map(self.table.__getitem__, chunks), np.int64, len(chunks))
        ends, starts = self.ends[at], self.ends[at - 1]
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.decoded.__getitem__, ids.tolist()))


def marked(text: str) -> str:
    """The text with a mark for each space and one in front; an empty one stays so."""
    return MARK + text.replace(" ", MARK) if text else ""


def _parts(text: str) -> Iterator[list[str]]:
    found = (x.group() for x in _CHUNK.finditer(marked(text)))
    while part := list(islice(found, _PART)):
        yield part


def encode_parts(pieces: Pieces, texts: list[str]) -> Iterator[Iterator[tuple[np.ndarray, bytes]]]:
    """For each text its (ids, bytes they decode to), part by part, without begin and end."""
    small = [_CHUNK.findall(marked(t)) if len(t) < 1 << 20 else [] for t in texts]
    ids, sizes = pieces.join(list(chain.from_iterable(small)))
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, small)])].tolist()

    def long(text: str) -> Iterator[tuple[np.ndarray, bytes]]:
        for n, chunks in enumerate(_parts(text)):
            part, _ = pieces.join(chunks)
            yield part, pieces.decode(part)[not n :]

    for text, a, b in zip(texts, ends, ends[1:]):
        # The first byte is the space of the mark in front.
        yield iter([(ids[a:b], pieces.decode(ids[a:b])[1:])]) if len(text) < 1 << 20 else long(text)


#: Files read by this worker.
_files: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _files:
        _files[path] = Pieces(path)
    return _files[path]


def _forget() -> None:
    """Between tasks tables go, vocabularies stay."""
    for p in _files.values():
        p.forget()


at_rest(_forget)


def _run(path: str, names: list[str], digests: bool):
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        begin, end = (np.array([i], dtype="<u4") for i in (pieces.begin, pieces.end))
        for batch in byte_slices(batches):
            out = []
            for parts in encode_parts(pieces, [t or "" for t in batch.column("text").to_pylist()]):
                if digests:
                    n, ids, text = 2, hashlib.sha256(begin), hashlib.sha256()
                    for i, d in parts:
                        n += len(i)
                        ids.update(i)
                        text.update(d)
                    ids.update(end)
                    out.append((n, ids.hexdigest(), text.hexdigest()))
                else:
                    got = list(parts)
                    out.append((np.concatenate([begin, *(i for i, _ in got), end]).astype(np.int32), b"".join(d for _, d in got).decode()))
            kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            new = [pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, names=names + columns)

    return run


def encoded(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """docs(text, ...) with `ids`, begin and end among them, and `decoded`; or with n_tokens, ids_sha256 and decoded_sha256."""
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    own = steady(docs).drop(*(x.split()[0] for x in result.split(", ")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(_run(path, own.columns, digests), f"{schema}, {result}")
