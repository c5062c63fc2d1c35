"""Cutting texts into overlapping chunks at the coarsest separators that fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorestream.functions import text as T

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ", "")


def cut(text: str, size: int = 800, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of a text, separators at the ends of left pieces.

    Pieces are packed greedily; a chunk begins with the last `overlap` characters
    of the one flushed before and so may exceed size by that much. Larger pieces
    are cut by the remaining separators, at last by characters.
    """
    if len(text) <= size:
        return [text] if text else []
    mark, rest = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s and s in text), ("", ()))
    if not mark:
        step = max(1, size - overlap)
        return [text[at : at + size] for at in range(0, max(1, len(text) - overlap), step)]
    pieces = text.split(mark)
    pieces = [p + mark for p in pieces[:-1]] + pieces[-1:]
    out: list[str] = []
    held = ""
    for piece in filter(None, pieces):
        if len(piece) > size:
            if held:
                out.append(held)
            out += cut(piece, size, overlap, rest)
            held = ""
        elif len(held) + len(piece) > size and held:
            out.append(held)
            held = held[-overlap:] + piece if overlap else piece
        else:
            held += piece
    return out + ([held] if held else [])


def chunk(docs: DataFrame, size: int = 800, overlap: int = 200, shortest: int = 100) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, content) of docs(doc_id, text): chunks shorter than `shortest` go, the rest are renumbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cuts = [[c for c in cut(t or "", size, overlap) if len(c) >= shortest] for t in part.column("text").to_pylist()]
                many = np.array([len(c) for c in cuts], dtype=np.int32)
                first = np.repeat(np.cumsum(many) - many, many)
                index = np.arange(many.sum(), dtype=np.int32) - first.astype(np.int32)
                docs_ = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(many)), many)))
                content = pa.array([c for cs in cuts for c in cs], pa.string())
                yield pa.RecordBatch.from_arrays([docs_, pa.array(index), pa.array(np.repeat(many, many)), content], names=["doc_id", "chunk_index", "total_chunks", "content"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk_index int, total_chunks int, content string")


def with_ids(chunks: DataFrame, source: str = "source", page: str = "page_number") -> DataFrame:
    """chunks with the id that names source, page and index."""
    return chunks.withColumn("chunk_id", T.chunk_id(chunks[source], chunks[page], chunks["chunk_index"]))
