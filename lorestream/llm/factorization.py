"""Quality classifier: a factorisation machine.

Inputs are hashed words, hashed word shapes and structure statistics of the text
with its length as metadata. Pairwise interactions of all inputs have low rank,
score = w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
which the sum-of-squares identity makes linear in the number of inputs.

Training uses at most `train_rows` labelled rows (a documented bound; those of
least hash), in one task; scoring reads every whole text once, where it lies.
The model has a fixed size and is broadcast.

Edge cases: null and empty texts score from their statistics alone; null labels
are not learned from, repeated labels of a document count once (the greater); of several
texts under one labelled doc_id the least is learned from; without labels all scores are 0.5; repeated rows give repeated results; null
doc_ids are scored and never held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestream.llm.common import byte_slices, steady
from lorestream.llm.rolling import Rolling, U

WORDS = 1 << 15
_CLASS = np.full(256, 5, dtype=np.int64)  # 0 blank, 1 lower, 2 upper, 3 digit, 4 symbol, 5 beyond ASCII
_CLASS[:128] = 4
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SHAPES = 6**4
STATS = ("bias", "length", "blank", "lower", "upper", "digit", "symbol", "beyond", "word_length", "distinct", "twice_lines", "line_length", "marks")
SIZE = WORDS + SHAPES + len(STATS)
_MARKS = np.zeros(256, dtype=np.int64)
_MARKS[[ord(c) for c in "#*$%&|<>!"]] = 1
_PART = 1 << 20


@dataclass
class Rows:
    """Sparse inputs of some texts, row after row."""

    cuts: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _part(texts: list[bytes], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of texts that together fit a buffer."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.concatenate([[0], ends])
    kind = _CLASS[raw]
    solid = kind > 0
    start = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
    stop = np.flatnonzero(~solid & np.append(False, solid[:-1]))
    words = np.searchsorted(start, cuts)
    owner = np.repeat(np.arange(len(texts)), np.diff(words))
    low = Rolling(_LOWER[raw])
    key = owner * WORDS + (low(start, stop) >> U(49)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    n_words = np.diff(words)
    row = key // WORDS
    weight = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=count, minlength=len(texts)))
    value = weight / np.maximum(norm[row], 1)
    shape = ((kind[start] * 6 + kind[np.minimum(start + 1, stop - 1)]) * 6 + kind[np.maximum(stop - 2, start)]) * 6 + kind[stop - 1]
    skey, scount = np.unique(owner * SHAPES + shape, return_counts=True)
    srow = skey // SHAPES
    size = np.maximum(np.diff(cuts) - 1, 1)
    share = [_sums(kind == k, cuts) / size for k in range(6)]
    line_end = np.flatnonzero(raw == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_owner = np.searchsorted(ends, line_end, side="right")
    full = line_end - line_start > 8
    lines = np.stack([line_owner[full], low(line_start[full], line_end[full]).view(np.int64)])
    n_lines = np.bincount(line_owner[full], minlength=len(texts))
    once = np.bincount(np.unique(lines, axis=1)[0], minlength=len(texts)) if lines.size else n_lines
    stats = [
        np.ones(len(texts)),
        np.log1p(chars) / 10,
        *share,
        np.minimum((size - _sums(kind == 0, cuts)) / np.maximum(n_words, 1) / 10, 3),
        np.bincount(row, minlength=len(texts)) / np.maximum(n_words, 1),
        1 - once / np.maximum(n_lines, 1),
        np.log1p(size / np.maximum(n_lines, 1)) / 10,
        np.minimum(_sums(_MARKS[raw], cuts) / np.maximum(n_words, 1), 3),
    ]
    every = np.arange(len(texts))
    rows = np.concatenate([row, srow, *[every] * len(stats)])
    index = np.concatenate([key % WORDS, WORDS + skey % SHAPES, *(np.full(len(texts), WORDS + SHAPES + i) for i in range(len(stats)))])
    values = np.concatenate([value, scount / np.maximum(n_words[srow], 1), *stats])
    order = np.argsort(rows, kind="stable")
    return rows[order], index[order], values[order]


def inputs(texts: list[bytes], chars: np.ndarray) -> Rows:
    """Inputs of texts; chars is the length metadata."""
    out: list[tuple] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < _PART):
            size += len(texts[hi]) + 1
            hi += 1
        row, index, value = _part(texts[lo:hi], chars[lo:hi])
        out.append((row + lo, index, value))
        lo = hi
    row, index, value = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    return Rows(cuts, index.astype(np.int32), value.astype(np.float32))


@dataclass
class Machine:
    """Weights; score() is the linear-time form."""

    w: np.ndarray
    v: np.ndarray

    @classmethod
    def blank(cls, rank: int, seed: int) -> Machine:
        return cls(np.zeros(SIZE, dtype=np.float32), np.random.default_rng(seed).normal(0, 0.02, (SIZE, rank)).astype(np.float32))

    def parts(self, x: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins, the sums of each factor by row, and v of each input times its value."""
        vx = self.v[x.index] * x.value[:, None]
        sums = np.add.reduceat(vx, x.cuts[:-1], axis=0)  # every row has its statistics, so none is empty
        square = np.add.reduceat((vx * vx).sum(axis=1), x.cuts[:-1])
        linear = np.add.reduceat(self.w[x.index] * x.value, x.cuts[:-1])
        return linear + 0.5 * ((sums * sums).sum(axis=1) - square), sums, vx

    def score(self, x: Rows) -> np.ndarray:
        if len(x.cuts) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.parts(x)[0].astype(np.float64), -30, 30)))


def train(x: Rows, y: np.ndarray, rank: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 11) -> Machine:
    """Logistic loss by Adagrad on small batches, in an order drawn from the seed."""
    model = Machine.blank(rank, seed)
    rng = np.random.default_rng(seed)
    gw, gv = np.full(SIZE, 1e-4, dtype=np.float32), np.full((SIZE, rank), 1e-4, dtype=np.float32)
    sizes = np.diff(x.cuts)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            take = np.concatenate([np.arange(x.cuts[r], x.cuts[r + 1]) for r in rows])
            part = Rows(np.concatenate([[0], np.cumsum(sizes[rows])]), x.index[take], x.value[take])
            margin, sums, vx = model.parts(part)
            off = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]).astype(np.float32)
            g = np.repeat(off, sizes[rows]) * part.value / len(rows)
            used, at = np.unique(part.index, return_inverse=True)
            dw = np.bincount(at, weights=g, minlength=len(used)).astype(np.float32) + decay * model.w[used]
            each = g[:, None] * (np.repeat(sums, sizes[rows], axis=0) - vx)
            dv = np.stack([np.bincount(at, weights=each[:, f], minlength=len(used)) for f in range(rank)], axis=1).astype(np.float32) + decay * model.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= rate / 2 * dv / np.sqrt(gv[used])
    return model


def _texts(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
    return texts, batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)


def _input_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches):
        x = inputs(*_texts(batch))
        cuts = pa.array(x.cuts.astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (x.index, x.value)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists], names=["doc_id", "y", "index", "value"])


def _trained(how: dict):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        x = Rows(np.concatenate([[0], np.cumsum(rows["index"].map(len))]), np.concatenate(rows["index"].to_list()), np.concatenate(rows["value"].to_list()))
        model = train(x, rows["y"].to_numpy(), **how)
        return pd.DataFrame({"w": [model.w.tobytes()], "v": [model.v.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 8192, rank: int = 8, **how) -> Machine:
    """A machine learned from labels(doc_id, y 0/1, not null) of at most train_rows documents."""
    chosen = labels.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("text", "n_chars")).alias("least")).select("doc_id", "y", "least.*")
    rows = sample.mapInArrow(_input_rows, "doc_id long, y int, index array<int>, value array<float>")
    found = rows.groupBy(F.lit(0).alias("one")).applyInPandas(_trained({"rank": rank, **how}), "w binary, v binary").collect()
    if not found:
        return Machine(np.zeros(SIZE, dtype=np.float32), np.zeros((SIZE, rank), dtype=np.float32))
    return Machine(np.frombuffer(found[0].w, dtype=np.float32), np.frombuffer(found[0].v, dtype=np.float32).reshape(SIZE, rank))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            score = model.value.score(inputs(*_texts(part)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **how) -> DataFrame:
    """Per row of docs(doc_id, text, n_chars): held_out, score, predicted.

    labels has doc_id and quality. Rows whose crc32(doc_id as text) mod folds is
    held are not learned from.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held
    own = steady(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("n_chars").cast("long"), F.length("text"), F.lit(0)).alias("n_chars"))
    seen = labels.where("quality is not null and doc_id is not null").where(~fold).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own, seen, **how))
    scored = own.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
