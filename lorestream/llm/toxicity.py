"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z) and hashed n-grams of their UTF-8 bytes, white space
as one blank, are features, present or absent. On the labelled sample each
feature has a log ratio of its smoothed rates in toxic and other documents; the
features of greatest evidence are kept, and a logistic regression is learned on
presence times ratio. Scoring hashes every place of every whole text, looks up
which few are kept features, and adds weight times ratio of the distinct ones.

Training uses at most `train_rows` labelled rows (a documented bound; those of
least hash). Their n-gram counts are aggregated by Spark; only the kept features
of each sample row reach the one task that learns. The model has a fixed size and
is broadcast; scoring has no shuffle.

Edge cases: null and empty texts score by the intercept; null labels are not
learned from, repeated labels of a document count once (the greater); of
several texts under one labelled doc_id the least is learned from; without
labels all scores are 0.5; repeated rows give repeated results; null doc_ids are
scored and never held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestream.llm.common import byte_slices, discard, materialize, steady, text_bytes
from lorestream.llm.rolling import GOLDEN, Rolling, U, mix

GRAMS = (4, 5, 6)
BITS = 20
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[[9, 10, 11, 12, 13]] = 32
_PART = 1 << 19
_ENTRIES = 1 << 20


def _places(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, start of each text, feature of every place) for parts of texts and each n."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < _PART):
            size += len(texts[hi]) + 2
            hi += 1
        raw = _MAP[np.frombuffer(b" " + b"  ".join(texts[lo:hi]) + b" " * max(GRAMS), dtype=np.uint8)]
        sizes = np.array([len(t) + 2 for t in texts[lo:hi]])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        roll = Rolling(raw)
        for n in GRAMS:
            hashes = roll.grams(n)[: cuts[-1]]
            yield lo, n, cuts, (mix(hashes + U(n * GOLDEN & (1 << 64) - 1)) >> U(64 - BITS)).astype(np.int32)
        lo = hi


def _inside(cuts: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places, those whose n-gram stays in one text (with a blank on each side), and their rows."""
    row = np.searchsorted(cuts, at, side="right") - 1
    good = at + n <= cuts[row + 1]
    return at[good], row[good]


def features(texts: list[bytes], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), distinct, of all features or of those where kept is true."""
    keys = []
    for lo, n, cuts, feature in _places(texts):
        at = np.arange(len(feature)) if kept is None else np.flatnonzero(kept[feature])
        at, row = _inside(cuts, at, n)
        keys.append((row + lo).astype(np.int64) << BITS | feature[at])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key >> BITS, key & (1 << BITS) - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, other): documents of a task that have a feature."""
    toxic, other = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    for part in byte_slices(batches):
        y = part.column("y").to_numpy()
        row, feature = features(text_bytes(part))
        toxic += np.bincount(feature[y[row] == 1], minlength=1 << BITS)
        other += np.bincount(feature[y[row] == 0], minlength=1 << BITS)
    some = np.flatnonzero(toxic + other)
    for at in range(0, len(some), 1 << 16):
        f = some[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(toxic[f]), pa.array(other[f])], names=["feature", "toxic", "other"])


def _kept_rows(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << BITS, dtype=bool)
        mask[kept.value] = True
        for part in byte_slices(batches):
            row, feature = features(text_bytes(part), mask)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], names=["doc_id", "y", "features"])

    return run


@dataclass
class Linear:
    """Kept features in rising order, the weight times ratio of each, and an intercept."""

    kept: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[bytes], mask: np.ndarray) -> np.ndarray:
        row, feature = features(texts, mask)
        margin = np.bincount(row, weights=self.weight[np.searchsorted(self.kept, feature)], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def learn(cuts: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 2e-3, positive: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by accelerated gradient steps with L2 decay.

    Row i has the columns column[cuts[i] : cuts[i + 1]], each with the value
    scale[column]. Rows are worked on in parts of bounded size. positive: weight
    of a toxic row against another, as toxic rows are few.
    """
    size = len(scale)
    w = np.zeros(size + 1)
    last = w.copy()
    share = np.where(y == 1, positive, 1.0)
    share /= share.sum()
    bounds = [0]
    while bounds[-1] < len(y):
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(cuts, cuts[bounds[-1]] + _ENTRIES, side="right")) - 1))
    parts = [(slice(lo, hi), column[cuts[lo] : cuts[hi]], np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(cuts[lo : hi + 1]))) for lo, hi in zip(bounds, bounds[1:])]
    square = scale * scale
    trace = sum(float((share[at] * (np.bincount(row, weights=square[col], minlength=at.stop - at.start) + 1)).sum()) for at, col, row in parts)
    rate = 4 / trace  # the trace bounds the curvature
    for t in range(steps):
        ahead = w + (t / (t + 3)) * (w - last)
        scaled = ahead[:-1] * scale
        gradient = np.zeros(size + 1)
        for at, col, row in parts:
            margin = np.bincount(row, weights=scaled[col], minlength=at.stop - at.start) + ahead[-1]
            off = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[at]) * share[at]
            gradient[:-1] += np.bincount(col, weights=off[row], minlength=size)
            gradient[-1] += off.sum()
        gradient[:-1] = gradient[:-1] * scale + decay / len(y) * ahead[:-1]
        last, w = w, ahead - rate * gradient
    return w[:-1], float(w[-1])


def _learned(kept, ratios):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.select(["doc_id", "y", "features"]).sort_by("doc_id").combine_chunks()
        lists = rows.column("features").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        cuts = lists.offsets.to_numpy().astype(np.int64)
        column = np.searchsorted(kept.value, lists.values.to_numpy(zero_copy_only=False)).astype(np.int32)
        w, b = learn(cuts, column, ratios.value, rows.column("y").to_numpy().astype(np.float64))
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "b": [b]})

    return run


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, size: int = 4096, least: int = 3) -> Linear:
    """A model learned from labels(doc_id, y 0/1, not null) of at most train_rows documents."""
    spark = docs.sparkSession
    chosen = labels.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    sample = materialize(texts, "sample")
    n = sample.agg(F.sum("y").alias("toxic"), F.count("*").alias("all")).first()
    if not n.all:
        discard(sample)
        return Linear(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
    counts = sample.mapInArrow(_counts, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") + F.col("other") >= least)
    p, q = (F.col("toxic") + 1) / F.lit(n.toxic + 2), (F.col("other") + 1) / F.lit(n.all - n.toxic + 2)
    evidence = (p - q) * F.log(p / q)
    top = counts.select("feature", F.log(p / q).alias("ratio"), evidence.alias("evidence")).orderBy(F.desc("evidence"), "feature").limit(size).toPandas().sort_values("feature")
    kept = spark.sparkContext.broadcast(top["feature"].to_numpy(dtype=np.int64))
    ratios = spark.sparkContext.broadcast(top["ratio"].to_numpy(dtype=np.float64))
    rows = sample.mapInArrow(_kept_rows(kept), "doc_id long, y int, features array<int>")
    model = rows.groupBy(F.lit(0).alias("one")).applyInArrow(_learned(kept, ratios), "w binary, b double").first()
    discard(sample)
    return Linear(kept.value, np.frombuffer(model.w, dtype=np.float64) * ratios.value, model.b)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << BITS, dtype=bool)
        mask[model.value.kept] = True
        for part in byte_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.value.score(text_bytes(part), mask))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **how) -> DataFrame:
    """Per row of docs(doc_id, text): held_out, score, predicted.

    labels has doc_id and toxic. Rows whose crc32(doc_id as text) mod folds is
    held are not learned from.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held
    own = steady(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = labels.where("toxic is not null and doc_id is not null").where(~fold).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own, seen, **how))
    scored = own.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
