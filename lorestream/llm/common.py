"""Helpers shared by the corpus operators: shared-folder tables, grouped Arrow
iteration and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this package: maximal runs of characters other than
#: space and U+0009..U+000D. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lorestream-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorestream-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for df in tables:
        if path := _places.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


_ROWS = 4000


def steady(df: DataFrame) -> DataFrame:
    """df, after lowering the session's Arrow batches to 4,000 rows where they are larger.

    Whole texts go through Python workers; each holds a batch, and so does the
    JVM on both sides of it. The setting stays, as plans read it when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > _ROWS:
        df.sparkSession.conf.set(key, str(_ROWS))
    return df


_at_rest: list[Callable[[], None]] = []


def at_rest(forget: Callable[[], None]) -> None:
    """Call `forget` whenever a task of this worker has ended."""
    _at_rest.append(forget)


def release() -> None:
    """Give a worker's free memory back; workers wait for the next stage with what they hold."""
    for forget in _at_rest:
        forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def _frugal() -> None:
    """From now on freed blocks of 1 MB and more go back to the system at once, whatever lies above them."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def byte_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most so many bytes in a string or binary column, or with one row."""
    _frugal()
    for batch in batches:
        n = batch.num_rows
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def text_bytes(batch: pa.RecordBatch) -> list[bytes]:
    """The column text as UTF-8, null as empty."""
    return [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables made of complete runs of equal keys, from batches sorted by key.

    Memory: one batch plus the longest run.
    """
    _frugal()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1])
        before = held[-1].column(key)[-1].as_py() if held else None
        if held and before != keys[0].item():
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            last = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
    held = []
    release()


def find_roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of an edge list that fits a task: its vertices and the smallest vertex of the component of each."""
    names, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            return names, names[root]
        root = after


def _shrink(most: int):
    """Replace each block of up to `most` edges by stars around the smallest vertices of its parts."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        v, r = find_roots(t.column("a").to_numpy(), t.column("b").to_numpy())
        keep = v != r
        return pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(r[keep])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def components(edges: DataFrame, one_task: int = 500_000) -> DataFrame:
    """(id, component): the smallest vertex reachable, for every vertex of edges(a, b).

    Each task first replaces blocks of its edges by stars. What is left is solved
    at once by one task where it is counted and has at most `one_task` edges, 16
    bytes each. Otherwise alternating large-star and small-star rounds, each a
    few joins and aggregations on small integers and written to the shared
    folder, go on until nothing changes; their number grows with the logarithm of
    the largest component, and no component is ever gathered in one place. Self
    links vanish; vertices without other links are absent. Ids are 64-bit
    integers and not null.
    """
    schema = "a long, b long"
    now = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_shrink(500_000), schema), "edges")
    if now.count() <= one_task:
        last, now = now, materialize(now.repartition(1).mapInArrow(_shrink(one_task + 1), schema), "edges")
        discard(last)
        return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, now = now, materialize(small.where("a <> b").distinct(), "edges")
        discard(last)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen.n, seen.x) == mark or not seen.n:
            break
        mark = (seen.n, seen.x)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
