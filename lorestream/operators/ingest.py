"""Ingest as a transaction over plain tables, and incremental sync on top of it.

A store is a folder with three tables, each split by ingest version:

- `chunks`: the chunks of each file, written first and read by nobody yet;
- `outcomes`: what became of each file: accepted, or the gate's reason;
- `versions`: for each file the state and the digest of its text. It is written last
  and is what commits: `current` follows the newest version of each file.

So a job that dies before its last write leaves everything as it was, and a replay
of the same version (a stream's batch number, say) overwrites its own folders and
adds nothing. Counts of what was staged are verified against what the gate let
through before the commit. Stale chunks go with `vacuum`, after readers have moved on.

All steps are joins and aggregations by file; no file passes the driver. A file
given twice in one version keeps its greatest (digest, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestream.functions import text as T
from lorestream.streaming.state import written

_SCHEMAS = {
    "outcomes": "file_id long, change string, status string, n_chunks long, ingest_version long",
    "versions": "file_id long, state string, digest string, ingest_version long",
}
Chunker = Callable[[DataFrame], DataFrame]


class StagingMismatch(RuntimeError):
    """Fewer or more chunks were staged than the accepted files have; nothing was committed."""


def _folder(spark: SparkSession, root: str, name: str, version: int | None = None) -> str:
    return f"{root}/{name}" + ("" if version is None else f"/ingest_version={version}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the store's small tables; empty where nothing was ingested yet."""
    path = _folder(spark, root, name)
    if not _exists(spark, path):
        return spark.createDataFrame([], _SCHEMAS[name])
    return spark.read.schema(_SCHEMAS[name]).parquet(path)


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, ingest_version, state, digest): the newest commit of each file."""
    newest = F.max_by(F.struct("ingest_version", "state", "digest"), "ingest_version").alias("p")
    return read(spark, root, "versions").groupBy("file_id").agg(newest).select("file_id", "p.*")


def current(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that readers see: of each file those of its newest committed version, none of deleted files."""
    live = pointers(spark, root).where("state = 'ready'").select("file_id", "ingest_version")
    return spark.read.parquet(_folder(spark, root, "chunks")).join(live, ["file_id", "ingest_version"], "left_semi")


def changes(listing: DataFrame, root: str, deletions: bool = True) -> DataFrame:
    """(file_id, change, digest, text) of listing(file_id, text) against the store: new, modified, unchanged and, if wanted, deleted."""
    rows = listing.select("file_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    rows = rows.groupBy("file_id").agg(F.max(F.struct("digest", "text")).alias("r")).select("file_id", "r.*")
    known = pointers(listing.sparkSession, root).where("state = 'ready'").select("file_id", F.col("digest").alias("then"))
    both = rows.withColumn("listed", F.lit(True)).join(known, "file_id", "full_outer")
    change = F.when(F.col("listed").isNull(), "deleted").when(F.col("then").isNull(), "new").when(F.col("then") != F.col("digest"), "modified").otherwise("unchanged")
    out = both.select("file_id", change.alias("change"), "digest", "text")
    return out if deletions else out.where("change <> 'deleted'")


def ingest(changed: DataFrame, root: str, version: int, chunker: Chunker, before_commit: Callable[[], None] = lambda: None) -> DataFrame:
    """Ingest changed(file_id, change, digest, text) as one version; returns its outcomes.

    New and modified files pass the quality gate; one that is refused keeps the
    version that it had. chunker takes (file_id, text) and returns file_id,
    chunk_index, content. before_commit runs last before the commit.
    """
    spark = changed.sparkSession
    judged = changed.withColumn("status", F.when(F.col("change").isin("new", "modified"), T.gate_reason(F.col("text"), T.quality_score(F.col("text")))).otherwise(F.col("change")))
    judged = written(judged.withColumn("text", F.when(F.col("status") == "accepted", F.col("text"))), "judged")  # read twice, judged once
    accepted = judged.where("status = 'accepted'").select("file_id", "text")
    chunker(accepted).write.mode("overwrite").parquet(_folder(spark, root, "chunks", version))
    staged = spark.read.parquet(_folder(spark, root, "chunks", version)).groupBy("file_id").agg(F.count("*").alias("n_chunks"), (F.max("chunk_index") - F.min("chunk_index") + 1).alias("expected"))
    told = judged.select("file_id", "change", "status", "digest").join(staged, "file_id", "left")
    told.select("file_id", "change", "status", "digest", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "expected").write.mode("overwrite").parquet(_folder(spark, root, "outcomes", version))
    outcomes = spark.read.parquet(_folder(spark, root, "outcomes", version))
    wrong = outcomes.where("status = 'accepted' and (n_chunks = 0 or n_chunks <> expected) or status <> 'accepted' and n_chunks > 0").count()
    if wrong:
        raise StagingMismatch(f"{wrong} files of version {version}")
    before_commit()
    commit = outcomes.where("status in ('accepted', 'deleted')").select("file_id", F.when(F.col("status") == "accepted", "ready").otherwise("deleted").alias("state"), "digest")
    commit.write.mode("overwrite").parquet(_folder(spark, root, "versions", version))
    return outcomes.select("file_id", "change", "status", "n_chunks").withColumn("ingest_version", F.lit(version).cast("long"))


def sync(listing: DataFrame, root: str, version: int, chunker: Chunker, deletions: bool = True, before_commit: Callable[[], None] = lambda: None) -> DataFrame:
    """Bring the store to a listing: new and modified files ingested, deleted ones taken away, others left alone."""
    return ingest(changes(listing, root, deletions), root, version, chunker, before_commit)


def ingest_stream(stream: DataFrame, root: str, chunker: Chunker, checkpoint: str) -> None:
    """Ingest a stream of (file_id, text) to the end of its source; each batch is a version, so a batch that runs again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        # A replay must not see its own commit, else it would find nothing changed.
        before = _without(rows, root, number)
        ingest(before, root, number, chunker)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _without(rows: DataFrame, root: str, version: int) -> DataFrame:
    spark = rows.sparkSession
    path = _folder(spark, root, "versions", version)
    if _exists(spark, path):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return changes(rows, root, deletions=False)


def summary(outcomes: DataFrame) -> DataFrame:
    """(ingest_version, n_indexed, n_failed, n_chunks, result): success, partial or failed, by version."""
    failed = ~F.col("status").isin("accepted", "unchanged", "deleted")
    per = outcomes.groupBy("ingest_version").agg(F.count_if(F.col("status") == "accepted").alias("n_indexed"), F.count_if(failed).alias("n_failed"), F.sum("n_chunks").alias("n_chunks"))
    result = F.when((F.col("n_indexed") > 0) & (F.col("n_failed") == 0), "success").when(F.col("n_indexed") > 0, "partial").otherwise("failed")
    return per.withColumn("result", result)


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """(state, n, n_versions): files by state of their newest commit."""
    return pointers(spark, root).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("ingest_version").alias("n_versions"))


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete folders of chunks in which no file is current any more; returns how many."""
    live = {r.ingest_version for r in pointers(spark, root).where("state = 'ready'").select("ingest_version").distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, root, "chunks"))
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = [x.getPath() for x in files.listStatus(path) if x.isDirectory() and int(x.getPath().getName().split("=")[1]) not in live]
    return sum(bool(files.delete(p, True)) for p in old)


def pages_of(lines: int) -> Chunker:
    """A chunker of so many lines."""
    from lorestream.sources import files

    def cut(docs: DataFrame) -> DataFrame:
        return files.pages(docs, "file_id", "text", lines).select("file_id", (F.col("page_number") - 1).alias("chunk_index"), F.col("text").alias("content"))

    return cut
