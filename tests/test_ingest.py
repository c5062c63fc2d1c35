import pytest

from lorestream.operators import ingest as I

GOOD = "The quick brown fox jumps over the lazy dog, again. Then it sleeps; nobody minds.\n" * 40
SCHEMA = "file_id long, text string"
CUT = I.pages_of(10)


def seen(spark, root):
    return {(r.file_id, r.ingest_version): r.n for r in I.current(spark, root).groupBy("file_id", "ingest_version").count().withColumnRenamed("count", "n").collect()}


def test_a_broken_version_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    listing = spark.createDataFrame([(1, GOOD), (2, GOOD + "x"), (3, "short"), (4, None)], SCHEMA)
    got = {r.file_id: (r.change, r.status) for r in I.sync(listing, root, 1, CUT).collect()}
    assert got == {1: ("new", "accepted"), 2: ("new", "accepted"), 3: ("new", "too_short"), 4: ("new", "empty")}
    before = seen(spark, root)
    assert before == {(1, 1): 5, (2, 1): 5}

    def fail():
        raise OSError("disk full")

    changed = spark.createDataFrame([(1, GOOD * 2), (5, GOOD)], SCHEMA)
    with pytest.raises(OSError):
        I.sync(changed, root, 2, CUT, before_commit=fail)
    assert seen(spark, root) == before
    with pytest.raises(I.StagingMismatch):  # a chunker that loses a chunk
        I.sync(changed, root, 2, lambda d: CUT(d).where("chunk_index <> 1"))
    assert seen(spark, root) == before
    I.sync(changed, root, 2, CUT)
    assert seen(spark, root) == {(1, 2): 9, (5, 2): 5}
    assert {(r.state, r.n) for r in I.tracked(spark, root).collect()} == {("ready", 2), ("deleted", 1)}
    assert I.vacuum(spark, root) == 1 and seen(spark, root) == {(1, 2): 9, (5, 2): 5}


def test_refused_changes_keep_the_old_version(spark, tmp_path):
    root = str(tmp_path / "store")
    I.sync(spark.createDataFrame([(1, GOOD)], SCHEMA), root, 1, CUT)
    out = I.sync(spark.createDataFrame([(1, "too little")], SCHEMA), root, 2, CUT, deletions=False)
    assert [(r.change, r.status) for r in out.collect()] == [("modified", "too_short")] and seen(spark, root) == {(1, 1): 5}
    assert {(r.ingest_version, r.result) for r in I.summary(I.read(spark, root, "outcomes")).collect()} == {(1, "success"), (2, "failed")}
    empty = spark.createDataFrame([], SCHEMA)
    assert I.sync(empty, root, 3, CUT, deletions=False).count() == 0 and seen(spark, root) == {(1, 1): 5}
    I.sync(empty, root, 4, CUT)
    assert seen(spark, root) == {}


def test_stream_and_replay(spark, tmp_path):
    root, at = str(tmp_path / "store"), str(tmp_path / "in")
    for n, rows in enumerate([[(1, GOOD), (2, GOOD)], [(2, GOOD + "more"), (3, "no")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
        I.ingest_stream(spark.readStream.schema(SCHEMA).parquet(at), root, CUT, str(tmp_path / "check"))
    assert seen(spark, root) == {(1, 0): 5, (2, 1): 5}
    # The second batch again, as after a crash between its commit and the checkpoint.
    rows = spark.createDataFrame([(2, GOOD + "more"), (3, "no")], SCHEMA)
    I.ingest(I._without(rows, root, 1), root, 1, CUT)
    assert seen(spark, root) == {(1, 0): 5, (2, 1): 5} and I.read(spark, root, "outcomes").count() == 4
