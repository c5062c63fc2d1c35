import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lorestream.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    out = []
    for v in row:
        v = None if v is None else str(v)
        out.append("-" if v is None else f"{len(v.encode())}:{v}")
    return H(*out)


def tree(nodes):
    """(root, siblings by node as (before, after) pairs), level by level over plain lists."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                pair = ("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i))
                for x in under[i]:
                    paths[x].append(pair)
        nodes, under = [H(*(nodes[j] for j in run)) for run in runs], [[x for j in run for x in under[j]] for run in runs]
    return nodes[0], paths


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: tree([h for _, h in by[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        sub, paths = trees[s]
        for (r, h), path in zip(by[s], paths):
            path = path + top
            other = r[:4] + (r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[4].replace("\n", ""),)
            now = leaf(other)
            for before, after in path:
                now = H(before, now, after)
            out.append((r[0], h, sub, root, H(*(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def check(spark, df):
    rows = [tuple(r) for r in df.select(*M.LEAF).collect()]
    got = sorted((tuple(r) for r in M.manifest(df).collect()), key=str)
    assert got == expected(rows)
    return got


def test_documents(spark):
    got = check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("depth", [1, 2])
def test_many_rounds(spark, depth):
    """Small blocks, so that groups of one to four hundred rows, and their roots, take several rounds."""
    i = F.col("id")
    source = F.when(i < 400, "hot").when(i < 409, "nine").when(i < 410, None).when(i < 411, "").otherwise(F.concat(F.lit("é"), (i % 37).cast("string")))
    text = F.when(i % 5 == 0, None).otherwise(F.concat(F.lit("t\n"), i.cast("string")))
    df = spark.range(600).select(i.alias("doc_id"), source.alias("source"), F.lit("en").alias("lang"), (i * 3).alias("n_chars"), text.alias("text")).repartition(7)
    want = {(r[0], r[2], r[3], r[4]) for r in expected([tuple(r) for r in df.select(*M.LEAF).collect()])}
    out = M.prove(df.select("doc_id", "source", M.leaf(*map(F.col, M.LEAF)).alias("leaf")), "source", "doc_id", depth)
    assert {(r.doc_id, r.subroot, r.root, H(*(s.before + s.after for s in r.siblings))) for r in out.collect()} == want


def test_rows(spark):
    rows = [(1, "s", "en", 3, "a\nb"), (1, "s", "en", 3, "a\nb"), (1, "s", "de", 3, "a"), (None, "s", None, None, None), (2, None, "x", 1, ""), (3, None, "x", 1, "y" * 300_000), (0, "-", "", 0, "1:-")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, schema).withColumns({"key": F.lit(9), "leaf": F.lit("own"), "place": F.lit(1)})
    check(spark, df)
    check(spark, df.limit(1))
    assert M.manifest(df.limit(0)).count() == 0


def test_proofs_name_places(spark):
    """A proof of another place does not lead to the root."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    leaves = df.select("doc_id", "source", M.leaf(*map(F.col, M.LEAF)).alias("leaf"))
    out = M.prove(leaves, "source", "doc_id").withColumn("again", M.fold(F.col("leaf"), F.col("siblings")))
    assert out.where("again <> root").count() == 0
    moved = out.withColumn("again", M.fold(F.sha2("leaf", 256), F.col("siblings")))
    assert moved.where("again = root").count() == 0
