import random

import pytest

from lorestream.llm import common as C


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_components(spark, one_task):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(7000, 7000), (-5, 9000), (9000, 9001)]
    edges += [(20_000 + rng.randint(0, 400), 20_000 + rng.randint(0, 400)) for _ in range(250)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.id: r.component for r in C.components(df, one_task).collect()} == {i: find(i) for i in list(root)}
    assert C.components(df.limit(0), one_task).count() == 0


def test_byte_slices():
    import pyarrow as pa

    texts = ["a" * 10, None, "é" * 3, "b" * 100, "", "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(C.byte_slices([batch, batch.slice(0, 0)], most=16))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    assert [p.num_rows for p in parts] == [3, 1, 2]
    assert C.text_bytes(batch)[1:3] == [b"", "ééé".encode()]


def test_discard(spark):
    import os

    df = C.materialize(spark.range(3), "t")
    path = C._places[df].removeprefix("file:")
    assert os.path.isdir(path)
    C.discard(df, spark.range(1))
    assert not os.path.exists(path)
