import numpy as np
import pytest

from lorestream.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, least=0.98):
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = (label, np.asarray(v, dtype=np.float32).astype(np.float64))
    ids = sorted(ok)
    root, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            (a, x), (b, y) = ok[i], ok[j]
            if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}


def vectors(seed=3, n=700, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    centres = rng.standard_normal((30, dim))
    for i in range(n):
        k = rng.integers(0, 60)
        v = centres[k] + rng.normal(0, 0.11, dim) * rng.choice([0, 0.5, 1]) if k < 30 else rng.standard_normal(dim)
        out.append((int(i) * 2, [float(np.float32(x)) for x in v], int(k % 3)))
    same = out[5][1]
    out += [(2001 + 2 * i, same, out[5][2]) for i in range(40)]
    out += [(5001, None, 1), (5003, [0.0] * dim, 1), (5005, [float("nan")] * dim, 1), (5007, [None] + [1.0] * (dim - 1), 1), (5009, same, None), (5011, [1.0, 2.0], 0), (5013, [2.0, 4.0], 0), (5015, [float("inf")] * dim, 1), (5017, [], 0)]
    return out


@pytest.mark.parametrize("leaf, block", [(512, 4096), (40, 16)])
def test_matches_brute_force(spark, leaf, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, leaf=leaf, block=block, spill=0.4, sample=200).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (2, [1.0, 0.0], 0, ""), (None, [1.0, 0.0], 0, "")]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("None", 0, None, True)]
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sample_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, leaf=24).collect()}
    assert got == brute(rows)


def test_several_vectors_under_one_id(spark):
    """Each different vector is one of its own; 1's two vectors do not join 2 and 3."""
    rows = [(1, [1.0, 0.0], 0, ""), (1, [0.0, 1.0], 0, ""), (1, [0.0, 1.0], 0, ""), (2, [1.0, 0.0], 0, ""), (3, [0.0, 1.0], 0, ""), (3, [0.0, 1.0], 1, ""), (0, [0.0, 2.0], 0, "")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 2, 0, True), (1, 1, 1, True), (1, 2, 0, False), (1, 2, 0, False), (2, 1, 1, False), (3, 0, 3, True), (3, 2, 0, False)]
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "label + 5000000000 as label")
    assert sorted((r.vec_id, r.n_links) for r in E.near_duplicates(wide).collect()) == [(i, n) for i, n, _, _ in got]


def near_links(n, dim, seed):
    """Unit vectors, two thirds of them close to a cosine of 0.98 from another."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    out = [base]
    for low, high in ((0.9795, 0.9815), (0.98, 0.99)):
        aside = rng.standard_normal(base.shape)
        aside -= (aside * base).sum(axis=1, keepdims=True) * base
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        c = rng.uniform(low, high, (len(base), 1))
        out.append(c * base + np.sqrt(1 - c * c) * aside)
    return np.concatenate(out).astype(np.float32)


@pytest.mark.parametrize("dim", [64, 1024])
def test_recall_at_the_defaults(spark, tmp_path, dim):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = near_links(6000, dim, dim)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32())), "label": np.zeros(len(x), dtype=np.int32)})
    pq.write_table(table, tmp_path / "v.parquet", row_group_size=1000)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = ((y @ y.T) >= 0.98).sum(axis=1) - 1
    got = np.zeros(len(x), dtype=np.int64)
    for r in E.near_duplicates(spark.read.parquet(str(tmp_path / "v.parquet"))).collect():
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() > 4000


@pytest.mark.parametrize("dim", [64, 384, 1024, 4096])
def test_nodes_split_at_every_dimension(dim):
    x = np.random.default_rng(dim).standard_normal((2048, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    splits, stuck = E.grow(x, 5, 0, "", 4, 0.12 / np.sqrt(dim))
    assert len(splits) == 15 and not stuck
