"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors compare only within one label (and dimension). Equal vectors become one
class first. In each tree a node projects its vectors on a random direction and
splits where a bounded sample says that the two sides, spill included, leave
least to compare; vectors within the spill of the split go to both sides. Linked
unit vectors are at most sqrt(2 - 2 * cosine) apart and projections of unit
vectors spread by 1 / sqrt(dim), so the spill is `spill` / sqrt(dim), whatever the
dimension: projections of linked vectors rarely differ by more than both spills
together, and several trees with independent directions leave little chance of a
miss. Trees grow in rounds of a few levels
until leaves are small; each round fits all its subtrees on samples of at most
`sample` rows a node and then places every row. A node that none of
several directions makes cheaper, as when very many vectors are nearly the same,
stays a leaf.

Within leaves all pairs are compared by cosine in double precision. A pair that
meets in several leaves counts in the first of them only, which each row can
tell from its own list of leaves, so exact link counts need no list of pairs,
and a leaf hands on no more edges than rows. Leaves that stay large are compared
in blocks by many tasks. `components` unites the edges.

Edge cases: vectors that are null, zero or hold null or non-finite components,
and rows with a null label, link with nothing (component = own id, kept); rows
with a null vec_id are returned with null component and link with nothing; rows
equal in vec_id, label and vector are one vector, counted once; different vectors
under one vec_id, or one under two labels, are vectors of their own, each with its
links and component, the least vec_id among the vectors it reaches; the empty table
gives an empty result; labels may be of any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorestream.llm.common import components, find_roots, materialize, whole_groups

_NODE = "tree int, label string, dim int, path string"
_TURNS = 4


def direction(seed: int, tree: int, path: str, dim: int, turn: int = 0) -> np.ndarray:
    """The unit vector a node projects on at its nth try, from its place in the forest alone."""
    v = np.random.default_rng([seed, tree, *path.encode(), *([1000 + turn] if turn else [])]).standard_normal(dim)
    return v / np.linalg.norm(v)


def best_cut(p: np.ndarray, spill: float, gain: float = 0.75) -> float | None:
    """Where to cut projections p so that both sides, spill included, have fewest pairs; None if over `gain` of all stay."""
    p = np.sort(p)
    left = np.searchsorted(p, p + spill, "right") / len(p)
    right = 1 - np.searchsorted(p, p - spill, "right") / len(p)
    pairs = left**2 + right**2
    at = int(np.argmin(pairs))
    return float(p[at]) if pairs[at] <= gain else None


def grow(x: np.ndarray, seed: int, tree: int, path: str, levels: int, spill: float, fewest: int = 32) -> tuple[dict[str, tuple[float, int]], list[str]]:
    """A subtree fitted on the sample x: inner paths to cuts and turns of the direction, and paths that no cut makes cheaper."""
    splits: dict[str, tuple[float, int]] = {}
    stuck: list[str] = []

    def split(rows: np.ndarray, at: str, depth: int) -> None:
        if depth == levels or depth and len(rows) < fewest:
            return
        for turn in range(_TURNS):
            p = rows @ direction(seed, tree, at, x.shape[1], turn)
            cut = best_cut(p, spill)
            if cut is not None:
                break
        else:
            stuck.append(at)
            return
        splits[at] = cut, turn
        split(rows[p <= cut + spill], at + "0", depth + 1)
        split(rows[p > cut - spill], at + "1", depth + 1)

    split(x, path, 0)
    return splits, stuck


def descend(x: np.ndarray, splits: dict[str, tuple[float, int]], seed: int, tree: int, path: str, spill: float) -> Iterator[tuple[str, np.ndarray]]:
    """(leaf, rows of x in it); rows near a split are in both of its sides."""
    stack = [(path, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        if at not in splits:
            yield at, rows
            continue
        cut, turn = splits[at]
        p = x[rows] @ direction(seed, tree, at, x.shape[1], turn)
        stack += [(at + "0", rows[p <= cut + spill]), (at + "1", rows[p > cut - spill])]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision of a column of equal-length lists."""
    rows = column.to_pylist() if not len(column) else np.stack(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy())
    x = np.asarray(rows, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(seed: int, levels: int, spill: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows.iloc[0]
        x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        splits, stuck = grow(x[np.lexsort(x[:, :8].T)], seed, int(node.tree), node.path, levels, spill / np.sqrt(x.shape[1]))
        one = {"tree": node.tree, "label": node.label, "dim": node.dim, "path": node.path, "inner": list(splits), "cuts": [c for c, _ in splits.values()], "turns": [t for _, t in splits.values()], "ends": stuck}
        return pd.DataFrame([one])

    return run


def _place(seed: int, spill: float):
    names = ["tree", "label", "dim", "path", "stuck", "vec_id", "weight", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select(["tree", "label", "dim", "path"]).to_pandas()
            for (tree, label, dim, path), index in frame.groupby(["tree", "label", "dim", "path"]).indices.items():
                one = batch.take(pa.array(index))
                inner, cuts, turns, ends = (one.column(c)[0].as_py() or [] for c in ("inner", "cuts", "turns", "ends"))
                for leaf, rows in descend(_matrix(one.column("vector")), dict(zip(inner, zip(cuts, turns))), seed, tree, path, spill / np.sqrt(dim)):
                    if len(rows):
                        out = one.take(pa.array(rows))
                        new = {"path": pa.array([leaf] * len(rows)), "stuck": pa.array([leaf in ends] * len(rows))}
                        yield pa.RecordBatch.from_arrays([new.get(n, out.column(n)) for n in names], names=names)

    return run


def forest(classes: DataFrame, trees: int, leaf: int, spill: float, sample: int, levels: int, seed: int, rounds: int) -> DataFrame:
    """(tree, label, dim, path, vec_id, weight, vector): the leaves each class is in."""
    schema = f"{_NODE}, stuck boolean, vec_id long, weight long, vector array<float>"
    node = ["tree", "label", "dim", "path"]
    every = F.explode(F.array(*[F.lit(t) for t in range(trees)]))
    now = classes.withColumn("tree", every).withColumn("path", F.lit("")).withColumn("stuck", F.lit(False)).select(*node, "stuck", "vec_id", "weight", "vector")
    done = None
    for _ in range(rounds):
        counts = now.groupBy(*node).agg(F.count("*").alias("rows"), F.bool_or("stuck").alias("end"))
        counts = materialize(counts.select(*node, "rows", ((F.col("rows") > leaf) & ~F.col("end")).alias("split")), "nodes")
        sized = now.join(counts, node)
        leaves = sized.where("not split").select(*node, "vec_id", "weight", "vector")
        done = leaves if done is None else done.unionByName(leaves)
        if not counts.where("split").limit(1).count():
            break
        large = sized.where("split")
        lot = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(sample / 2) / F.col("rows"))
        fitted = large.where(lot).select(*node, "vector").groupBy(*node).applyInPandas(_fit(seed, levels, spill), f"{_NODE}, inner array<string>, cuts array<double>, turns array<int>, ends array<string>")
        now = materialize(large.drop("rows", "split").join(materialize(fitted, "splits"), node, "left").mapInArrow(_place(seed, spill), schema), "placed")
    else:
        done = done.unionByName(now.drop("stuck"))
    return materialize(done, "leaves")


_FOUND = "vec_id long, links long, other long"


def _met_before(homes: pa.Array, here: int) -> np.ndarray:
    """A row for each row of a leaf: which of the leaves before this one, of those that several rows share, it is in."""
    rows = np.repeat(np.arange(len(homes)), homes.value_lengths().to_numpy())
    ids = homes.flatten().to_numpy()
    rows, ids = rows[ids < here], ids[ids < here]
    _, code, times = np.unique(ids, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    keep = place[code] >= 0
    out = np.zeros((len(homes), len(shared)), dtype=np.float32)
    out[rows[keep], place[code[keep]]] = 1
    return out


def _links(x: np.ndarray, weight: np.ndarray, side: np.ndarray, before: np.ndarray, least: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x: the weight it links with for the first time here, and the smallest row of its component."""
    n = len(x)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    two = side.min() != side.max()
    for at in range(0, n, step):
        rows = np.arange(at, min(at + step, n))
        cosine = x[rows] @ x[at:].T
        linked = cosine >= least
        i, j = np.nonzero(np.abs(cosine - least) < 1e-9)
        linked[i, j] = (x[at + i] * x[at + j]).sum(axis=1) >= least
        linked &= np.arange(at, n) > rows[:, None]
        if two:
            linked &= side[rows][:, None] != side[at:]
        if before.shape[1] and linked.any():
            linked &= before[rows] @ before[at:].T == 0
        links[rows] += linked @ weight[at:]
        links[at:] += weight[rows] @ linked
        i, j = np.nonzero(linked)
        if len(i):
            known = np.flatnonzero(root != np.arange(n))
            names, roots = find_roots(np.concatenate([at + i, known]), np.concatenate([at + j, root[known]]))
            root[names] = roots
    return links, root


def _compare(least: float):
    """Per row of a leaf (or pair of blocks): vectors it links with first here, and the least it reaches by those links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "leaf"):
            leaves = table.column("leaf").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1])), len(leaves))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo).combine_chunks().sort_by("vec_id")
                ids, weight, side = (part.column(c).to_numpy() for c in ("vec_id", "weight", "side"))
                before = _met_before(part.column("homes").combine_chunks(), part.column("home")[0].as_py())
                links, root = _links(_matrix(part.column("vector")), weight, side, before, least)
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], names=["vec_id", "links", "other"])

    return run


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, trees: int = 4, leaf: int = 512, spill: float = 0.12, sample: int = 4096, levels: int = 4, seed: int = 5, rounds: int = 24, block: int = 4096
) -> DataFrame:
    """Per row of vectors(vec_id, embedding, label): n_links, component_id, kept."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"), F.col("label").cast("string").alias("label"))
    fit = "vec_id is not null and label is not null and vector is not null and forall(vector, v -> v is not null and not isnan(v) and abs(v) < float('infinity')) and exists(vector, v -> v <> 0)"
    good = own.where(F.expr(fit)).withColumn("dim", F.size("vector")).withColumn("key", F.sha2(F.expr("concat_ws(',', vector)"), 256))
    classes = good.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("weight"), F.first("vector").alias("vector"))
    # From here to the end vec_id numbers classes; the table keeps the numbers.
    classes = materialize(classes.withColumn("vec_id", F.monotonically_increasing_id()), "classes")
    leaves = forest(classes.drop("key", "least"), trees, leaf, spill, sample, levels, seed, rounds)
    node = ["tree", "label", "dim", "path"]
    leaves = leaves.withColumn("home", F.xxhash64(*node))
    homes = leaves.groupBy("vec_id").agg(F.array_sort(F.collect_set("home")).alias("homes"))
    sizes = leaves.groupBy("home").agg(F.count("*").alias("rows"))
    blocks = F.ceil(F.col("rows") / block).cast("int")
    seated = leaves.select("home", "vec_id", "weight", "vector").join(sizes.select("home", blocks.alias("blocks")), "home").join(homes, "vec_id")
    seated = seated.withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "vec_id"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    seated = seated.select(
        F.xxhash64("home", F.least("mine", "other"), F.greatest("mine", "other")).alias("leaf"), "home", "vec_id", "weight", "vector", "homes",
        F.when(F.col("mine") < F.col("other"), -1).when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(seated.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(_compare(least), _FOUND), "found")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    component = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    united = classes.select("vec_id", "least").join(component, F.col("vec_id") == F.col("id")).groupBy("component").agg(F.min("least").alias("component_id"))
    known = component.join(united, "component").select(F.col("id").alias("vec_id"), "component_id")
    per_class = classes.join(counts, "vec_id", "left").join(known, "vec_id", "left").select(
        "label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    rest = own.where(~F.coalesce(F.expr(fit), F.lit(False))).select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    members = good.select("vec_id", "label", "dim", "key").join(per_class, ["label", "dim", "key"]).select("vec_id", "n_links", "component_id")
    return members.unionByName(rest).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
