import numpy as np
import pytest

from lorestream.llm import mixing as M


def rows(n=120):
    out = []
    for i in range(n):
        source = ["big", "b", None, "zé", ""][0 if i % 3 else i // 3 % 5]
        out.append((i, source, " ".join(["w"] * (i % 17)) if i % 11 else None, "x"))
    return [*out, (7, "big", "twice  the\tsame", "x"), (7, "big", "twice  the\tsame", "x"), (None, "b", "no id", "x")]


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > limit * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(limit * sizes[s])
            free.discard(s)
        left -= sum(out[s] for s in over)
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_targets_are_met_exactly_and_reruns_agree(spark, block_words):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, source string, text string, extra string").repartition(5)
    got = M.plan(df, block_words=block_words, shards=4).collect()
    assert len(got) == len(data)
    size = lambda t: len((t or "").split())
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, _, t, _ in data)
    sizes = {}
    for _, s, t, _ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    for s, total in sizes.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {total}
        assert mine[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in mine) == round(mine[0].target)
        assert all(r.taken <= 3 * r.size for r in mine)
    again = M.plan(df.repartition(2), block_words=block_words, shards=4).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_rows_have_the_words_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, source string, text string, shard string")
    out = M.mix(df, block_words=40, shards=4)
    assert out.columns == ["doc_id", "source", "text", "shard"]
    taken = {}
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len((r.text or "").split())
        assert 0 <= r.shard < 4
    want = {}
    for r in M.plan(df, block_words=40, shards=4).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {k: v for k, v in want.items() if v or k in taken}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.plan(df).count() == 0 and M.mix(df).count() == 0


def test_tree_splits_exactly_and_evenly():
    quotas = np.array([1000, 1, 0, 37, 250])
    dealt = M.split_quotas(quotas, 7, 3)
    assert (dealt.sum(axis=1) == quotas).all() and (dealt >= 0).all()
    assert np.ptp(dealt.sum(axis=0)) <= 2
    assert (dealt == M.split_quotas(quotas, 7, 3)).all()
    assert abs(dealt[0] - 1000 / 7).max() < 40


def test_repeats_clashing_ids_and_columns(spark):
    data = [(1, "a", "one two three")] * 30 + [(1, "a", "other text of five words")] * 2 + [(None, "a", f"w{i} x") for i in range(40)] + [(i, "b", "z " * (i % 9), ) for i in range(200)]
    df = spark.createDataFrame([(*r, "k", 7) for r in data], "doc_id long, source string, text string, key string, copies int").repartition(4)
    got = M.plan(df, block_words=50, shards=3).collect()
    assert len(got) == len(data)
    for s in ("a", "b"):
        mine = [r for r in got if r.source == s]
        assert 0 <= round(mine[0].target) - sum(r.taken for r in mine) < 32
    out = M.mix(df, block_words=50, shards=3, part_words=20)
    assert out.columns == ["doc_id", "source", "text", "key", "copies", "shard"]
    rows = out.collect()
    assert {(r.key, r.copies) for r in rows} == {("k", 7)}
    per = lambda rs, n: {s: sum(n(r) for r in rs if r.source == s) for s in ("a", "b")}
    assert per(rows, lambda r: len(r.text.split())) == per(got, lambda r: r.taken)
    assert sorted(r.text for r in rows) == sorted(r.text for r in M.mix(df.repartition(2), block_words=50, shards=3).collect())


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "a", "word " * 400_000), (2, "b", "x y"), (3, "c", None)], "doc_id long, source string, text string")
    assert {r.doc_id: r.size for r in M.plan(df).collect()} == {1: 400_000, 2: 2, 3: 0}
    taken = {r.doc_id: r.taken for r in M.plan(df).collect()}
    mixed = {r.doc_id: 0 for r in M.plan(df).collect()}
    for r in M.mix(df).collect():
        mixed[r.doc_id] += len((r.text or "").split())
    assert mixed == taken and taken[2] == 6
