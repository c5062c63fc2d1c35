import random

import pytest

from lorestream.llm import jaccard_join as J


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if len(words) >= k else {tuple(words)}


def brute(rows, words=4, percent=85):
    sets = {i: shingles(t, words) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("KLMNOP") + str(rng.randint(0, 40))
    bases = [[word() for _ in range(rng.choice([1, 3, 4, 5, 12, 40, 200]))] for _ in range(25)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(260):
        words = list(rng.choice(bases))
        if rng.random() < 0.3:
            words += passage
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = word()
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    return [*rows, (1, None), (2, ""), (4, " \n"), (5, "one"), (7, "ONE"), (8, "é à ö ü")]


@pytest.mark.parametrize("seed, often, block", [(1, 64, 1024), (2, 3, 5), (3, 10, 2)])
def test_matches_brute_force(spark, seed, often, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_classes(df, often=often, block=block).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (2, "A B C D E"), (None, "a b c d e"), (None, None)]
    got = sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in J.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([("2", 2, 2), ("3", 2, 2), ("3", 2, 2), ("None", 0, None), ("None", 2, None)], key=str)
    assert J.join_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_never_overstate_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (3, 40, 700):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        a, b = (np.frombuffer(J.bitmap(s), dtype=np.uint64)[None, :] for s in (x, y))
        while a.shape[1] != b.shape[1]:
            a, b = (J._fold(a), b) if a.shape[1] > b.shape[1] else (a, J._fold(b))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def brute_clashing(rows, words, percent):
    """(doc_id, set size, smallest doc_id) of every row, rows being vertices of their own."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), len(set(map(find, range(len(rows)))))


def clashing(seed=5):
    """Ids with two texts, each near a neighbour of another id; some rows twice or many times."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for i in range(60):
        for other in (i + 1000, i + 2000):
            base = [word() for _ in range(60)]
            near = list(base)
            near[30] = word()
            rows += [(i, " ".join(base)), (other, " ".join(near))]
    return rows + rows[:30] + [rows[3]] * 40 + [(1000, rows[0][1]), (5, ""), (5, ""), (6, " ")]


@pytest.mark.parametrize("few, block", [(8, 1024), (1, 3)])
def test_clashing_ids_and_repeated_rows(spark, few, block):
    rows = clashing()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join_classes(df, few=few, block=block).collect())
    assert got == brute_clashing(rows, 4, 85)[0]


def test_one_row_of_each_class(spark):
    rows = [r for r in clashing(6) if r[1].strip()]
    df = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, tag int, class_id string").repartition(5)
    out = J.one_of_each_class(df)
    assert out.columns == ["doc_id", "text", "class_id"]
    kept = [(r.doc_id, r.text) for r in out.collect()]
    classes, n = brute_clashing(rows, 5, 80)
    assert len(kept) == n and len(set(kept)) == n
    assert {d for d, _ in kept} == {c for _, _, c in classes}
    more = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, None), (1, ""), (2, "A b c d e F"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in J.one_of_each_class(more).collect() if r.text) == [("2", "A b c d e F"), ("None", "a b c d e f"), ("None", "a b c d e f")]
    assert J.one_of_each_class(more).count() == 4


def test_a_long_text_and_its_near_copy(spark):
    rng = random.Random(9)
    words = [str(rng.randint(0, 10**9)) for _ in range(200_000)]
    near = words[:100_000] + ["new"] + words[100_000:]
    rows = [(1, " ".join(near)), (9, " ".join(words)), (5, " ".join(words[:1000]))]
    assert {r.doc_id: r.component_id for r in J.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 9: 1, 5: 5}
