import hashlib
import random
import zlib

import pytest

from lorestream.llm import word_runs as R


def brute(words, least=6, times=4):
    """Every maximal stretch for every period; equal stretches keep the smallest."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda x: (x[0], x[2]))


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, [w.decode() for w in (text or "").encode().split()])
    runs = brute(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    told = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    exponent = 1000 * top[1] // top[2] if runs else None
    return (doc_id, len(runs), *top, exponent, digest(told), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def repetitive(rng, most=4):
    k = rng.choice([1, 2, 2, 3, 5])
    words = [rng.randrange(k) for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(0, most)):
        p = rng.randint(1, 5)
        words += ([rng.randrange(k + 1) for _ in range(p)] * rng.randint(1, 9))[: rng.randint(1, 40)]
        if rng.random() < 0.6:  # copies, so that runs lie inside blocks
            a = rng.randrange(len(words))
            words += words[a : a + rng.randint(1, 60)]
        words += [rng.randrange(k + 2) for _ in range(rng.randint(0, 4))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    seen = 0
    for _ in range(1500):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        got = R.find_runs(*R._numbered([[str(x).encode() for x in t] for t in texts]))
        want, base = [], 0
        for t in texts:
            want += [(a + base, a + base + n, q) for a, n, q in brute(t)]
            base += len(t)
        assert got == want, texts
        seen += len(want)
    assert seen > 3000


def test_suffix_array_and_previous_factors():
    rng = random.Random(2)
    for _ in range(200):
        texts = [[str(x).encode() for x in repetitive(rng, 2)] for _ in range(2)]
        symbols, starts, ends = R._numbered(texts)
        s = R.Suffixes(symbols, starts, ends)
        own = lambda i: symbols[i : ends[i]].tolist()
        assert s.order.tolist() == sorted(range(len(symbols)), key=own)

        def same(i, j):
            a, b = own(i), own(j)
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        length, where = s.longest_previous()
        for i in range(len(symbols)):
            assert length[i] == max([same(i, j) for j in range(starts[i], i)], default=0)
            assert not length[i] or where[i] < i and same(i, where[i]) == length[i]


def test_query_on_real_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    odd = [(900_000 + i, " ".join(f"w{x}" for x in repetitive(rng))) for i in range(300)]
    odd += [(None, "a b " * 6), (7, None), (8, ""), (9, " \n\t"), (10, "x"), (11, "a " * 40_000), (12, "é  " * 9), (12, "é  " * 9)]
    rows = [tuple(r) for r in docs.collect()] + odd
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(5)
    got = sorted((tuple(r)[:8] for r in R.summary(both).collect()), key=str)
    want = sorted((expected(*r) if len(r[1] or "") < 70_000 else (11, *long_row(*r)) for r in rows), key=str)
    assert got == want
    assert sum(r[1] for r in got) > 100


def long_row(doc_id, text):
    """A text of one word: one run, whatever is planted."""
    n = len(text.split())
    return (1, 0, n, 1, 1000 * n, digest(f"0,{n},1\n"), digest("a"))


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", "x", "own")], "doc_id long, text string, runs string, extra string")
    (row,) = R.with_runs(df).collect()
    assert row.extra == "own" and row.collapsed == "a b c" and [tuple(r) for r in row.runs] == [(0, 8, 2)] and row.n_words == 9
    assert R.with_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(*R._numbered([[b"a"]]), times=3)
