import hashlib
import random

import pytest

from lorestream.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, extra string"


def brute(rows, length=100):
    """Every window in order of (doc_id, start); a byte goes with a window seen before."""
    seen, out = set(), {}
    for i, text in sorted((i, t or "") for i, t in rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    line = "x" * 70 + " common line "
    rows = [(i, prose(rng.randint(0, 80)) + rng.choice(["", *shared]) + prose(20) + rng.choice([line, ""]) + rng.choice(shared)) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    base = prose(120).split()
    for i in range(12):
        other = list(base)
        other[rng.randrange(120)] = word()
        rows.append((200 + i, " ".join(other)))
    rows += [(300, None), (301, ""), (302, "short"), (303, "a" * 1000), (304, "ab" * 300), (305, prose(3000)), (306, "y" * 99), (307, "a" * 100)]
    return rows


@pytest.mark.parametrize("crowd", [256, 3])
def test_matches_brute_force(spark, crowd):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, crowd=crowd).collect()}
    assert got == brute(rows)


def test_long_text_crosses_segments(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abc ") for _ in range(300_000))
    rows = [(2, text), (1, text[200_000:290_000] + "tail"), (3, "é" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 90_000, 3: 800_000 - 2}


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "some words that go on " * 3 + "and are long enough to hold a whole window of bytes, really so"
    rows = [(1, text), (1, text), (None, text), (2, text), (3, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(text)
    assert got == [("1", 0), ("1", 0), ("2", n), ("3", 0), ("None", 0)]
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blind_trie_orders_and_groups():
    import numpy as np

    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(300)]
    words += rng.sample(words, 50)
    text = "".join(words).encode()
    trie = S.BlindTrie(text, 40)
    for i in range(len(words)):
        trie.add(40 * i)
    leaves = list(trie.leaves())
    keys = [text[x[0] : x[0] + 40] for x in leaves]
    assert keys == sorted({w.encode() for w in words})
    assert sum(map(len, leaves)) == len(words)
    got = {frozenset(x.tolist()) for x in S.equal_windows(text, np.arange(len(words)) * 40, np.zeros(len(words), dtype=int), 40)}
    want = {frozenset(i for i, w in enumerate(words) if w == v) for v in set(words)}
    assert got == {x for x in want if len(x) > 1}
