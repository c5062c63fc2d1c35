import itertools
import os
import random
import zlib

import numpy as np
import pytest

from lorestream.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  \n\t ", "Hello, World!  it's 42", "ΣΊΣΥΦΟΣ İstanbul á ́b c　d", "word " * 5000, "x" * 3000, "<|endoftext|> a<|startoftext|>b", "one\x0btwo\x0cthree\r\nfour \x1c five six"]


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = np.array(whole_ids(text), dtype="<u4")
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 2048)))
        for r in mine:
            part = ids[r.piece * 2048 : (r.piece + 1) * 2048]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * 2048, len(part), zlib.crc32(part.tobytes()))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_sequence)


def test_pieces_and_places(spark):
    rng = random.Random(4)
    texts = dict(enumerate(TEXTS + [" ".join(rng.choice(["alpha", "Beta's", "x1", "né"]) for _ in range(rng.randint(0, 900))) for _ in range(120)]))
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, length string").repartition(4)
    rows = P.pack(df, PATH, buckets=3).collect()
    n = check(rows, texts)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same text")] * 700 + [(None, "no id")], "doc_id long, text string")
    rows = P.pack(df, PATH, buckets=2).collect()
    assert len(rows) == 701 and len({(r.sequence_id, r.offset) for r in rows}) == 701
    assert P.pack(df.limit(0), PATH).count() == 0


def test_words_alone_give_the_ids_of_whole_texts(spark):
    ids_of = P.WordIds(PATH)
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(ids_of([t or ""])[0], dtype="<u4").tolist() == whole_ids(t)[:-1]


def test_fuzzed_texts_give_the_ids_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(P, "_MEMO", 3000)
    whole, ids_of, rng = Tokenizer.from_file(PATH), P.WordIds(PATH), random.Random(8)
    parts = [*"abcXYZéßÀŉŸſµªº0123İıΣς漢\u0301\u0307\u0130\u212a", *",.;:!?'-_#&|<>", " ", "\n", "\t", "\x0b", "\x85", "\xa0", "\u3000", "'s", "'LL", "don't", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "word", "Th", "ing", "x" * 70, "</w>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(100_000)]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        want = [e.ids for e in whole.encode_batch_fast(part, add_special_tokens=False)]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids_of(part)] == want


def test_plain_texts_skip_the_whole_tokenizer_and_a_part_is_modelled_once():
    from tokenizers import Tokenizer

    chars = [chr(i) for i in [*range(0x180), *range(0x2010, 0x2028), 0x20AC] if i != 0x130]
    rng = random.Random(5)
    texts = ["".join(rng.choices([*chars, "'s", "'LL", "Word", "word,", " "], k=60)).replace("<|", "<") for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    ids_of = P.WordIds(PATH)
    ids_of.tokenizer = None
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids_of(texts)] == want
    met = []
    ids_of._part = lambda part, whole=ids_of._part: met.append(part) or whole(part)
    ids_of(["Zebrawood, zebrawood. ZEBRAWOOD"])
    assert met == ["zebrawood"]


@pytest.mark.parametrize("seed", range(30))
def test_fullest_is_the_best_subset(seed):
    rng = random.Random(seed)
    lengths = sorted({rng.randint(1, 30) for _ in range(5)}, reverse=True)
    counts = [rng.randint(1, 3) for _ in lengths]
    room = rng.randint(0, 80)
    got = P.fullest(lengths, counts, room)
    assert all(got.count(x) <= c for x, c in zip(lengths, counts))
    sums = [sum(n * x for n, x in zip(ns, lengths)) for ns in itertools.product(*(range(c + 1) for c in counts))]
    assert sum(got) == max(s for s in sums if s <= room)


def test_plan_uses_everything_once():
    rng = random.Random(1)
    histogram = {rng.randint(1, 2048): rng.randint(1, 9) * 1000 for _ in range(300)}
    used = {}
    bins = P.bin_plan(histogram, 2048)
    for times, bin_ in bins:
        assert sum(bin_) <= 2048
        for x in bin_:
            used[x] = used.get(x, 0) + times
    assert used == histogram
    n = sum(t for t, _ in bins)
    assert n <= 1.02 * sum(k * v for k, v in histogram.items()) / 2048 + 1 or max(histogram) > 1024
