import hashlib
import random
from array import array

import pytest

from lorestream.llm import sentencepieces as S

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", "the", " ", " ", "  ", "▁", "\n", "\t", "\r", "\0", "é", "ﬁ", "漢", "字", "🙂", "<s>", "</s>", "<0x0A>", "ing", "http://", "1", " ", "​", "A", "﻿", "é", "‍", " ", "\x85", ".", "<unk>", "x" * 70]


@pytest.fixture(scope="module")
def own():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(own, text):
    ids = own.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()


def odd(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_odd_texts_equal_the_library(own):
    pieces, texts = S.Pieces(PATH), odd(20_000)
    for text, parts in zip(texts, S.encode_parts(pieces, texts)):
        got = list(parts)
        ids = [i for part, _ in got for i in part.tolist()]
        assert ids == own.encode(text), repr(text)
        assert b"".join(d for _, d in got).decode() == own.decode([1, *ids, 2]), repr(text)


def test_query_equals_the_library(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(None, "x"), (1, None), (1, ""), (2, " "), (2, "a b"), (2, "a b"), (3, "ab cde " * 400_000), (4, "\n" * 1000), (5, "z" * 200_000), *((6, t) for t in odd(500, 6))]
    rows = [tuple(r) for r in docs.collect()] + more
    got = S.encoded(docs.unionByName(spark.createDataFrame(more, docs.schema)), PATH, digests=True).drop("text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *expected(own, t)) for i, t in rows), key=str)


def test_ids_and_texts(spark, own):
    rows = [(1, "Hello  wörld\n", 5, "own"), (2, None, 6, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, extra string")
    out = sorted(S.encoded(df, PATH).collect(), key=lambda r: r.doc_id)
    assert [(r.ids, r.decoded, r.extra) for r in out] == [(own.encode("Hello  wörld\n", add_bos=True, add_eos=True), "Hello  wörld\n", "own"), ([1, 2], "", "own")]
    assert S.encoded(df.limit(0), PATH).count() == 0


def test_table_is_bounded(monkeypatch, own):
    monkeypatch.setattr(S, "_BYTES", 2000)
    monkeypatch.setattr(S, "_PART", 7)
    pieces = S.Pieces(PATH)
    for text in ["one two three " * 5, " ".join(map(str, range(400)))] * 3:
        ((ids, _),) = next(S.encode_parts(pieces, [text]))
        assert ids.tolist() == own.encode(text)
    assert len(pieces.table) < 500
