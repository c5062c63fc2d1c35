import random

import pytest

from lorestream.llm import token_counts as C

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def reference():
    """The tokenizers library's unigram model over the same pieces."""
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = C.vocabulary(PATH)
    low = min(s for _, s in pieces)
    # Byte pieces only stand in for characters that nothing covers; out of reach, they leave ordinary paths alone.
    bytes_ = [(f"<0x{b:02X}>", low) for b in range(256)]
    t = Tokenizer(models.Unigram([("<unk>", low), *pieces, *bytes_], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    assert m.is_byte(3)
    return t


def test_counts_equal_the_library(spark):
    t = reference()
    count = C.Counter(C.vocabulary(PATH))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(7)
    texts += ["".join(rng.choice("abéß漢字🙂 x.,THE") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for text in texts:
        flat = " ".join((text or "").encode().split() and [w.decode() for w in (text or "").encode().split()])
        assert count(text or "")[1] == len(t.encode(flat, add_special_tokens=False).ids), text


def test_counts_are_near_those_of_the_files_own_tokenizer(spark):
    import sentencepiece

    own, count = sentencepiece.SentencePieceProcessor(model_file=PATH), C.Counter(C.vocabulary(PATH))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    mine = sum(count(t)[1] for t in texts)
    theirs = sum(len(own.encode(" ".join(w.decode() for w in t.encode().split()), num_threads=1)) for t in texts)
    assert abs(mine / theirs - 1) < 0.05, (mine, theirs)


def test_best_path_and_ties():
    c = C.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -5.0)])
    assert c.best("▁aa") == (-3.0, 2)  # ▁+aa, of three paths of score -3: the last piece starts earliest
    assert c.best("▁é")[1] == 1 + 2


def test_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, " \n\t", "c"), (4, "Hello world", "c"), (4, "Hello world", "c"), (None, "x" * 50_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = C.with_counts(df, PATH).collect()
    assert [(r.n_words, r.n_tokens > 0) for r in out] == [(0, False)] * 3 + [(2, True), (2, True), (1, True)]
    assert C.with_counts(df.limit(0), PATH).count() == 0
