import base64
import random
import re

import pytest
import zstandard

from lorestream.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        again += line in seen and bool(WORD.search(line))
        seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit)


@pytest.mark.parametrize("seed", range(60))
def test_measures(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", " ", " ", "\n", "é", "\t", "#", "\x0b", "\x1c", " "]) for _ in range(rng.randint(0, 300)))
    assert Q.measures(text) == brute(text)


def prose(n, seed=1):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(["th", "er", "on", "an", "re", "tion", "ed", "ing", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    return " ".join(rng.choice(parts) for _ in range(n))


def test_verdicts(spark):
    rng = random.Random(9)
    junk = " ".join("".join(chr(rng.randint(33, 0x2FFF)) for _ in range(8)) for _ in range(400))
    loop = "the very same words come again and again in this line of text " * 40
    half = prose(3000) + "".join(f" {i % 7}" for i in range(30000))
    rows = [(1, prose(200), "a"), (2, prose(20000), "a"), (3, junk, "a"), (4, loop, "a"), (5, half, "a"), (6, None, "a"), (7, "", "a"), (8, "few words", None), (1, prose(200), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ratio string")
    out = Q.with_quality(df).collect()
    assert [(r.doc_id, r.kept) for r in out] == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False), (8, False), (1, True)]
    assert [r.base_failed for r in out] == [False, False, False, True, True, True, True, True, False]
    assert Q.with_quality(df.limit(0)).count() == 0


def test_clean_labelled_documents_stay(spark):
    at = "/root/testdata/sf0.01/"
    docs = spark.read.parquet(at + "documents.parquet").join(spark.read.parquet(at + "labels.parquet"), "doc_id")
    rows = Q.with_quality(docs).where("quality = 1 and not base_failed").groupBy("kept").count().collect()
    assert [(r.kept) for r in rows] == [True]
    bad = Q.with_quality(docs).where("quality = 0").selectExpr("avg(int(kept)) as k").first().k
    assert bad < 0.75


def test_ratios_of_chunks():
    squeeze = zstandard.ZstdCompressor(level=3)
    raw = prose(3000).encode()
    sizes = [n for n, _ in Q.ratios(raw, squeeze)]
    assert sizes[0] == len(raw) and sizes[1:] == [Q.CHUNK] * (len(raw) // Q.CHUNK)


def cut_into_words(kind, n, rng):
    raw = {"base64": lambda: base64.b64encode(rng.randbytes(n)).decode(), "hex": lambda: rng.randbytes(n).hex(), "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))}[kind]()
    out = []
    while sum(map(len, out)) < n:
        at = sum(map(len, out))
        out.append(raw[at : at + rng.randint(2, 9)])
    return " ".join(out)[:n].encode()


@pytest.mark.parametrize("kind, least", [("base64", 256), ("letters", 1024), ("hex", 2896)])
def test_incompressible_text_of_each_class_is_outside(kind, least):
    squeeze = zstandard.ZstdCompressor(level=3)
    rng = random.Random(4)
    for n in [b[0] for b in Q.BANDS if least <= b[0] <= 32768]:
        assert not Q.verdict(cut_into_words(kind, n + n // 10, rng), squeeze)[0], n


def test_looped_text_of_each_class_is_outside():
    squeeze = zstandard.ZstdCompressor(level=3)
    for n, _, _ in Q.BANDS[3:]:
        raw = prose(12).encode() + b" "
        assert not Q.verdict((raw * (n // len(raw) + 2))[: n + n // 10], squeeze)[0], n


def test_tail_counts(monkeypatch):
    squeeze = zstandard.ZstdCompressor(level=3)
    rng = random.Random(5)
    looped = (prose(12).encode() + b" ") * 80
    monkeypatch.setattr(Q, "band", lambda n, of=Q.band: of(n) if n <= Q.CHUNK else (0.0, 1e9))
    good, junk = prose(800).encode()[: Q.CHUNK], cut_into_words("letters", 3900, rng)
    assert Q.verdict(good + good[:3900], squeeze)[0]
    assert Q.verdict(good + good + junk, squeeze)[0]
    assert not Q.verdict(good + looped[: Q.CHUNK] + junk, squeeze)[0]


def test_labelled_good_stays_and_some_bad_goes(spark):
    for at in ("/root/testdata/sf0.001/", "/root/testdata/sf0.01/", "/root/testdata/sf0.1/"):
        docs = spark.read.parquet(at + "documents.parquet").join(spark.read.parquet(at + "labels.parquet"), "doc_id")
        kept = {(r.quality, r.kept): r["count"] for r in Q.with_quality(docs).where("not base_failed").groupBy("quality", "kept").count().collect()}
        assert (1, False) not in kept
    assert kept[0, False] > 40
