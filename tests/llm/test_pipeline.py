"""The whole pipeline against plain Python on a small table."""

import sys

import pytest

pytest.importorskip("public_tokenizers")
sys.path.insert(0, "tests/llm")

import corpus_pipeline as P
import test_jaccard_join
import test_packing
import test_quality_rules
import test_suffix_dedup
from lorestream.llm.common import materialize


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    word = test_quality_rules.prose
    rows = []
    for i in range(90):
        base = word(150 + i % 7 * 30, seed=i % 30)
        text = base if i < 30 else base + " " + word(3, seed=100 + i) if i % 3 else base
        if i % 5 == 0:
            text += "\n" + word(80, seed=999)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(200, None, None, None, None), (201, "same " * 400, "en", "s1", 2000), (202, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    every = {r.doc_id: r for r in docs.collect()}
    good = materialize(P.keep_good(spark, docs, table), "t")
    assert good.columns == P.COLUMNS and sorted(r.doc_id for r in good.collect()) == sorted(i for i in every if i < 200)

    one = materialize(P.keep_one_of_each_class(spark, good, table), "t")
    classes = test_jaccard_join.brute([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in classes.items() if c == i)
    assert one.columns == P.COLUMNS

    cut = materialize(P.cut_repeats(spark, one, table), "t")
    want = test_suffix_dedup.brute([(r.doc_id, r.text) for r in one.collect()])
    import hashlib

    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()} == {i: w[3] for i, w in want.items()}
    assert sum(w[1] for w in want.values()) > 0

    mixed = materialize(P.mix_sources(spark, cut, table), "t")
    assert mixed.columns == P.COLUMNS
    size = lambda t: len((t or "").split())
    assert abs(sum(size(r.text) for r in mixed.collect()) - sum(size(r.text) for r in cut.collect())) <= 4

    rows = P.pack_sequences(spark, mixed, table).collect()
    assert sum(r.piece == 0 for r in rows) == mixed.count()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert P.run(spark, table).count() == len(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_repeats_ties_clashes_and_a_long_text(spark, tmp_path):
    """Repeated rows, two texts under one id, texts of one size, a text of 1 MB, extra columns of the stages' own names."""
    prose = test_quality_rules.prose
    rows = [(i, prose(200, seed=i), "en", f"s{i % 3}", 1, "x") for i in range(12)]
    rows += [rows[4]] * 5 + [(7, prose(200, seed=77), "de", None, 1, "x"), (None, prose(200, seed=78), "en", "s1", 1, "x"), (50, prose(150_000, seed=79), "en", "s2", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(5)
    for c in ("tag", "packed", "key", "copies", "length", "nth"):
        df = df.withColumn(c, df["kept"])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = materialize(P.keep_good(spark, docs, ""), "t")
    assert good.where("doc_id = 4").count() == 6 and good.count() >= 19
    one = materialize(P.keep_one_of_each_class(spark, good, ""), "t")
    assert one.columns == P.COLUMNS
    want = {(r.doc_id, r.text, r.lang, r.source) for r in good.collect()}
    assert sorted(map(str, ((r.doc_id, r.text, r.lang, r.source) for r in one.collect()))) == sorted(map(str, want))
    cut = materialize(P.cut_repeats(spark, one, ""), "t")
    assert {(r.doc_id, r.lang, r.source) for r in cut.collect()} == {w[:1] + w[2:] for w in want} and cut.count() == len(want)
    mixed = materialize(P.mix_sources(spark, cut, ""), "t")
    assert {r.lang for r in mixed.where("source is null").collect()} == {"de"}
    assert P.run(spark, str(tmp_path)).where("piece = 0").count() == mixed.count()
