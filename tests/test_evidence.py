import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorestream.operators import evidence as E
from lorestream.operators import sparse, staged
from tests.conftest import SF


def brute_weights(text, dimensions=sparse.DIMENSIONS, most=512):
    tokens = []
    for t in re.findall(r"[\w§][\w§.-]*", text or ""):
        t = t.strip(".-").lower()
        if t and t not in sparse.STOPWORDS and (len(t) >= 2 or t.isdigit()):
            tokens.append(t)
    out = Counter()
    for t, n in Counter(tokens[:most]).items():
        out[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % dimensions] += 1 + math.log(n)
    size = math.sqrt(sum(w * w for w in out.values()))
    return {i: w / size for i, w in out.items()}


@pytest.mark.parametrize("dimensions", [sparse.DIMENSIONS, 50])
def test_sparse_vectors_and_dot_products(spark, dimensions):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_001, None), (10_002, "the of"), (10_003, "§ 5 5 5 a-b .x- 7")], "doc_id long, text string"))
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(12)
    have = {r.doc_id: {t["index"]: t["weight"] for t in r.terms} for r in sparse.with_vectors(docs, dimensions=dimensions).collect()}
    want = {r.doc_id: brute_weights(r.text, dimensions) for r in docs.collect()}
    assert have.keys() == want.keys() and all(have[i].keys() == want[i].keys() and all(have[i][t] == pytest.approx(w) for t, w in want[i].items()) for i in want)
    assert have[10_001] == have[10_002] == {} and 0 < len(have[10_003]) <= 3
    got = sparse.dot_top_k(sparse.with_vectors(queries, dimensions=dimensions), sparse.with_vectors(docs, dimensions=dimensions), 5, 6)
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    for q in queries.collect():
        w = brute_weights(q.text, dimensions)
        scores = [(i, round(sum(x * v.get(t, 0.0) for t, x in w.items()), 6)) for i, v in want.items() if w.keys() & v.keys()]
        best = sorted(scores, key=lambda x: (-x[1], x[0]))[:5]
        assert [s for _, s in best] == pytest.approx([ranks[q.query_id][i + 1][1] for i in range(len(best))], abs=2e-6)


def test_sparse_topk_takes_whole_texts(spark, tmp_path):
    from lorestream.plans.queries import QUERIES

    words = [f"word{i}" for i in range(900)]
    texts = {1: " ".join(words), 2: " ".join(["filler"] * 700 + ["Late-Word.", "late-word", "§ 12"]), 3: None, 4: "late-word word899 other", 5: " ".join(words[:600])}
    asked = {1: "late-word", 2: " ".join(reversed(words)), 3: "word899 word3"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.query_id, r.doc_id): (r["rank"], r.score) for r in QUERIES["sparse_topk"](spark, str(tmp_path)).collect()}
    have = {i: brute_weights(t, most=None) for i, t in texts.items()}
    want = {}
    for q, text in asked.items():
        w = brute_weights(text, most=None)
        scores = sorted((-sum(x * have[i].get(t, 0.0) for t, x in w.items()), i) for i in have if have[i].keys() & w.keys())
        want |= {(q, i): (n, pytest.approx(-s, abs=2e-6)) for n, (s, i) in enumerate(scores, 1)}
    assert got == want and (1, 2) in got and (3, 1) in got


@pytest.mark.parametrize("most", [None, 3])
def test_tokens_are_counted_the_same_whole_and_cut(most):
    for text in ("The Fee. fee- FEE of 5 a § §5 .x-", "", None, "b b2 b2. B2-"):
        assert dict(sparse.weights(text, most=most)) == pytest.approx(brute_weights(text, most=most))


def test_relaxation_equals_the_loop(spark):
    rng = random.Random(5)
    hits = {(q, s): rng.sample(range(12), rng.choice([0, 0, 1, 2, 5])) for q in range(60) for s in range(3)}
    rows = [(q, s, i, x) for (q, s), items in hits.items() for i, x in enumerate(items, 1)]
    out = {}
    for r in staged.relaxed(spark.createDataFrame(rows, "query_id long, stage int, rank int, item long"), enough=3, most=6).orderBy("query_id", "place").collect():
        out.setdefault(r.query_id, ([], r.won))[0].append(r.item)
    for q in range(60):
        found, won = [], None
        for s in range(3):
            found += [x for x in hits[q, s] if x not in found]
            if len(found) >= 3:
                won = s
                break
            if hits[q, s] and won is None:
                won = s
        assert out.get(q, ([], None)) == (found[:6], won)
    assert staged.relaxed(spark.createDataFrame([], "query_id long, stage int, rank int, item long")).count() == 0


def test_snippets_count_a_chunk_once(spark):
    rows = [(1, 1, "An ORDER came", "a"), (1, 1, "An ORDER came", "a"), (1, 2, "order", "b"), (2, 1, None, "a")]
    chunks = spark.createDataFrame(rows, "file long, chunk long, text string, who string")
    assert [(r.file, r.chunk, r.relaxed) for r in staged.exact_snippets(chunks, "order", F.col("who") == "a").collect()] == [(1, 1, False)]
    assert [(r.file, r.chunk, r.relaxed) for r in staged.exact_snippets(chunks, "order", F.col("who") == "z").collect()] == [(1, 1, True), (1, 2, True)]
    assert staged.exact_snippets(chunks, "nothing", F.lit(True)).count() == 0


def test_support_rules(spark):
    schema = "query string, text string, source string, score double, exact boolean, entity boolean, numeric boolean"
    rows = [
        ('"red fox" jumps', "The Red Fox", "s", 0.0, False, False, False),
        ("pay 30 euros", "pay euros", "s", 0.0, False, False, True),
        ("Where is Anna Lopez", "nobody here", "s", 0.9, False, True, False),
        ("who", "x", "s", 0.1, False, False, False),
        ("contract lawyer fees", "contract fees", "s", 0.0, False, False, False),
        ("contract lawyer fees", "contract", "s", 0.0, False, False, False),
        ("contract lawyer fees", "contract", "s", 0.99, True, False, False),
        ("contract lawyer fees", None, None, 0.9, False, False, False),
        ("contract lawyer fees", "", "s", 0.0, False, False, False),
    ]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"query_id long, {schema}")
    got = [(r.support, r.accepted) for r in E.admit(out).orderBy("query_id").collect()]
    assert got == [("exact", True), ("rejected", False), ("rejected", False), ("partial", True), ("direct", True), ("partial", True), ("rejected", False), ("partial", True), ("rejected", False)]


def brute_supported(kind, value, packets):
    flat = [re.sub(r"[^a-z0-9$§.]+", " ", p.lower()).strip() for p in packets]
    plain = re.sub(r"[^a-z0-9$§.]+", " ", value.lower()).strip()
    if any(value.lower() in p.lower() for p in packets) or plain and any(plain in f for f in flat):
        return True
    if kind != "requirement":
        return False
    tokens = [t for t in plain.split() if t not in E.CLAIM_STOPWORDS and (len(t) > 2 or t.isdigit())][:40]
    if not tokens:
        return True
    numbers = lambda t: t.isdigit() or t in E.NUMBER_WORDS
    critical = [t for t in tokens if numbers(t) or t in E.TIME_WORDS]
    if any(not any(t in f for f in flat) for t in critical):
        return False
    words = {w for f in flat for w in f.split()}
    inside = sum(t in words for t in tokens)
    if inside / len(tokens) >= 0.6 and inside >= min(4, len(tokens)):
        return True
    return bool(critical) and sum(t in words for t in tokens if not numbers(t)) >= 3


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["must pay $40", "within 30 days", "Section 1234", "guests", "members", "shall return", "two keys", "Jan 5, 2024", "quickly", "of the", "deadline", "rooms", "Anna Lopez"]
    text = lambda n: " ".join(rng.choice(bits) for _ in range(n)) + rng.choice([".", ". Then 7 dollars!", "? You shall not."])
    answers = [(i, text(rng.randint(1, 9))) for i in range(150)] + [(900, None), (901, "It must. Must of the!")]
    packets = [(i, text(rng.randint(0, 9))) for i, _ in answers for _ in range(rng.randint(0, 2))]
    a = spark.createDataFrame(answers, "answer_id long, text string")
    e = spark.createDataFrame(packets, "answer_id long, text string")
    out = E.verdicts(E.claims(a, entities=True), e).collect()
    by = {}
    for i, p in packets:
        by.setdefault(i, []).append(p)
    for r in out:
        assert r.supported == brute_supported(r.kind, r.value, by.get(r.answer_id, [])), r
    assert {r.how for r in out} >= {"value", "overlap", "core", "none"}
    assert len({(r.answer_id, r.nth) for r in out}) == len(out) and len({(r.answer_id, r.kind, r.value) for r in out}) == len(out)


def test_boost_is_clamped(spark):
    row = ("Anna Lopez section 42 lease", "count", "legal_precision", "lease.pdf", "42", "d", ["price"], ["anna lopez"], 0.2)
    schema = "query string, intent string, profile string, source_family string, section_id string, document_id string, answerable_fields array<string>, primary_entities array<string>, quality double"
    out = E.boosted(spark.createDataFrame([row, ("", "x", "x", None, None, None, [], [], 0.1)], schema)).collect()
    assert out[0].boost == 0.35 and sum(out[0].by_rule.values()) == pytest.approx(0.38) and out[1].boost == -0.05
