"""Hybrid retrieval for batches of queries: postings, BM25, exact cosine, fusion, ordering, de-duplication.

Queries are rows. Every ranking ends with the id, so ties are settled, and every
top-k is a row_number filter, which Spark applies in part before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestream.functions import text as T
from lorestream.streaming.state import written


def postings(docs: DataFrame, tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """(token, doc_id, tf) of docs(doc_id, text)."""
    return docs.select("doc_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame, totals: DataFrame) -> DataFrame:
    """(token, df, idf) of postings and a row with n, the number of documents."""
    df = posted.groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(totals)).select("token", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def top_k(scored: DataFrame, k: int, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """scored(group, item, score, ...) with rank, the k best of each group."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_NEAR_ROWS = 1 << 18


def near(asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables as long as `asked`, one row for each term of a query, meet the corpus: up to 2^18 rows, which are counted first, go to every task."""
    return F.broadcast if asked.limit(_NEAR_ROWS + 1).count() <= _NEAR_ROWS else lambda rows: rows


def terms_asked(queries: DataFrame, tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """(query_id, token, qtf) of queries(query_id, query)."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def query_postings(queries: DataFrame, docs: DataFrame, tokenize: Callable[[Column], Column] = T.tokens) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked, hits, totals): query_id, token, qtf; token, doc_id, dl, tf of tokens asked for; n_docs, mean in one row.

    The corpus is tokenised once: beside its tokens each document has one null
    token, which no query holds, so that one exchange of tokens gives postings and
    totals; all readers of it have equal plans up to there. It deals by document, so
    no task holds a frequent token's postings, and scores need no second exchange.
    """
    asked = terms_asked(queries, tokenize)
    wanted = asked.select(F.col("token").alias("wanted")).distinct()
    wanted = near(asked)(wanted.unionByName(queries.sparkSession.range(1).select(F.lit("").alias("wanted"))))
    kept = _each_token(docs, tokenize).join(wanted, F.col("token") == F.col("wanted"), "left_semi").repartition("doc_id")
    posted = kept.groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))
    mark = F.col("token") == ""
    totals = posted.agg(F.sum(F.when(mark, F.col("tf"))).alias("n_docs"), (F.sum(F.when(mark, F.col("dl") * F.col("tf"))) / F.sum(F.when(mark, F.col("tf")))).alias("mean"))
    return asked, posted, totals


def _each_token(docs: DataFrame, tokenize: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, dl, token): the tokens of each document, and after them one empty token."""
    bag = docs.select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("bag"))
    return bag.select("doc_id", F.size("bag").alias("dl"), F.explode(F.array_append("bag", F.lit(""))).alias("token"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, tokenize: Callable[[Column], Column] = T.tokens, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, n_terms, rank) of queries(query_id, query) and docs(doc_id, text).

    Tokens that a query repeats count each time; n_terms: different tokens met.
    With `digits`, scores are rounded before they are ranked, so equal rounded
    scores go by doc_id. A task hands on k rows of a query.
    """
    return top_k(_scores(queries, docs, k1, b, tokenize, digits, k), k)


def bm25_scores(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, tokenize: Callable[[Column], Column] = T.tokens, digits: int | None = None) -> DataFrame:
    """As bm25, all documents that share a token with a query, without ranks."""
    return _scores(queries, docs, k1, b, tokenize, digits, None)


def _scores(queries: DataFrame, docs: DataFrame, k1: float, b: float, tokenize: Callable[[Column], Column], digits: int | None, k: int | None) -> DataFrame:
    """(query_id, doc_id, score, n_terms), of which a task may leave out what is not among the k best of a query.

    Up to 2^18 terms of queries, read first, go to every task if it need not keep over 2^20 rows; there the scores
    of whole documents are summed by arrays. More are joined to the corpus.
    """
    asked = terms_asked(queries, tokenize)
    few = asked.limit(_NEAR_ROWS + 1).toArrow()
    if few.num_rows > _NEAR_ROWS or pc.count_distinct(few.column("query_id"), "all").as_py() * (k or 0) > _HELD_ROWS:
        return _joined_scores(queries, docs, k1, b, tokenize, digits)
    return _summed_scores(few, asked.schema["query_id"].dataType.simpleString(), docs, k1, b, tokenize, digits, k)


def _joined_scores(queries: DataFrame, docs: DataFrame, k1: float, b: float, tokenize: Callable[[Column], Column], digits: int | None) -> DataFrame:
    asked, posted, totals = query_postings(queries, docs, tokenize)
    df = posted.groupBy("token").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    known = df.crossJoin(F.broadcast(totals)).select("token", "mean", idf.alias("idf"))  # totals is one row
    hits = posted.join(near(asked)(asked.join(known, "token")), "token").withColumn("w", weight)
    score = F.sum(F.col("w") * F.col("qtf"))
    return hits.groupBy("query_id", "doc_id").agg((score if digits is None else F.round(score, digits)).alias("score"), F.count("*").alias("n_terms"))


#: Query-document pairs of a slice of documents, best rows a task may keep, and terms of documents unpacked at once.
_CELLS, _HELD_ROWS, _UNPACKED = 1 << 20, 1 << 20, 1 << 18


def _changes(ids: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal."""
    now, before = ids.slice(1), ids.slice(0, max(len(ids) - 1, 0))
    same = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before)))
    return np.append(np.ones(min(len(ids), 1), dtype=bool), ~same.to_numpy(zero_copy_only=False))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch of (doc_id, dl, tid) of one document in a batch: its term numbers, each once, and how often each is there."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _changes(batch.column("doc_id")) | _changes(batch.column("dl"))
        key, n = np.unique((np.cumsum(new) - 1 << 32) | batch.column("tid").to_numpy().astype(np.int64), return_counts=True)
        offsets = pa.array(np.append(np.flatnonzero(np.diff(key >> 32, prepend=-1)), len(key)), pa.int32())
        first = pa.array(np.flatnonzero(new))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key & 0xFFFFFFFF, n)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(first), batch.column("dl").take(first), *lists], names=["doc_id", "dl", "tids", "tfs"])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, doc, tid, dl, tf) of whole documents, of rows as `_packed` makes them in order of doc_id: doc is the place in doc_ids.

    Rows of a doc_id that have one length count as one. The last document waits for more of it, as one entry for each (tid, dl).
    """
    held = None
    for batch in batches:
        sizes = pc.list_value_length(batch.column("tids")).to_numpy()
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _UNPACKED, side="right")))
            part, size, at = batch.slice(at, to - at), sizes[at:to], to
            ids, row = part.column("doc_id"), np.repeat(np.arange(len(size)), size)
            entries = part.column("tids").flatten().to_numpy(), np.repeat(part.column("dl").to_numpy(), size), part.column("tfs").flatten().to_numpy().astype(np.int64)
            if held:
                ids, row = pa.concat_arrays([held[0], ids]), np.append(np.zeros(len(held[1]), dtype=np.int64), row + 1)
                entries = [np.append(x, y) for x, y in zip(held[1:], entries)]
            new = _changes(ids)
            tid, dl, tf = entries
            doc, ids = (np.cumsum(new) - 1)[row], ids.take(pa.array(np.flatnonzero(new)))
            order = np.lexsort((dl, tid, doc))
            doc, tid, dl, tf = doc[order], tid[order], dl[order], tf[order]
            once = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(tid, prepend=-1) != 0) | (np.diff(dl, prepend=-1) != 0))
            doc, tid, dl, tf = doc[once], tid[once], dl[once], np.add.reduceat(tf, once)
            last = len(ids) - 1
            cut = int(np.searchsorted(doc, last))
            if last:
                yield ids.slice(0, last), doc[:cut], tid[:cut], dl[:cut], tf[:cut]
            held = ids.slice(last), tid[cut:], dl[cut:], tf[cut:]
    if held:
        yield held[0], np.zeros(len(held[1]), dtype=np.int64), *held[1:]


def _weighed(batches: Iterable[pa.RecordBatch], weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: np.ndarray, most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, doc, tid, weight, n) of slices of documents: the sum of weigh(tf, dl) for each term and how many entries it has.

    A slice has at most `most` documents, and `_CELLS` of the pairs[tid] that a term makes, or is one document.
    """
    for ids, doc, tid, dl, tf in _unpacked(batches):
        once = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(tid, prepend=-1) != 0))
        weight, n = np.add.reduceat(weigh(tf, dl), once), np.diff(np.append(once, len(tid)))
        doc, tid = doc[once], tid[once]
        ends = np.searchsorted(doc, np.arange(len(ids)), side="right")
        met = np.append(0, np.cumsum(pairs[tid]))[ends]
        at = 0
        while at < len(ids):
            to = int(np.searchsorted(met, (met[at - 1] if at else 0) + _CELLS, side="right"))
            to = min(max(to, at + 1), at + most, len(ids))
            own = slice(ends[at - 1] if at else 0, ends[to - 1])
            yield ids.slice(at, to - at), doc[own] - at, tid[own], weight[own], n[own]
            at = to


def _summed_scores(asked: pa.Table, query_type: str, docs: DataFrame, k1: float, b: float, tokenize: Callable[[Column], Column], digits: int | None, k: int | None) -> DataFrame:
    """Scores by terms that go to every task; k None: all.

    The corpus is tokenised once and written as short rows of the numbers of a document's terms, each with its count;
    number 0 stands for the document itself. These rows are dealt by document, so that what repeats a doc_id comes together,
    once to count the documents of each term and once to score them. Equal texts get equal scores, to the last bit.
    """
    spark = docs.sparkSession
    asked = asked.sort_by([("token", "ascending"), ("query_id", "ascending")])
    terms, query = (asked.column(c).combine_chunks().dictionary_encode("encode") for c in ("token", "query_id"))
    tid, query, query_ids = terms.indices.to_numpy().astype(np.int64) + 1, query.indices.to_numpy().astype(np.int64), query.dictionary
    n_terms, n_queries = len(terms.dictionary) + 1, len(query_ids)
    pairs = np.bincount(tid, minlength=n_terms)
    most = max(1, _CELLS // max(n_queries, 1))

    wanted = spark.createDataFrame(pa.table({"tid": pa.array(range(n_terms), pa.int32()), "wanted": pa.array(["", *terms.dictionary.to_pylist()], pa.string())}))
    met = _each_token(docs, tokenize).join(F.broadcast(wanted), F.col("token") == F.col("wanted")).select("doc_id", "dl", "tid")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    packed = written(met.mapInArrow(_packed, f"doc_id {doc_type}, dl int, tids array<int>, tfs array<int>"), "postings")
    dealt = packed.repartition("doc_id").sortWithinPartitions("doc_id")

    def tally(batches):
        df, n_words = np.zeros(n_terms, dtype=np.int64), 0
        for _, _, tid, dl, tf in _unpacked(batches):
            mark = tid == 0
            df += np.bincount(tid[~mark], minlength=n_terms)
            df[0] += tf[mark].sum()
            n_words += int((dl[mark] * tf[mark]).sum())
        yield pa.RecordBatch.from_pydict({"tid": pa.array(np.arange(n_terms), pa.int32()), "n": df, "n_words": np.where(np.arange(n_terms) == 0, n_words, 0)})

    known = dealt.mapInArrow(tally, "tid int, n long, n_words long").groupBy("tid").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words")).toArrow()
    df = np.zeros(n_terms)
    df[known.column("tid").to_numpy()] = known.column("n").to_numpy()
    n_docs, words = df[0], pc.sum(known.column("n_words")).as_py()
    mean = words / n_docs if words else 1.0
    gain = np.log((n_docs - df[tid] + 0.5) / (df[tid] + 0.5) + 1) * asked.column("qtf").to_numpy()
    sent = spark.sparkContext.broadcast((query_ids, query, gain))
    first = np.cumsum(pairs) - pairs

    def score(batches):
        query_ids, query, gain = sent.value
        least = np.full(n_queries, -np.inf)
        best, seen = None, 0
        for doc_ids, doc, tid, weight, n in _weighed(batches, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)), pairs, most):
            asking = pairs[tid]
            row = np.repeat(np.arange(len(tid)), asking)
            at = np.arange(len(row)) + np.repeat(first[tid] - (np.cumsum(asking) - asking), asking)
            cell, shape = query[at] * len(doc_ids) + doc[row], (n_queries, len(doc_ids))
            total = np.bincount(cell, weight[row] * gain[at], minlength=shape[0] * shape[1]).reshape(shape)
            terms = np.bincount(cell, n[row], minlength=shape[0] * shape[1]).reshape(shape).astype(np.int64)
            total = total if digits is None else np.round(total, digits)
            q, d = np.nonzero((terms > 0) & (total >= least[:, None]))
            found = q, total[q, d], d + seen, terms[q, d], doc_ids.take(pa.array(d))
            seen += len(doc_ids)
            if k is None:
                yield rows(query_ids, *found)
                continue
            if best is not None:
                found = *(np.concatenate(x) for x in zip(best[:4], found[:4])), pa.concat_arrays([best[4], found[4]])
            q, s, place, *_ = found
            order = np.lexsort((place, -s, q))
            nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            least[q[order[nth == k - 1]]] = s[order[nth == k - 1]]
            order = order[nth < k]
            best = *(x[order] for x in found[:4]), found[4].take(pa.array(order))
        if best is not None:
            yield rows(query_ids, *best)

    def rows(query_ids, q, s, place, terms, doc_ids):
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), doc_ids, pa.array(s, pa.float64()), pa.array(terms, pa.int64())], names=["query_id", "doc_id", "score", "n_terms"])

    return dealt.mapInArrow(score, f"query_id {query_type}, doc_id {doc_type}, score double, n_terms long")


_PACKED_VALUES = 1 << 23


def dense(queries: DataFrame, corpus: DataFrame, k: int = 50, least: float | None = None, block: int = 256, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine of queries(query_id, vector) and corpus(doc_id, vector).

    With `digits`, scores are rounded before any selection, so equal rounded scores go by doc_id.
    Vectors that are null, hold nulls or have another dimension than a query do not meet it.

    The corpus is read where it lies. Queries of at most 2^23 numbers in all (64 MB), which are counted first, go to
    every task; more are packed into blocks of about `block` vectors, rows of a table that is joined to the corpus's
    Arrow batches. A batch hands on k rows a query.
    """
    spark = queries.sparkSession
    good = lambda t: t.where("vector is not null and not exists(vector, x -> x is null)")
    queries, corpus = good(queries.select("query_id", "vector")), good(corpus.select("doc_id", "vector"))
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("values")).first()
    schema = "query_id long, doc_id long, score double"
    if not size.n:
        return spark.createDataFrame([], f"{schema}, rank int")

    def met(asked: list, have: list) -> pd.DataFrame | None:
        out = []
        for dim in {len(x["vector"]) for x in asked}:
            mine, rows = [x for x in asked if len(x["vector"]) == dim], [x for x in have if len(x["vector"]) == dim]
            if not rows:
                continue
            q, x = (np.array([r["vector"] for r in part], dtype=np.float64).reshape(len(part), dim) for part in (mine, rows))
            ids = np.array([r["doc_id"] for r in rows])
            norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
            score = np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm > 0)
            score = score if digits is None else np.round(score, digits)
            for i, r in enumerate(mine):
                best = np.lexsort((ids, -score[i]))[:k]
                out.append(pd.DataFrame({"query_id": r["query_id"], "doc_id": ids[best], "score": score[i][best]}))
        return pd.concat(out) if out else None

    if size["values"] <= _PACKED_VALUES:
        sent = spark.sparkContext.broadcast([{"query_id": r.query_id, "vector": list(r.vector)} for r in queries.collect()])

        def run(batches):
            for b in batches:
                for lo in range(0, len(b), 1024):
                    part = b.iloc[lo : lo + 1024]
                    found = met(sent.value, [{"doc_id": d, "vector": v} for d, v in zip(part["doc_id"], part["vector"])])
                    if found is not None:
                        yield found

        scored = corpus.mapInPandas(run, schema)
    else:
        packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(-(-size.n // block))).alias("part")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
        rows = corpus.select(F.spark_partition_id().alias("at"), F.struct("doc_id", "vector").alias("row"))
        grouped = rows.groupBy("at", (F.monotonically_increasing_id() / 512).cast("long").alias("piece")).agg(F.collect_list("row").alias("rows"))

        def run_packed(batches):
            for b in batches:
                for asked, have in zip(b["asked"], b["rows"]):
                    if (found := met(asked, have)) is not None:
                        yield found

        scored = grouped.crossJoin(packed).select("asked", "rows").mapInPandas(run_packed, schema)
    return top_k(scored if least is None else scored.where(F.col("score") >= least), k)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def min_max(value: Column, group: str) -> Column:
    """Scaled to 0..1 within a group; as it is where all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(value)


def rrf(lists: DataFrame, k: int = 20, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists(query_id, retriever, doc_id, rank): min-max over all, then the k best."""
    fused = lists.groupBy("query_id", "doc_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("raw"), F.count("*").alias("n_lists"))
    return top_k(fused.withColumn("score", F.round(min_max(F.col("raw"), "query_id"), 9)), k).drop("raw")


def weighted(lists: DataFrame, weights: dict[str, float], k: int = 20) -> DataFrame:
    """Weighted sum of scores of lists(query_id, retriever, doc_id, score): min-max over all, then the k best."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("retriever") == name, w).otherwise(weight)
    fused = lists.groupBy("query_id", "doc_id").agg(F.sum(weight * F.coalesce("score", F.lit(0.0))).alias("raw"))
    return top_k(fused.withColumn("score", F.round(min_max(F.col("raw"), "query_id"), 9)), k).drop("raw")


def fusion_stats(lists: DataFrame) -> DataFrame:
    """Per query: hits, distinct documents, documents in several lists, and Jaccard of two lists."""
    per = lists.groupBy("query_id", "doc_id").agg(F.count_distinct("retriever").alias("n"), F.count("*").alias("hits"))
    out = per.groupBy("query_id").agg(F.sum("hits").alias("total"), F.count("*").alias("unique_docs"), F.count_if(F.col("n") > 1).alias("overlap"))
    return out.withColumn("jaccard", F.round(F.col("overlap") / F.col("unique_docs"), 6))


def crowding_penalty(ranked: DataFrame, group: str, per: str = "query_id") -> DataFrame:
    """ranked(per, doc_id, score, rank, group): -min(0.12, 0.035 (r - 1)) for the r-th of a group, ranked anew."""
    w = Window.partitionBy(per, group).orderBy(F.desc("score"), "rank")
    out = ranked.withColumn("penalty", -F.least(F.lit(0.12), 0.035 * (F.row_number().over(w) - 1)))
    out = out.withColumn("adjusted", F.round(F.col("score") + F.col("penalty"), 9))
    return out.withColumn("new_rank", F.row_number().over(Window.partitionBy(per).orderBy(F.desc("adjusted"), "rank")))


def lost_in_middle(ranked: DataFrame, per: str = "query_id") -> DataFrame:
    """ranked(per, rank) with place: best first and last, worst in the middle; as they are for two or fewer."""
    n = F.count("*").over(Window.partitionBy(per))
    i = F.col("rank") - 1
    moved = F.when(i == 1, n - 1).when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2))
    return ranked.withColumn("place", F.when(n <= 2, i).otherwise(moved).cast("int"))


def first_of_each(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def greedy_dedup(ranked: DataFrame, threshold: float = 0.85, per: str = "query_id") -> DataFrame:
    """Of ranked(per, rank, doc_id, vector), in order, those below the threshold to all kept before. A group is one query's top-k.

    Null vectors and those of fewer components than the longest are like no other and stay.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "doc_id"])
        dim = max((len(v) for v in rows["vector"] if v is not None), default=0)
        x = np.array([v if v is not None and len(v) == dim else [0.0] * dim for v in rows["vector"]], dtype=np.float64).reshape(len(rows), dim)
        x = np.nan_to_num(x)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        kept: list[int] = []
        for i in range(len(x)):
            if not kept or (x[kept] @ x[i]).max() < threshold:
                kept.append(i)
        return rows.iloc[kept]

    return ranked.groupBy(per).applyInPandas(run, ranked.schema)


def numbered(ranked: DataFrame, per: str = "query_id", preview: int = 100) -> DataFrame:
    """Citations 1..n of each query with a preview of the content."""
    content = F.col("content")
    shown = F.when(F.length(content) > preview, F.concat(F.substring(content, 1, preview), F.lit("..."))).otherwise(content)
    return ranked.withColumn("citation", F.row_number().over(Window.partitionBy(per).orderBy("rank", "doc_id"))).withColumn("preview", shown)


def holders(passages: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, doc_id): the first document of docs(doc_id, text) that holds each of passages(query_id, passage), of all documents.

    scores(query_id, doc_id, n_terms) are those of `bm25_scores`. A holder has all
    index terms of a passage but for the first and the last, which it may hold as
    parts of longer words; passages of one or two terms are looked for by their first
    three characters. Candidates are compared with the whole passage.
    """
    terms = passages.select("query_id", "passage", F.size(F.array_distinct(T.tokens(F.col("passage")))).alias("terms"))
    likely = scores.select("query_id", "doc_id", "n_terms").join(terms.where("terms > 2"), "query_id").where("n_terms >= terms - 2").select("query_id", "doc_id", "passage")
    short = terms.where("terms <= 2 and passage <> ''").withColumn("gram", F.substring("passage", 1, 3))
    sizes = [r.n for r in short.select(F.length("gram").alias("n")).distinct().collect()]  # 1, 2 and 3 at most
    for n in sizes:
        likely = likely.unionByName(_grams(docs, n).join(short.where(F.length("gram") == n), "gram").select("query_id", "doc_id", "passage"))
    held = likely.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage"))
    return held.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))


def _grams(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, gram): the distinct substrings of n characters of each text."""
    at = F.sequence(F.lit(1), F.length("text") - (n - 1))
    grams = F.array_distinct(F.transform(at, lambda i: F.col("text").substr(i, F.lit(n))))
    return docs.where(F.length("text") >= n).select("doc_id", F.explode(grams).alias("gram"))
