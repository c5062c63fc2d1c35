"""Hashed sparse vectors: arrays of indices and weights, their postings, and dot products by a join on the index."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestream.operators.retrieval import near, top_k

# Words no sparse vector holds, the number of dimensions, and the fields a sparse text is made of.
STOPWORDS = (
    "a an and are as at be by can do does for from give how i in is it list me of on or show tell that the there these this to was were "
    "what when where which who why with"
).split()
DIMENSIONS = 2_000_003
TOKEN = re.compile(r"[\w§][\w§.-]*")
FIELDS = ("contextual_retrieval_text", "content", "source_filename", "document_id", "section_title", "heading_path", "email_subject")
LISTS = ("entity_names", "legal_codes")


def sparse_text(row: DataFrame) -> Column:
    """The fields of a row that make its sparse text, one a line; absent and empty ones are left out."""
    have = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in FIELDS if c in row.columns]
    lists = [F.filter(F.col(c), lambda x: x.isNotNull() & (x != "")) for c in LISTS if c in row.columns]
    return F.concat_ws("\n", *have, *lists)


@lru_cache(maxsize=200_000)
def _index(token: str, dimensions: int) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big") % dimensions


def _token(found: str, stop: frozenset[str] = frozenset(STOPWORDS)) -> str:
    """What is found, bare and in lower case; empty for stop words and lone letters."""
    token = found.strip(".-").lower()
    return token if token not in stop and (len(token) > 1 or token.isdigit()) else ""


def weights(text: str | None, dimensions: int = DIMENSIONS, most: int | None = 512) -> list[tuple[int, float]]:
    """(index, weight) of a text's tokens, by index, of length one: 1 + ln(count), tokens of one index added up.

    Only the first `most` tokens count, as many as the reference takes unless told otherwise; None: all.
    """
    counts: Counter[str] = Counter()
    if most is None:
        for found, n in Counter(TOKEN.findall(text or "")).items():
            if token := _token(found):
                counts[token] += n
    else:
        counts.update(islice(filter(None, (_token(x.group()) for x in TOKEN.finditer(text or ""))), most))
    sums: dict[int, float] = {}
    for token, count in counts.items():
        at = _index(token, dimensions)
        sums[at] = sums.get(at, 0.0) + 1.0 + math.log(count)
    size = math.sqrt(math.fsum(w * w for w in sums.values())) or 1.0
    return sorted((at, w / size) for at, w in sums.items())


_ROWS = 256


def with_vectors(docs: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, most: int | None = 512, keep_text: bool = True) -> DataFrame:
    """docs with `terms`, an array of (index, weight) by index, of the first `most` tokens (None: all); empty for null texts. One pass, no shuffle."""
    own = docs.drop("terms")
    names = [c for c in own.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ends, index, weight = [0], array("i"), array("d")
                for t in part.column(text):
                    for i, w in weights(t.as_py(), dimensions, most):
                        index.append(i)
                        weight.append(w)
                    ends.append(len(index))
                terms = pa.StructArray.from_arrays([pa.array(np.array(index, dtype=np.int32)), pa.array(np.array(weight, dtype=np.float64))], names=["index", "weight"])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms)], names=[*names, "terms"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*names).schema.fields)
    return own.mapInArrow(run, f"{schema}, terms array<struct<index:int,weight:double>>")


def postings(vectors: DataFrame, key: str) -> DataFrame:
    """(key, index, weight), one row for each term of vectors(key, terms)."""
    return vectors.select(key, F.inline("terms"))


def dot_top_k(queries: DataFrame, docs: DataFrame, k: int = 50, digits: int = 9) -> DataFrame:
    """The k documents of highest dot product for each query, of queries(query_id, terms) and docs(doc_id, terms); ties by doc_id.

    Few terms asked for go to every task. Of a vector only those move, dealt by document, so scores need no exchange of postings.
    """
    asked = postings(queries, "query_id").withColumnRenamed("weight", "asked")
    few = near(asked)
    kept = postings(docs.select("doc_id", "terms"), "doc_id").join(few(asked.select("index").distinct()), "index", "left_semi")
    met = kept.repartition("doc_id").join(few(asked), "index")
    scores = met.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("asked")), digits).alias("score"))
    return top_k(scores, k)
