"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place of
a word; dynamic programming carries the best score so far and the number of its
pieces, never the pieces. Tie rule of unigram tokenizers: of equal scores the
path whose last piece starts earlier wins, as a later candidate must be strictly
better. The unknown rule: a character that is no piece itself may be passed at 10 below
the least score and counts one token for each of its UTF-8 bytes (byte fallback).

Words are runs of other than ASCII white space, each with a leading mark;
pieces do not cross words, so each task counts a word once and keeps it, up to
64 bytes long, in a memo of bounded size. One pass over each row, no shuffle.

The vocabulary is read from a file of pieces where the task runs. The public file
is one of byte-pair merges and has ranks, not probabilities; nothing is trained,
the pieces get log-probabilities from their ranks by Zipf's law. The counts are
those of this unigram vocabulary, an estimate of the file's own tokenizer's, not
its counts.

Edge cases: null, empty and wordless texts have 0 tokens; repeated rows give
repeated results; a null doc_id is kept; other columns pass through
`with_counts` (its result columns replace clashing ones).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lorestream.llm.common import byte_slices, steady

MARK = "▁"
_MEMO, _LONGEST = 300_000, 64
_UNKNOWN = 10.0
RESULT = "n_words long, n_tokens long, score double"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Normal pieces of a sentencepiece file with log-probabilities by Zipf's law from their ranks.

    The file's own scores are minus the rank, which no probability is; those of
    pieces without a rank (runs of marks) are -1e9. Pieces that hold nothing but
    several marks are left out, as no word has them; the single mark, which every
    word may need, takes the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i)
    ranks = {model.id_to_piece(i): -float(model.get_score(i)) for i in range(model.get_piece_size()) if not skip(i)}
    ranks = {piece: rank for piece, rank in ranks.items() if piece.strip(MARK)}
    ranks[MARK] = max(ranks.values()) + 1
    total = math.log(math.fsum(1 / (rank + 1) for rank in ranks.values()))
    return [(piece, -math.log(rank + 1) - total) for piece, rank in ranks.items()]


class Counter:
    """(score, pieces) of the best segmentation of single words."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.missing = min(score for _, score in pieces) - _UNKNOWN
        self.known: dict[bytes, tuple[float, int]] = {}

    def best(self, text: str) -> tuple[float, int]:
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        scores, counts = [0.0], [0]
        for end, found in enumerate(ends):
            best, count = None, 0
            for length, score in sorted(found, reverse=True):  # earliest start first
                at = end + 1 - length
                total = scores[at] + score
                if best is None or total > best:
                    best, count = total, counts[at] + 1
            if not found or found[-1][0] != 1 and min(found)[0] != 1:
                total = scores[end] + self.missing
                if best is None or total > best:
                    best, count = total, counts[end] + len(text[end].encode())
            scores.append(best)
            counts.append(count)
        return scores[-1], counts[-1]

    def __call__(self, text: str) -> tuple[int, int, float]:
        words = text.encode().split()
        known = self.known
        for w in set(words).difference(known):
            if len(known) >= _MEMO:
                known.clear()
                break
        for w in set(words).difference(known):
            known[w] = self.best(MARK + w.decode())
        found = [known[w] for w in words]
        for w in [w for w in set(words) if len(w) > _LONGEST]:
            del known[w]
        return len(words), sum(c for _, c in found), float(sum(s for s, _ in found))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary(path))
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in byte_slices(batches):
            cols = list(zip(*(count(t or "") for t in batch.column("text").to_pylist()))) or [(), (), ()]
            own = [(n, batch.column(n)) for n in batch.schema.names if n not in names]
            new = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([c for _, c in own] + new, names=[n for n, _ in own] + names)

    return run


def with_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs(text, ...) with n_words, n_tokens and the score of the segmentation."""
    own = steady(docs).drop(*(x.split()[0] for x in RESULT.split(", ")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(_counted(path), f"{schema}, {RESULT}")
