"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece in a text; dynamic programming keeps, for each
place, the best score and its number of pieces. Of equal scores the one found first wins: the piece with the
earliest start. A character without a piece of its own costs ``UNKNOWN_COST`` more than the worst piece and counts as its bytes, or as one
piece with its unknown neighbours where the vocabulary has no byte pieces.

No piece crosses from a character to a following space mark, nor holds a character that is in no piece, so
texts are cut there and equal parts are solved once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from runledger.llm.common import named

MARK = "▁"
UNKNOWN_COST = 10.0
# Parts a worker remembers the count of before it starts afresh, and the longest that it remembers.
_REMEMBERED, _LONG = 300_000, 200


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and whether unknown characters fall back to bytes."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool

    @staticmethod
    def from_sentencepiece(path: str) -> Vocabulary:
        """The ordinary pieces of a model file, with the scores it gives them."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ordinary, has_bytes = [], False
        for k in range(model.get_piece_size()):
            if model.is_byte(k):
                has_bytes = True
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                ordinary.append((model.id_to_piece(k), float(model.get_score(k))))
        return Vocabulary(tuple(ordinary), has_bytes)


class Counter:
    """Counts the pieces of the best segmentation of a text."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_fallback = vocabulary.byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.finite = all(math.isfinite(s) for _, s in vocabulary.pieces)
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_COST
        letters = {c for p, _ in vocabulary.pieces for c in p}
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary.pieces)
        # Line ends part a text only if no piece holds one.
        ends = "".join(c for c in "\n\r\t" if c not in letters)
        part = re.compile(f"[{ends}]|{MARK}*[^{MARK}{ends}]+|{MARK}+" if ends else f"{MARK}*[^{MARK}]+|{MARK}+")
        # One part at a time: a very long text has very many.
        self.parts = (lambda text: [text]) if crossing else (lambda text: map(re.Match.group, part.finditer(text)))
        self.longest = max((len(p) for p, _ in vocabulary.pieces), default=1)
        self.known: dict[str, tuple[int, float, int]] = {}

    def count(self, text: str | None) -> tuple[int, float, int]:
        """Pieces, score and unknown characters; nothing for null and empty texts."""
        if not text:
            return 0, 0.0, 0
        total, score, unknown, after_unknown = 0, 0.0, 0, False
        known, merged = self.known.get, not self.byte_fallback
        for part in self.parts(MARK + text.replace(" ", MARK)):
            solved = known(part)
            if solved is None:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                simple = self.finite and len(part) <= _LONG and self.single.issuperset(part)
                solved = self._solve_known(part) if simple else self._solve(part)
                if len(part) <= _LONG:
                    self.known[part] = solved
            pieces, cost, strange, starts, ends = solved
            # Unknown neighbours across a cut are one piece where bytes do not stand for them.
            total += pieces - (merged and after_unknown and starts)
            after_unknown = ends
            score += cost
            unknown += strange
        return total, score, unknown

    def _solve_known(self, part: str) -> tuple[int, float, int, bool, bool]:
        """Like ``_solve`` where each character has a piece of its own; for parts short enough to hold all places."""
        scores, pieces = [0.0] + [-math.inf] * len(part), [0] * (len(part) + 1)
        # Matches come by their ends, and those of one end from the longest to the shortest.
        for end, (length, worth) in self.automaton.iter(part):
            start = end + 1 - length
            score = scores[start] + worth
            if score > scores[end + 1]:
                scores[end + 1] = score
                pieces[end + 1] = pieces[start] + 1
        return pieces[-1], scores[-1], 0, False, False

    def _solve(self, part: str) -> tuple[int, float, int, bool, bool]:
        # Places further back than the longest piece are not looked at again.
        size, ring = len(part), self.longest + 1
        matches = self.automaton.iter(part) if len(self.automaton) else iter(())
        ahead = next(matches, None)
        # Per place: score, pieces, unknown characters, whether the last piece is unknown, whether the first is.
        best: list[tuple[float, int, int, bool, bool]] = [(0.0, 0, 0, False, False)] * min(ring, size + 1)
        for end in range(size):
            found = []
            while ahead is not None and ahead[0] == end:
                found.append(ahead[1])
                ahead = next(matches, None)
            chosen = None
            for length, score in sorted(found, reverse=True):
                before = best[(end + 1 - length) % ring]
                if chosen is None or before[0] + score > chosen[0]:
                    first = before[4] if end + 1 > length else False
                    chosen = (before[0] + score, before[1] + 1, before[2], False, first)
            if part[end] not in self.single:
                before = best[end % ring]
                if chosen is None or before[0] + self.unknown > chosen[0]:
                    if self.byte_fallback:
                        pieces = before[1] + len(part[end].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = before[1] + (not before[3])
                    chosen = (before[0] + self.unknown, pieces, before[2] + 1, True, before[4] if end else True)
            best[(end + 1) % ring] = chosen
        score, pieces, unknown, last, first = best[size % ring]
        return pieces, score, unknown, first, last


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``score`` and ``n_unknown`` of the whole text.

    Spaces become the mark, and one mark stands before the text. Null and empty texts have no tokens. Rows
    stand for themselves, so repeated rows give equal counts. Columns with the names of results are replaced;
    an empty table gives no rows.
    """
    results = ("n_tokens", "score", "n_unknown")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in results))
    carried = [c for c in docs.columns if c.lower() != text_column.lower()]
    rows = docs.select(F.struct(*named(carried)).alias("doc"), named([text_column])[0].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            counted = [counter.count(value.as_py()) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"),
                 pa.array([r[0] for r in counted], pa.int64()), pa.array([r[1] for r in counted], pa.float64()),
                 pa.array([r[2] for r in counted], pa.int64())],
                ["doc", *results],
            )

    return rows.mapInArrow(count, StructType([
        rows.schema["doc"], StructField("n_tokens", LongType()), StructField("score", DoubleType()),
        StructField("n_unknown", LongType()),
    ])).select("doc.*", *results)
