"""Operator 2: token counts by count-only Viterbi.

A text is segmented into the vocabulary pieces with the largest sum of scores,
as a unigram tokenizer does it, but only the number of pieces and the score
are carried along.  An Aho-Corasick automaton enumerates the pieces that end
at each place; dynamic programming keeps the best score, and its piece count,
up to there.  Rules, as in public unigram tokenizers: blanks count as U+2581
and one stands before a text; a character that is no piece of its own may be
unknown, at 10 under the smallest score; a later candidate replaces the best
only if its score is larger, candidates come by their beginning, so the
longest last piece wins a tie; an unknown character counts its UTF-8 bytes with
byte fallback, else neighbouring unknown ones count as one.

No piece reaches over the beginning of a blank (checked when the vocabulary is
read), so words are segmented apart and remembered, up to a fixed number of
them per worker.  One map over the documents, without a shuffle.

Edge cases: null and empty texts have no tokens and score 0; repeated rows get
one result each; a text without blanks is one word and costs time in
proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "\u2581"
UNKNOWN_PENALTY = 10.0
REMEMBER = 600_000  # words per worker
REMEMBER_LENGTH = 48


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(tuple((model.id_to_piece(i), model.get_score(i)) for i in plain), any(model.is_byte(i) for i in ids))


class Counting:
    def __init__(self, vocabulary: Vocabulary):
        pieces = dict(vocabulary.pieces)
        self.byte_fallback = vocabulary.byte_fallback
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        apart = not any(BLANK in p.lstrip(BLANK) for p in pieces) and (self.byte_fallback or BLANK in pieces)
        line_apart = apart and self.byte_fallback and not any("\n" in p and p != "\n" for p in pieces)
        self.cut = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n" if line_apart else f"{BLANK}*[^{BLANK}]+|{BLANK}+"
                              if apart else r"[\s\S]+").findall
        self.known: dict[str, tuple[int, float]] = {}

    def segment(self, s: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of one word."""
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(s) + 1)]
        if not self.empty:
            for end, piece in self.automaton.iter(s):  # by end, the longest first
                ends[end + 1].append(piece)
        best, count, unknown = [0.0], [0], [False]
        for end in range(1, len(s) + 1):
            top, n, single = float("-inf"), 0, False
            for length, score in ends[end]:
                begin = end - length
                if best[begin] + score > top:
                    top, n = best[begin] + score, count[begin] + 1
                single = single or length == 1
            is_unknown = not single and best[end - 1] + self.unknown > top
            if is_unknown:
                top = best[end - 1] + self.unknown
                n = count[end - 1] + (len(s[end - 1].encode()) if self.byte_fallback else not unknown[end - 1])
            best.append(top)
            count.append(n)
            unknown.append(is_unknown)
        return count[-1], best[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        tokens, score = 0, 0.0
        for word, times in Counter(self.cut(BLANK + text.replace(" ", BLANK))).items():
            got = self.known.get(word)
            if got is None:
                got = self.segment(word)
                if len(word) <= REMEMBER_LENGTH:
                    if len(self.known) >= REMEMBER:
                        self.known.clear()
                    self.known[word] = got
            tokens += times * got[0]
            score += times * got[1]
        return tokens, score


_COUNTING: dict[Vocabulary, Counting] = {}  # of this worker


def _counting(vocabulary: Vocabulary) -> Counting:
    if vocabulary not in _COUNTING:
        _COUNTING.clear()
        _COUNTING[vocabulary] = Counting(vocabulary)
    return _COUNTING[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(shared.value)
        for batch in batches:
            got = [counting.count(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()),
                                   pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, score double")
