"""Operator 4: language identification by partial matching (PPM).

For each language the byte contexts of length 0 to ``order`` form a context
tree with frozen counts.  A byte costs, in the longest context that the tree
knows: -log2(count / (total + distinct)) if it was seen there, else the escape
-log2(distinct / (total + distinct)) and the same again in the context that is
one byte shorter; below the empty context 8 bits.  (Escape method C.)  A text's
code length is the sum over its bytes, the language of the least code length
wins, ties go to the first in alphabetical order, and the score is that
language's share of 2^-length over all languages.

A byte's cost depends on it and ``order`` bytes before it only, so the trees
are compiled: every (order + 1)-gram seen gets its cost in every language, in
one hash table; grams not seen are worked out from the trees.  Sums are exact
code lengths.  Scoring is one map without a shuffle.

The trees are counted, distributed, on a sample of about ``train_docs``
documents of each language (whole texts; chosen by a hash of the id).

Edge cases: a null text or one without a letter is ``und`` with score 0, and so
is every text if nothing could be learned; letters without case: A-Z count as
a-z, digits as one digit and white space as a blank; a text begins after
blanks; repeated rows get one result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import text_bytes, text_chunks

UNKNOWN = "und"
CHUNK_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _byte_map() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[48:58] = ord("0")
    out[list(b"\t\n\r\x0b\x0c")] = 32
    return out


MAP = _byte_map()


def grams(raw: np.ndarray, at: np.ndarray, first: int, end: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(order + 1)-grams of the rows first..end, blanks before each, and where each row's begin (one more than rows)."""
    lengths = np.diff(at[first:end + 1])
    begins = np.append(0, np.cumsum(lengths + order))
    padded = np.full(begins[-1] + order, 32, np.uint8)
    place = np.arange(lengths.sum()) + np.repeat((np.arange(len(lengths)) + 1) * order, lengths)
    padded[place] = MAP[raw[at[first]:at[end]]]
    gram = np.zeros(begins[-1], np.uint64)
    for k in range(order + 1):
        gram = gram << np.uint64(8) | padded[k:k + len(gram)]
    return gram, begins  # a row's last ``order`` grams lie in the next row's blanks


@dataclass
class ContextTrees:
    """Frozen statistics of one language, by context length."""

    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    grams: list[np.ndarray]
    counts: list[np.ndarray]

    @staticmethod
    def count(gram: np.ndarray, n: np.ndarray, order: int) -> ContextTrees:
        trees = ContextTrees([], [], [], [], [])
        for k in range(order + 1):
            own, back = np.unique(gram & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(back, n, len(own))
            contexts, context = np.unique(own >> np.uint64(8), return_inverse=True)
            for kept, values in ((trees.grams, own), (trees.counts, counts), (trees.contexts, contexts),
                                 (trees.totals, np.bincount(context, counts, len(contexts))),
                                 (trees.distinct, np.bincount(context, minlength=len(contexts)).astype(float))):
                kept.append(values)
        return trees

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        cost = np.zeros(len(gram))
        left = np.arange(len(gram))
        for k in range(len(self.grams) - 1, -1, -1):
            own = gram[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            where = _find(self.contexts[k], own >> np.uint64(8))
            known = where >= 0
            total, distinct = self.totals[k][where], self.distinct[k][where]
            seen = _find(self.grams[k], own)
            hit = seen >= 0
            cost[left[hit]] -= np.log2(self.counts[k][seen[hit]] / (total + distinct)[hit])
            escape = known & ~hit
            cost[left[escape]] -= np.log2((distinct / (total + distinct))[escape])
            left = left[~hit]
            if not len(left):
                return cost
        cost[left] += 8
        return cost


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in a sorted table, -1 where it isn't."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


class LanguageModel:
    def __init__(self, languages: list[str], trees: list[ContextTrees], order: int):
        self.languages, self.trees, self.order = languages, trees, order
        known = np.unique(np.concatenate([t.grams[order] for t in trees])) if trees else np.empty(0, np.uint64)
        self.bits = max(8, int(len(known) * 2).bit_length())
        self.table = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.row = np.zeros(1 << self.bits, np.int32)
        self.costs = self.cost(known)
        slot, left = self._slot(known), np.arange(len(known))
        while len(left):  # linear probing, all grams a step at a time
            empty = self.table[slot[left]] == np.iinfo(np.uint64).max
            at, which = np.unique(slot[left[empty]], return_index=True)
            placed = left[empty][which]
            self.table[at], self.row[at] = known[placed], placed
            left = left[~np.isin(left, placed)]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * GOLDEN >> np.uint64(64 - self.bits)).astype(np.int64)

    def cost(self, gram: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros((len(gram), 0))
        return np.stack([t.bits(gram) for t in self.trees], 1)

    def lookup(self, gram: np.ndarray) -> np.ndarray:
        slot, found = self._slot(gram), np.full(len(gram), -1, np.int32)
        left = np.arange(len(gram))
        while len(left):
            there = self.table[slot[left]]
            hit = there == gram[left]
            found[left[hit]] = self.row[slot[left[hit]]]
            left = left[~hit & (there != np.iinfo(np.uint64).max)]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
        out = self.costs[np.maximum(found, 0)]
        new = np.flatnonzero(found < 0)
        if len(new):
            own, back = np.unique(gram[new], return_inverse=True)
            out[new] = self.cost(own)[back]
        return out

    def code_lengths(self, raw: np.ndarray, at: np.ndarray, first: int, end: int) -> np.ndarray:
        """Bits of each row in each language."""
        out = np.zeros((end - first, len(self.languages)))
        width = max(CHUNK_BYTES // max(len(self.languages), 1), 1 << 14) * 4
        for row in range(first, end):  # rows longer than a chunk come one at a time, in pieces
            if at[row + 1] - at[row] > width:
                for begin in range(at[row], at[row + 1], width):
                    back = min(self.order, begin - at[row])
                    piece = np.array([begin - back, min(begin + width, at[row + 1])])
                    gram, _ = grams(raw, piece, 0, 1, self.order)
                    out[row - first] += self.lookup(gram[back:piece[1] - piece[0]]).sum(0)
        short = np.diff(at[first:end + 1]) <= width
        if short.any():
            gram, begins = grams(raw, at, first, end, self.order) if short.all() else (None, None)
            if gram is None:
                raise ValueError("a chunk is one long row or short rows")
            costs = self.lookup(gram)
            ends = begins[1:] - self.order
            edges = np.append(np.stack([begins[:-1], ends], 1).ravel(), 0)[:-1]
            sums = np.add.reduceat(np.concatenate([costs, np.zeros((1, costs.shape[1]))]), edges, axis=0)[::2]
            sums[ends == begins[:-1]] = 0
            out += sums
        return out


def _columns(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), *more)


def fit(docs: DataFrame, learn: Column, order: int = 3, train_docs: int = 600) -> LanguageModel:
    """``learn``: a predicate on doc_id that says which rows may be learned from.  Whole texts of about ``train_docs``
    documents of each language are counted; the driver gets their distinct grams."""
    rows = _columns(docs, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("letters") & learn)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], [], order)
    languages = sorted(sizes)
    parts = 1 << 24
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(parts, -(-parts * train_docs // n)))) for k, n in sizes.items()])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                raw, at = text_bytes(batch.filter(pa.compute.equal(langs, lang)).column("text"))
                for first, end in text_chunks(raw, at, CHUNK_BYTES):
                    gram, begins = grams(raw, at, first, end, order)
                    real = np.ones(len(gram), bool)
                    real[(begins[1:, None] - 1 - np.arange(order)).ravel()] = False
                    own, n = np.unique(gram[real], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(own)), pa.array(own.astype(np.int64)), pa.array(n.astype(np.int64))],
                                          ["lang", "gram", "n"])

    counts = (sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))).toArrow()
    lang, gram, n = (counts.column(c).to_numpy() for c in ("lang", "gram", "n"))
    learned = [k for k in languages if (lang == k).any()]
    return LanguageModel(learned, [ContextTrees.count(gram[lang == k].astype(np.uint64), n[lang == k], order) for k in learned], order)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row, in one map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            lengths = [np.zeros((0, len(m.languages)))]
            for first, end in text_chunks(raw, at, max(CHUNK_BYTES // max(len(m.languages), 1), 1 << 14)):
                lengths.append(m.code_lengths(raw, at, first, end) if m.languages else np.zeros((end - first, 0)))
            bits = np.concatenate(lengths)
            known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            best, score = np.full(len(known), len(m.languages)), np.zeros(len(known))
            if m.languages:
                best = np.where(known, bits.argmin(1), best)
                share = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
                score = np.where(known, np.round(share, 9), 0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                                  ["doc_id", "lang_pred", "score"])

    return _columns(docs).mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
