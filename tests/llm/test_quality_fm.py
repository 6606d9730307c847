"""Factorisation machine: the linear-time identity against all pairs, features against plain counting, held-out accuracy."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import quality_fm as Q
from logweave.llm.common import crc_slice, text_bytes


def features_of(texts, stated=None):
    raw, at = text_bytes(pa.array(texts, pa.string()))
    return Q.features(raw, at, np.array(stated or [np.nan] * len(texts), float))


def test_margin_equals_all_pairs():
    rng = np.random.default_rng(3)
    fm = Q.FactorisationMachine(.3, rng.normal(size=Q.N_FEATURES).astype("f4"), rng.normal(size=(Q.N_FEATURES, 4)).astype("f4"))
    row, feature, value = features_of(["a few words here", "", None, "A few, a few more!"])
    got = fm.margin(row, feature, value)
    for r in range(4):
        x = list(zip(feature[row == r], value[row == r].astype(float), strict=True))
        want = fm.bias + sum(fm.linear[i] * v for i, v in x) + sum(
            float(fm.factors[i].astype(float) @ fm.factors[j].astype(float)) * v * w for k, (i, v) in enumerate(x) for j, w in x[:k])
        assert got[r] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_words_are_hashed_alike_everywhere():
    row, feature, value = features_of(["Alpha beta\tbeta", "beta\nALPHA", "", "gamma"])
    words = [set(feature[(row == r) & (feature < 1 << Q.WORD_BITS)]) for r in range(4)]
    assert words[0] == words[1] and len(words[0]) == 2 and not words[2] and not words[3] & words[0]
    assert all((value[(row == r) & (feature < 1 << Q.WORD_BITS)] ** 2).sum() == pytest.approx(1, rel=1e-5) for r in (0, 1, 3))


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "cdé", "x" * 40, "q"]) for _ in range(40_000))
    whole = features_of([text, "short"])
    monkeypatch.setattr(Q, "CHUNK_BYTES", 100_000)
    pieces = features_of([text, "short"])
    for a, b in zip(whole, pieces, strict=True):
        assert np.allclose(a, b)


def corpus(spark, n=240):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(rng.choice(vocab) + ("$$$" if bad else "") for _ in range(30))
        rows.append((i, text, len(text), "s", .5))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None, None, None, None), (1001, "", 0, "s", 1.0), (None, "w1 w2", None, "s", 1.0), (1, rows[1][1], 3, "t", 0.0)]
    labels += [(5, None, 0), (None, 1, 0), (7, 1, 0), (7, 1, 1), (999999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, label string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_holds_out(spark):
    docs, labels = corpus(spark)
    model = Q.fit(docs, labels, ~crc_slice(F.col("doc_id"), 5, 0))
    got = Q.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= .3) for r in got)
    assert all(r.predicted == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 240)
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 6)
    model = Q.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in Q.score(docs, model).collect()} == {.5}
    assert Q.score(docs.limit(0), model).count() == 0
