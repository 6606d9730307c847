"""PPM language identification: compiled code lengths against a plain context tree, held-out accuracy, edge cases."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import language_ppm as L
from logweave.llm.common import crc_slice


def plain_bits(train, text, order):
    """Code length of ``text`` after counting ``train``, symbol by symbol with dictionaries."""
    counts = {}
    norm = lambda t: bytes(L.MAP[list(t.encode())]) if t else b""
    for t in train:
        p = b" " * order + norm(t)
        for i in range(order, len(p)):
            for k in range(order + 1):
                counts.setdefault(p[i - k:i], {}).setdefault(p[i], 0)
                counts[p[i - k:i]][p[i]] += 1
    p, bits = b" " * order + norm(text), 0.0
    for i in range(order, len(p)):
        for k in range(order, -1, -1):
            seen = counts.get(p[i - k:i])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if p[i] in seen:
                bits -= math.log2(seen[p[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


def model_of(train, order):
    trees = []
    for texts in train.values():
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        at = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
        gram, begins = L.grams(raw, at, 0, len(texts), order)
        real = np.ones(len(gram), bool)
        real[(begins[1:, None] - 1 - np.arange(order)).ravel()] = False
        own, n = np.unique(gram[real], return_counts=True)
        trees.append(L.ContextTrees.count(own, n, order))
    return L.LanguageModel(list(train), trees, order)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths_are_exact(order, monkeypatch):
    train = {"a": ["the cat sat", "The hat 12"], "b": ["le chât été", "la tête"]}
    m = model_of(train, order)
    texts = ["the hat", "", "été zzz 99", "x", "漢 the\n cat", "the cat sat " * 2000]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    want = np.array([[plain_bits(t, x, order) for t in train.values()] for x in texts])
    got = np.concatenate([m.code_lengths(raw, at, f, e) for f, e in L.text_chunks(raw, at, 1000)])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6)
    monkeypatch.setattr(L, "CHUNK_BYTES", 1)  # a long row in pieces
    assert np.allclose(m.code_lengths(raw, at, 5, 6), want[5:], rtol=1e-9)


def test_identify(spark):
    rng = random.Random(4)
    words = {"en": ["the", "and", "that", "with"], "fr": ["été", "les", "dans", "que"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(12)), k, "x") for i in range(200) for k in [rng.choice(["en", "fr"])]]
    odd = [(900, None, "en", "x"), (901, "", "en", "x"), (902, "123 !!", "fr", "x"), (None, "the that", None, "x"), (0, rows[0][1], "fr", "y")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = L.fit(docs, ~crc_slice(F.col("doc_id"), 4, 2))
    assert model.languages == ["en", "fr"]
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert all(by_id[i] == k for i, _, k, _ in rows) and by_id[None] == "en"
    assert [by_id[i] for i in (900, 901, 902)] == ["und"] * 3
    nothing = L.fit(docs.where("lang = 'xx'"), F.lit(True))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0
