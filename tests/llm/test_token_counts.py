"""Token counts against a public unigram tokenizer."""
import random

import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from logweave.llm import token_counts as T

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TIED = (("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("ba", -2.0), ("aba", -3.0), ("bb", -2.0))


def tokenizer(vocabulary):
    extra = [(f"<0x{i:02X}>", -5e5) for i in range(256)] if vocabulary.byte_fallback else []
    return Tokenizer(Unigram([("<unk>", 0.0), *vocabulary.pieces, *extra], 0, vocabulary.byte_fallback))


def expected(tok, text):
    return len(tok.encode("▁" + text.replace(" ", "▁")).ids) if text else 0


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_and_unknown_characters(fallback):
    vocabulary = T.Vocabulary(TIED, fallback)
    counting, tok, rng = T.Counting(vocabulary), tokenizer(vocabulary), random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice("ab ab cé\n") for _ in range(rng.randrange(14)))
        assert counting.count(text)[0] == expected(tok, text), text


def test_score_is_the_best_sum():
    counting = T.Counting(T.Vocabulary((("▁", -1.0), ("x", -3.0), ("xy", -4.0), ("y", -3.0), ("▁x", -1.5)), True))
    assert counting.count("xy") == (2, -4.5)  # "▁x" "y", not "▁" "xy"


def test_documents(spark):
    vocabulary = T.read_vocabulary(PATH)
    tok = tokenizer(vocabulary)
    texts = [None, "", " ", "a  b", "  x", "Hello world, hello WORLD!", "漢字\n\n zz", "x" * 5000, "tab\tand\r\nlines ", "Hello world"]
    docs = spark.createDataFrame([(i % 9, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens) for r in T.count_tokens(docs, vocabulary).collect())
    assert got == sorted((i % 9, expected(tok, t)) for i, t in enumerate(texts))
    assert T.count_tokens(docs.limit(0), vocabulary).count() == 0


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBER", 3)
    counting = T.Counting(T.Vocabulary(TIED, True))
    first = [counting.count(w)[0] for w in "a ab aba b ba bb abab".split()]
    assert len(counting.known) <= 3 and first == [T.Counting(T.Vocabulary(TIED, True)).count(w)[0] for w in "a ab aba b ba bb abab".split()]
