"""Line deduplication against brute force."""
import random
import re

import pytest
import xxhash

from logweave.llm import line_dedup as L


def plain_norm(line):
    return re.sub(" +", " ", line.translate(str.maketrans("\t\r", "  ")).strip(" ")).lower()


def words_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_removed(docs, least_words=2, near_words=8):
    """{(doc_id, text): set of line numbers}"""
    signed = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    places = []
    for doc_id, text in {(d, t) for d, t in docs if t is not None}:
        for k, line in enumerate(text.split("\n")):
            words = plain_norm(line).split(" ") if plain_norm(line) else []
            if len(words) >= least_words:
                places.append(((doc_id is None, doc_id or 0, signed(text), k), words, (doc_id, text)))
    places.sort(key=lambda p: p[0])
    gone = {}
    for i, (at, words, doc) in enumerate(places):
        for _, other, _ in places[:i]:
            if other == words or min(len(words), len(other)) >= near_words and abs(len(words) - len(other)) < 2 \
                    and words_apart(words, other) <= 1:
                gone.setdefault(doc, set()).add(at[3])
                break
    return gone


def make_docs(rng, n):
    vocab = ["ab", "cd", "Éf", "gh", "ij", "kl"]
    pool = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))] for _ in range(40)]
    docs = [(None, "no id here\nand a second line"), (None, None), (3, ""), (3, "\n\n \t"), (4, "x"), (4, "x")]
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, kind = rng.randrange(len(words)), rng.choice("ria")
                if kind == "r":
                    words[at] = rng.choice(vocab).upper()
                elif kind == "i":
                    words.insert(at, rng.choice(vocab))
                elif len(words) > 1:
                    del words[at]
            lines.append(rng.choice([" ", " ", "  "]).join(words) + rng.choice(["", "", " ", "\r"]))
        docs.append((i // 2 * 2, "\n".join(lines)))
    return docs + docs[10:14]


@pytest.mark.parametrize("seed", [3])
def test_matches_brute_force(spark, seed):
    docs = make_docs(random.Random(seed), 60)
    df = spark.createDataFrame([(d, t, "keep", 1) for d, t in docs], "doc_id long, text string, line string, removed int")
    want = plain_removed(docs)
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "removed_lines"]
    left = lambda d, t: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get((d, t), ()))
    got = sorted(((r.doc_id, r.text, r.removed_lines) for r in out.collect()), key=repr)
    assert got == sorted(((d, left(d, t), len(want.get((d, t), ()))) for d, t in docs), key=repr)


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lines(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:1500] + ["new"] + words[1500:]), " ".join(words[:-2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.removed_lines for r in L.dedup_lines(df).collect()} == {0: 0, 1: 1, 2: 0}
