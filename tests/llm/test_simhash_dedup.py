"""SimHash near-duplicates against brute force."""
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import simhash_dedup as S
from logweave.llm.components import connected_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, distance):
    """{position: smallest position reachable}"""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def make_texts(rng, n):
    vocab = ["w%d" % i for i in range(300)]
    texts = [None, "", " \t\n", "one", "Two Words", "two words", "no break ÀÉ"]
    while len(texts) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "  ", "\n"]).join(own))
    return texts[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    texts = make_texts(random.Random(seed), 160)
    prints = [plain_fingerprint(t) for t in texts]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, fp string, root long")
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == plain_components(prints, 4)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(prints, 4)))


@pytest.mark.parametrize("split_over", [512, 2])
def test_dense_and_random_fingerprints(spark, split_over):
    """A dense cloud around one fingerprint, chains of four bits, and noise: no component is lost, split or not."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 6, 8])):
            x ^= 1 << b
        prints.add(x)
    chain = rng.getrandbits(64)
    for step in range(12):
        for b in rng.sample(range(64), 4):
            chain ^= 1 << b
        prints.add(chain)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, 1 + i % 3) for i, p in enumerate(signed)], "fp long, n long")
    links = S.fingerprint_links(df, 4, split_over)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    want = plain_components(prints, 4)
    by_root = {}
    for p, w in zip(signed, want, strict=True):
        by_root.setdefault(w, []).append(p)
    for group in by_root.values():
        assert {roots.get(p, p) for p in group} == {min(group)}


def test_repeated_rows_and_null_ids(spark):
    same = "a b c d e f g h"
    docs = spark.createDataFrame([(None, same), (None, "zz yy xx ww vv uu"), (7, same), (7, same), (3, same)],
                                 "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (None, None), (7, 3), (7, 3), (3, 3)], key=str)
    assert sorted(map(str, (r.doc_id for r in S.one_of_each(docs).collect()))) == ["3", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert S.near_duplicates(docs).count() == 0
    assert S.one_of_each(docs).count() == 0


def test_long_text_in_blocks():
    text = " ".join(f"t{i % 977}" for i in range(S.BLOCK + 500))
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(edges).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


def test_stars_take_one_round(spark, monkeypatch):
    """Links that are settled are stored once and by one round."""
    from logweave.llm import components as C
    names = []
    store = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: names.append(name) or store(df, name))
    edges = spark.createDataFrame([(5, 1), (1, 5), (9, 1), (8, 2), (4, 4)], "a long, b long")
    got = connected_components(edges)
    assert len(names) == 2
    assert sorted((r.node, r.root) for r in got.collect()) == [(1, 1), (2, 2), (5, 1), (8, 2), (9, 1)]
    assert connected_components(edges.where("a = b")).count() == 0


def test_one_of_each_shuffles_its_rows_once(spark):
    """The fingerprinted rows are aggregated by fingerprint and not joined again."""
    docs = spark.createDataFrame([(3, "a b c d e f"), (None, "a b c d e f"), (7, "zz yy xx ww vv"), (3, "a  b c d e f")], "doc_id long, text string")
    kept = S.one_of_each(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # with the roots, and with the documents
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7]
