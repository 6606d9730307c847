"""Operator 11 against plain Python: regular expression, zlib, sorting."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import importance_sampling as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text, longest, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def some_text(rng):
    return "".join(rng.choice(["Öl", "tin", "TIN", "a9", "日本", " ", "  ", "\n", ".", "\x00", " ", "-", "x" * rng.randrange(40), "É"])
                   for _ in range(rng.randrange(60)))


def plain(rows, target, percent, least_words, longest, buckets, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in buckets_of(text, longest, buckets):
            s[b] += 1
    for text in target:
        for b in buckets_of(text, longest, buckets):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        found = buckets_of(text, longest, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words(text)), len(found), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, row in enumerate(drawn[:len(drawn) * percent // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_crcs_by_length():
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(0, 30, 500), [S.LONG, S.LONG + 1, 0, 9000]])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = rng.integers(0, 256, offsets[-1], dtype=np.uint8)
    found = S.crc32_by_length(data, offsets)
    assert found.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]


@pytest.mark.parametrize("chunk", [20, S.CHUNK_BYTES])
def test_features_of_any_text(spark, monkeypatch, chunk):
    import pyarrow as pa
    rng = random.Random(8)
    texts = ["", None, *(some_text(rng) for _ in range(200)), "", "x" * 9000, "end"]
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    got, n = [[] for _ in texts], [0] * len(texts)
    for first, end, row, bucket, counts in S._batches(pa.array(texts, pa.string()), 3, 997):
        for r, b in zip(row, bucket):
            got[first + r].append(int(b))
        n[first:end] = counts.tolist()
    assert n == [len(words(t)) for t in texts]
    assert [sorted(g) for g in got] == [sorted(buckets_of(t, 3, 997)) for t in texts]


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_equals_plain_python(spark, longest):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ähre", "日本", "9"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(300)]
    rows += [(None, "tin " * 30), (7, None), (8, ""), (9, "..."), (10, "w1 " * 25), (10, "w1 " * 25), (11, "日本" * 500 + " w2" * 20)]
    target = [" ".join(rng.choices(vocabulary[:9], k=30)) for _ in range(10)] + [None, ""]
    docs = spark.createDataFrame([(*r, 5, 1.5, "x") for r in rows], "doc_id long, text string, score long, rank double, bucket string")
    found = S.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, n int"), 30, 20, longest, 500)
    assert rows_of(found) == plain(rows, target, 30, 20, longest, 500)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "tin " * 30), (2, "oil")], "doc_id long, text string")
    none = docs.limit(0)
    assert S.resample(none, docs).count() == 0
    assert rows_of(S.resample(docs, none, 100)) == plain([(1, "tin " * 30), (2, "oil")], [], 100, 20, 1, 10000)
    assert [r["rank"] for r in S.resample(docs, none, 10).collect()] == [None, None]


def test_ranks_of_a_hot_score_come_from_many_ranges(spark):
    """One score holds nearly all rows; ids settle it, over several ranges."""
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, 9).otherwise(4).cast("long").alias("score"))
    found = S.ranked(rows.repartition(7), [F.col("score").desc(), F.col("doc_id").asc()], "rank").collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r["rank"])] == sorted(range(5000), key=lambda i: (i % 50 > 0, i))
    assert {r["rank"] for r in found} == set(range(1, 5001))


def test_ranks_are_counted_once(spark):
    """The ranges' places are a literal, so that each use of the ranks does not count, sort and broadcast them again."""
    rows = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)] + [(None, "y")], "a long, b string")
    got = S.ranked(rows, [F.col("a").desc()], "rank")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.a for r in sorted(got.collect(), key=lambda r: r["rank"])] == [*range(100, -1, -1), None]
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 103))
    assert S.ranked(rows.where("false"), [F.col("a").asc()], "rank").count() == 0
