"""Exact top-k search against brute force."""
import math
import random

import numpy as np
import pytest

from logweave.llm import topk_search as K


def plain_top(rows, k, every):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        own = min((v for i, v in rows if i == q and v is not None and all(x is not None and math.isfinite(x) for x in v)))
        own = [math.floor(64 * float(np.float32(x))) for x in own]
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in ok if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block_rows,summary_rows", [(256, 512), (4, 3)])
def test_matches_brute_force(spark, block_rows, summary_rows):
    rng = random.Random(9)
    same = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(90)] + [(i, list(same)) for i in range(90, 150)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (220, [float("inf"), 0.0]), (240, []), (260, [1.0, -1.0]),
             (None, same), (40, list(same)), (7, rows[7][1]), (7, rows[7][1]), (280, [1e6] * 6), (281, [-1e6] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = K.top_k(df, k=20, every=20, block_rows=block_rows, pack_rows=3, summary_rows=summary_rows)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == plain_top(rows, 20, 20)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.top_k(df).collect()] == [(0, 1, 1, 64 * 128)]
    assert K.top_k(df.limit(0)).count() == 0 and K.top_k(df.where("vec_id = 1")).count() == 0


def test_products_beyond_doubles():
    a, b = np.array([[2.0 ** 30, 1.0]]), np.array([[2.0 ** 31, 3.0], [2.0 ** 40, 0.0]])
    assert K.products(a, b).tolist() == [[2 ** 61 + 3, 2 ** 63 - 1]]
