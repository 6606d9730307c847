"""Operator 12: balls against the full search, and whole runs against plain Python."""
import hashlib
import math

import numpy as np
import pytest

from logweave.llm import ball_codes as B


@pytest.mark.parametrize("seed", range(6))
def test_balls_find_what_the_full_search_finds(seed):
    """Small grids make ties, equal entries and points on entries; the last codes are arbitrary, even wrong."""
    rng = np.random.default_rng(seed)
    k, width = int(rng.integers(1, 30)), int(rng.integers(1, 5))
    entries = rng.integers(-4, 5, (k, width))
    points = rng.integers(-6, 7, (700, width))
    want = B.nearest(points, entries)
    for ball in (want[0], rng.integers(0, k, 700), np.zeros(700, np.int64)):
        index, square, _ = B.nearest_in_balls(points, entries, ball)
        assert np.array_equal(index, want[0]) and np.array_equal(square, want[1])


def test_core_points_cost_one_distance():
    rng = np.random.default_rng(1)
    entries = np.arange(16)[:, None] * 1000 + np.zeros((1, 4), np.int64)
    ball = rng.integers(0, 16, 2000)
    points = entries[ball] + rng.integers(-20, 21, (2000, 4))
    index, _, computed = B.nearest_in_balls(points, entries, ball)
    assert np.array_equal(index, ball) and computed == 2000
    assert B.nearest_in_balls(points, entries, np.roll(ball, 1))[2] > 2000


def plain(rows, parts, size, rounds, scale):
    kept = [(i, l, [math.floor(scale * x) for x in v]) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:size]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    code = lambda v: [min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        codes = [code(v) for _, _, v in kept]
        for p in range(parts):
            for i in range(len(books[p])):
                own = [cut(v, p) for (_, _, v), c in zip(kept, codes) if c[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, l, "".join(f"{n:02x}" for _, n in code(v)), sum(d for d, _ in code(v))) for i, l, v in kept]
    return sorted(((i, c, e, sum(o[3] for o in out if o[1] == l), digest) for i, l, c, e in out), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, codes int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y", 1) for i, v, l in rows], SCHEMA).repartition(3)


def got(spark, rows, *args):
    return sorted(map(tuple, B.digests(*B.compress(frame(spark, rows), *args)).collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_whole_run(spark, rounds):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)], int(rng.integers(0, 3))) for i in rng.permutation(120)]
    rows += [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [math.nan] + [0.0] * 7, 1), (203, [math.inf] * 8, 1), (204, [-math.inf] + [1.0] * 7, 0)]
    rows += [(None, [0.5] * 8, None), (5, [0.25] * 8, None), rows[3], rows[3], (300, [0.0] * 8, 2)]
    assert got(spark, rows, 4, 10, rounds, 16.0) == plain(rows, 4, 10, rounds, 16.0)


def test_fewer_rows_than_entries_and_none(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], None)]
    assert got(spark, rows, 2, 64, 2, 1.0) == plain(rows, 2, 64, 2, 1.0)
    assert got(spark, [(1, None, 1)], 2, 64, 2, 1.0) == []
    assert got(spark, [(1, [], 1), (2, [], 1)], 2, 64, 2, 1.0) == [
        (1, "0000", 0, 0, hashlib.sha256(b"").hexdigest()), (2, "0000", 0, 0, hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("rows, message", [([(1, [1.0, 2.0], 1), (2, [1.0], 1)], "components"), ([(1, [1.0] * 3, 1)], "equal parts"),
                                           ([(1, [1e20, 1.0], 1)], "2\\^28")])
def test_what_cannot_be_coded_is_named(spark, rows, message):
    with pytest.raises(Exception, match=message):
        got(spark, rows, 2, 64, 2, 1.0)
