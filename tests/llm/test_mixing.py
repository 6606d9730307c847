"""Soft-membership mixing: posteriors against plain counting, rates against a plain solver's optimum."""
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import mixing as M


def test_rates_meet_reachable_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([.5, .5, .5], 300)
    n = rng.integers(0, 900, 300)
    rows = [(int(k), 1 + i % 2, *map(float, q)) for i, (k, q) in enumerate(zip(n, p, strict=True))]
    soft = spark.createDataFrame(rows, "n_tokens long, rows long, p0 double, p1 double, p2 double")
    got = M.fit_rates(soft, [.6, .3, .1], store_every=7).collect()
    assert len(got) == 300 and all(r.rate >= 0 for r in got) and all(r.rate == 1 for r in got if not r.n_tokens)
    size = np.array([r.n_tokens * r.rows for r in got])
    sums = [sum(s * r.rate * r[f"p{i}"] for s, r in zip(size, got, strict=True)) for i in range(3)]
    assert np.allclose(sums, size.sum() * np.array([.6, .3, .1]), rtol=2e-3)


def test_unreachable_targets_are_met_as_nearly_as_least_squares(spark):
    rows = [(10, 1, .5, .5), (30, 1, .5, .5), (0, 1, .9, .1)]
    soft = spark.createDataFrame(rows, "n_tokens long, rows long, p0 double, p1 double")
    got = M.fit_rates(soft, [.9, .1], max_steps=200).collect()
    # sums are equal whatever the rates: s minimises (s - 36)^2 / 36 + (s - 4)^2 / 4, at 7.2
    assert abs(sum(r.rate * r.n_tokens * r.p0 for r in got) - 7.2) < .05


def test_posteriors_match_plain_naive_bayes(spark):
    rng = random.Random(3)
    text = lambda d: " ".join(rng.choice({"x": ["aa", "bb", "cc"], "y": ["bb", "dd", "$$"]}[d]) for _ in range(9))
    rows = [(i, text("xy"[i % 2])) for i in range(80)]
    labels = [(i, "xy"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, domain string, bucket int")
    marks = spark.createDataFrame(labels, "doc_id long, domain string")
    got = {r.doc_id: r for r in M.posteriors(docs, marks, ["x", "y"]).collect()}
    tunes = {r.doc_id for r in marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    cut = lambda t: re.findall(r"[a-z]+|\d+|[^\w\s]+", t)
    count = {d: {} for d in "xy"}
    for i, d in labels:
        for w in cut(rows[i][1]) if i not in tunes else []:
            count[d][w] = count[d].get(w, 0) + 1
    total = {d: sum(count[d].values()) for d in "xy"}
    known = set(count["x"]) | set(count["y"])

    def posterior(t, temperature):
        logs = []
        for d in "xy":
            weights = [math.log((count[d].get(w, 0) + .5) / (total[d] + .5 * M.BUCKETS)) - sum(
                math.log((count[e].get(w, 0) + .5) / (total[e] + .5 * M.BUCKETS)) for e in "xy") / 2 for w in cut(t) if w in known]
            logs.append(math.log(.5) + temperature * sum(weights) / max(len(cut(t)), 1))
        top = max(logs)
        return math.exp(logs[0] - top) / sum(math.exp(x - top) for x in logs)
    assert any(all(abs(got[i].p0 - posterior(t, k)) < 1e-9 for i, t in rows) for k in M.TEMPERATURES)
    assert all((got[i].p0 > .5) == (i % 2 == 0) for i in range(60, 80))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "  ")], "doc_id long, text string")
    marks = spark.createDataFrame([(3, "x"), (3, "y"), (1, None), (9, "x")], "doc_id long, domain string")
    got = M.mix(docs, marks, {"x": .5, "y": .5}).collect()
    assert sorted((r.doc_id, r.rows, r.n_tokens) for r in got if r.doc_id) == [(1, 1, 0), (2, 1, 0), (3, 2, 2), (4, 1, 0)]
    assert all(r.rate == 1 and r.copies == 1 for r in got if not r.n_tokens)
    assert M.mix(docs.limit(0), marks, {"x": .5, "y": .5}).count() == 0
    assert M.mix(docs, marks.limit(0), {"x": 1, "y": 1}).count() == 5


def test_temperatures_do_not_lengthen_the_plan(spark, monkeypatch):
    held = spark.createDataFrame([("a", 1.0, -1.0), ("b", -0.5, 0.5), ("b", 0.0, 0.0)], "domain string, s0 double, s1 double")
    prior = {"a": 0.4, "b": 0.6}
    plan = lambda: len(M._losses(held, prior)._jdf.queryExecution().optimizedPlan().toString())
    got = {r.t: r.loss for r in M._losses(held, prior).collect()}
    for t in M.TEMPERATURES:
        want = 0.0
        for r in held.collect():
            power = [math.exp(math.log(p) + t * s) for p, s in zip(prior.values(), (r.s0, r.s1), strict=True)]
            want -= math.log(max(power[list(prior).index(r.domain)] / sum(power), 1e-12))
        assert got[t] == pytest.approx(want)
    before = plan()
    monkeypatch.setattr(M, "TEMPERATURES", tuple(range(1, 100)))
    assert plan() < before + 1000


def test_a_step_is_one_job(spark):
    """The sums of a step are added up as the rows are gone through: no shuffle and no second job."""
    rows = spark.range(0, 100, 1, 4).selectExpr("id as n_tokens", "cast(id as double) as p0", "cast(null as double) as p1")
    spark.sparkContext.setJobGroup("mixing-sums", "")
    try:
        got = M._sums(rows, [F.col("n_tokens") * F.col("p0"), F.lit(2), F.col("p1")])
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixing-sums")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(got[:2]) == [sum(i * i for i in range(100)), 200.0] and math.isnan(got[2])
