"""Which lines are compared with each other, and the form in which they are."""
import random
import re

from pyspark.sql import functions as F

from logweave.llm import line_dedup as L
from tests.llm.test_line_dedup_whole import edited, removed


def test_lines_that_share_only_a_passage_never_meet(spark):
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = some(60)
    lines = [some(30) + passage + some(30) for _ in range(80)]
    lines += [edited(lines[k], 4, rng) for k in (3, 40)]
    texts = spark.createDataFrame(list(enumerate(map(" ".join, lines))), "id long, norm string").select(
        "id", F.size(F.split("norm", " ")).cast("long").alias("units"), L._code(F.split("norm", " "), 1).alias("code"))
    none = spark.createDataFrame([], "id long")
    pairs = L.rare_pairs(texts, none).distinct().collect()
    assert {(80, 3), (81, 40)} <= {(r.id, r.other) for r in pairs} and len(pairs) < 10  # of 3,321
    assert not [r for r in L.rare_pairs(texts, spark.range(80, 82)).collect() if r.id >= 80]
    want = dict.fromkeys(range(82), 0) | {80: 1, 81: 1}
    assert removed(spark, [" ".join(x) for x in lines], least_bytes=12, grown=True) == want


def test_all_lines_of_a_text_are_normalised_at_once(spark):
    rng = random.Random(9)
    texts = ["", " ", "\n", "a", None] + ["".join(rng.choices(" \t\r\naBÉß.", k=rng.randrange(1, 40))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(F.split(L.normalised(F.col("text")), "\n").alias("lines")).collect()
    for text, row in zip(texts, got):
        if text is None:
            assert row.lines is None
        else:
            assert row.lines == [re.sub(" +", " ", re.sub("[\t\r]", " ", line)).strip(" ").lower() for line in text.split("\n")]
