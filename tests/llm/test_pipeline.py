"""The pipeline's stages against its rules on small data, and its registration."""
import random

import __spark_entry__ as E
import corpus_pipeline as P
from logweave.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def test_registered():
    names = set(E.queries())
    assert {"pipeline", *QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, SF_SMALL), "test-pipeline")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    last = P.STAGES[-1][1](spark, docs, SF_SMALL)
    assert last.count() == before and last.where("rate < 0").count() == 0


def test_line_stage_keeps_documents_without_repeated_lines(spark):
    rows = [(1, "alpha beta\ngamma delta", "en", 22), (2, "alpha beta\nnew words", "en", 20), (3, "gamma delta", "en", 11), (4, "", "en", 0),
            (5, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    got = sorted((r.doc_id, r.text, r.n_chars) for r in P.lines(spark, docs, "").collect() if r.text is not None)
    assert got == [(1, "alpha beta\ngamma delta", 22), (2, "new words", 9), (4, "", 0)]


def test_one_document_of_edited_near_copies_is_left(spark):
    rng = random.Random(9)
    first = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(4)]
    texts = ["\n".join(" ".join(line) for line in first)]
    for copy in range(1, 4):  # the first two lines are equal, the others have two or three edits
        lines = [list(line) for line in first]
        for line in lines[2:]:
            for at in rng.sample(range(60), rng.choice([2, 3])):
                line[at] = f"edit{copy}"
        texts.append("\n".join(" ".join(line) for line in lines))
    docs = spark.createDataFrame([(i, t, "en", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars int")
    left = P.near_copies(spark, P.stored(P.lines(spark, docs, ""), "test-near-copies"), "")
    assert [r.doc_id for r in left.collect()] == [0]


CLASHING = "removed_lines int, fp long, score double, text_hash long, hash long, root string, kept boolean, rows int, rate double"


def odd_documents(spark):
    """Null ids and texts, repeated rows, empty texts, and columns named like those that the operators make."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = [(10_000_000 + i, text(80), "en", "s", 9) for i in range(12)] + [(None, text(60), None, None, None), (None, None, None, "s", None),
                                                                           (10_000_050, None, "en", "s", 0), (10_000_051, "", "en", "s", 0)]
    rows += rows[:2]
    extra = lambda r: (r[0] % 100 if r[0] else 7, 5, .5, 6, 7, "r", True, 8, 2.0)
    columns = "doc_id long, text string, lang string, source string, n_chars int, " + CLASHING
    return spark.createDataFrame([(*r, *extra(r)) for r in rows], columns)


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    docs = odd_documents(spark)
    known = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r.doc_id for r in rows} <= set(known), name
        for r in rows:  # no stage writes its own values into the documents' columns
            assert [r[c] for c in docs.columns[5:]] == [known[r.doc_id][c] for c in docs.columns[5:]], name
        if name == "line_dedup":
            assert {10_000_050, 10_000_051} <= {r.doc_id for r in rows}
    last = P.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in last} == set(known) and all(r.rate >= 0 for r in last)


def test_stages_of_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0, name


def test_documents_with_a_benchmark_item_go(spark):
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect() if len(r.text.split()) > 20][:3]
    assert items
    rng = random.Random(4)
    own = lambda: " ".join(f"word{rng.randrange(900)}" for _ in range(60))
    rows = [(k, f"{own()} {t.upper() if k == 1 else t} {own()}") for k, t in enumerate(items)] + [(10 + k, own()) for k in range(5)] + [(20, None), (None, own())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = P.benchmark_leaks(spark, docs, SF_SMALL)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([*range(10, 15), 20, None], key=str)
