"""What keeps the file queries in proportion to their input: named lines, folders a task, sources read from a listing, one
bitmap a file, dealt out texts."""
import os
import re

import pytest
from pyspark.sql import functions as F

from logweave.operators import codeindex as CI
from logweave.operators.resolve import _texts, source_window
from logweave.plans import catalog
from logweave.sources import listing, render, texts, textindex
from logweave.sources.named import write_named_lines
from logweave.sources.paths import scanned_path
from logweave.sources.sinks import write_entries
from logweave.operators.parse import parse_entries
from tests.conftest import lines_df


def texts_below(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8", newline="").read() for d, _, fs in os.walk(root) for f in fs}


def test_lines_become_named_files(spark, tmp_path):
    root = str(tmp_path / "a b+c")
    want = {"x/one.log": ["äß €", None, "", "last"], "x/two.log": ["only"], "long.log": [f"line {k}" for k in range(25_000)]}
    rows = [(path, k, line) for path, lines in want.items() for k, line in enumerate(lines, 1)]
    write_named_lines(spark.createDataFrame(rows[::-1], "path string, line_number long, value string"), root)
    assert texts_below(root) == {path: "".join(f"{line or ''}\n" for line in lines) for path, lines in want.items()}
    with pytest.raises(Exception, match="is not below"):
        write_named_lines(spark.createDataFrame([("../out.log", 1, "x")], "path string, line_number long, value string"), root)


def test_logs_share_few_folders(spark, tmp_path):
    events = spark.range(600).select(F.col("id").alias("event_id"), F.when(F.col("id") % 300 > 0, F.col("id") % 300).alias("user_id"),
                                     F.when(F.col("id") % 7 > 0, F.lit("view")).alias("event_type"),
                                     F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = texts_below(catalog._write_logs(spark, str(tmp_path)))
    assert len(found) == 301 and len({os.path.dirname(f) for f in found}) <= catalog.LOG_FOLDERS
    lines = catalog.r1_lines(spark, str(tmp_path)).orderBy("file_path", "line_number").collect()
    want = {}
    for r in lines:
        name = f"log={r.file_path or catalog.NO_LOG}.txt"
        want[name] = want.get(name, "") + (r.value or "") + "\n"
    assert {os.path.basename(f): text for f, text in found.items()} == want


def test_a_task_lists_many_folders(spark, tmp_path, monkeypatch):
    for k in range(200):
        (tmp_path / "logs" / f"d{k}").mkdir(parents=True)
        (tmp_path / "logs" / f"d{k}" / "a.log").write_text("x")
    tasks, store = [], listing.materialize
    monkeypatch.setattr(listing, "materialize", lambda df, *a, **k: tasks.append(df.rdd.getNumPartitions()) or store(df, *a, **k))
    assert listing.list_files(spark, str(tmp_path / "logs")).count() == 200
    assert tasks == [1, 2]


def test_folders_a_task_grow_with_the_tree(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [listing.tasks_for(spark, n) for n in (0, 1, 128, 129)] == [0, 1, 1, 2]
    assert listing.tasks_for(spark, 100_000) <= listing.TASKS_A_CORE * cores + 1
    assert listing.tasks_for(spark, 1 << 30) == (1 << 30) // listing.MOST_A_TASK


def test_trees_of_one_listing_are_kept_apart(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("1")
    (tmp_path / "a" / "b" / "y.txt").write_text("")
    found = listing.list_trees(spark, [str(tmp_path / "a"), f"file://{tmp_path}/a/b/", str(tmp_path / "a")]).collect()
    x, y = f"file://{tmp_path}/a/x.txt", f"file://{tmp_path}/a/b/y.txt"
    assert sorted((r.tree, r.file_path, r.size_bytes) for r in found) == [(0, y, 0), (0, x, 1), (1, y, 0), (2, y, 0), (2, x, 1)]


ODD_SOURCES = {"src/A.java": b"package a.b;\nclass A {}\n", "a b+c/%41.java": b"\xef\xbb\xbfpackage a;\r\n", "bad.java": b"x\xff\xfe\x00y",
               "none.java": b"", "_no.java": b"x", ".no.java": b"x", "_x=1/K.java": b"k", "_x=1.java": b"k", ".git/G.java": b"x",
               "_no/N.java": b"x", "_metadata/M.java": b"m", "_metadata.java": b"x", "note.java.txt": b"x", "B.JAVA": b"x", "X.java/é.java": b"e"}


def test_sources_are_those_of_sparks_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "BATCH_BYTES", 20)
    one, two = str(tmp_path / "re po+1"), str(tmp_path / "two")
    for root in (one, two):
        for name, text in ODD_SOURCES.items():
            os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
            with open(os.path.join(root, name), "wb") as f:
                f.write(text)
    os.mkdir(empty := str(tmp_path / "empty"))
    repos = [("one", one), ("two", f"file:{two}/"), ("again", one), ("inner", f"{two}/src"), ("empty", empty)]
    want = []
    for order, (label, root) in enumerate(repos):
        read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.java")
        want += [(label, root, order, *r) for r in read.select(scanned_path(), F.col("value").cast("binary")).collect()]
    got = CI.read_sources(spark, repos)
    assert got.dtypes == [("repo_label", "string"), ("repo_path", "string"), ("repo_order", "int"), ("source_path", "string"), ("text", "string")]
    assert "FileScan text" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.withColumn("text", F.col("text").cast("binary")).collect()) == sorted(want) and len(want) == 3 * 7 + 1
    pattern = CI.read_sources(spark, [("one", one), ("two", str(tmp_path / "t[w]o"))])  # read by Spark's reader alone
    assert [r["count"] for r in pattern.groupBy("repo_order").count().orderBy("repo_order").collect()] == [7, 7]
    assert not CI._opened(spark, "viewfs://c/repos") and CI.read_sources(spark, [("none", empty)]).collect() == []
    with pytest.raises(Exception, match="(?i)missing|not.found|no such"):
        CI.read_sources(spark, [("none", str(tmp_path / "missing"))]).collect()


def test_a_task_reads_many_sources(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"m{k}").mkdir()
        (tmp_path / f"m{k}" / f"P{k}.java").write_text(f"package p;\n// {k}\n")
    src = CI.read_sources(spark, [("one", str(tmp_path))])
    assert src.rdd.getNumPartitions() == 3
    assert sorted(r.fqcn for r in CI.class_index(src).collect()) == sorted(f"p.P{k}" for k in range(300))


def test_parts_are_dealt_out_before_their_sources_are_written(spark, tmp_path, monkeypatch):
    part = spark.range(180).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("KIND "), F.col("id") % 3)).alias("p_type"))
    part = part.unionAll(part.where("p_partkey < 5"))  # some of them twice
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    seen, store = [], catalog.write_named_files
    monkeypatch.setattr(catalog, "write_named_files", lambda df, root: seen.append((df.rdd.getNumPartitions(), root)) or store(df, root))
    got = catalog.q_files_class_index(spark, str(tmp_path)).collect()
    ((tasks, root),) = seen
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = render.part_sources(spark.read.parquet(str(tmp_path / "part.parquet"))).distinct()
    want = {r.source_path + end: r.text or "" for r in src.collect() for end in ("", ".txt")}
    assert texts_below(root) == want
    index = CI.class_index(src.where("text IS NOT NULL"))
    assert sorted(map(tuple, got)) == sorted((r.repo_label, r.repo_order, r.fqcn, r.source_path, r.line_count) for r in index.collect())


def test_bitmaps_are_not_shuffled_in_parts(spark, tmp_path):
    logs = {f"log{k}.txt": "".join(f"[2024-01-01 10:00:00,000]  INFO {{a.B}} - word{k} other{n}\n" for n in range(20)) for k in range(5)}
    path = str(tmp_path / "entries")
    write_entries(parse_entries(lines_df(spark, logs)), path, max_records_per_file=10)
    bits = textindex.file_bits(spark.read.parquet(path))
    plan = bits._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and not re.search(r"hashpartitioning\(\w+#\d+L?, bucket", plan)
    files = sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs)
    assert bits.where("bucket = -1").select("file").distinct().count() == files >= 10
    assert bits.groupBy("file", "bucket").count().where("count > 1").count() == 0


def test_texts_are_dealt_out_whatever_their_size(spark):
    rows = [("a", 1, "later"), ("a", 0, "x\ny"), ("a", 0, "x\nz"), ("b", 3, None), ("b", 3, "p"), ("c", 0, "q")]
    sources = spark.createDataFrame(rows, "source_path string, repo_order int, text string")
    kept = _texts(sources)
    assert kept.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, kept.collect())) == [("a", "x\ny"), ("b", None), ("c", "q")]
    assert sorted(map(tuple, _texts(sources.drop("repo_order")).collect())) == [("a", "later"), ("b", "p"), ("c", "q")]
    asked = spark.createDataFrame([("a", 2), ("c", None)], "source_path string, line int")
    assert sorted((r.source_path, r.content) for r in source_window(asked, sources).collect()) == [("a", "x\ny"), ("c", "q")]
