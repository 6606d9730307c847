"""Stored entries and indexes: page directory, skipping index, class index by repository, named files, file ends, JSON maps."""
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.ordered import running_total
from logweave.operators import codeindex as CI
from logweave.operators.filters import Criteria, filter_entries, page
from logweave.operators.parse import detect_format, parse_entries
from logweave.sources import ends
from logweave.sources.files import discover_logs, file_metadata
from logweave.sources.lines import read_lines
from logweave.sources.named import write_named_files
from logweave.sources.sinks import drop_index, open_index, page_at, read_entries, write_directory, write_entries, write_index
from logweave.sources.textindex import files_without, literal_grams, search_stored, write_text_index
from tests.conftest import lines_df
from tests.logmodel import Entry, some_log


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Entries of several logs, stored in many files."""
    rng = random.Random(30)
    logs = {f"log{k}.txt": "\n".join(some_log(rng, n)[0]) + "\n" for k, n in enumerate((3, 200, 1, 120))}
    logs["rare.txt"] = Entry(9, "WARN", "Lamp", "wick trimmed by Kowalski-77").header("tid") + "\n"
    path = str(tmp_path_factory.mktemp("stored") / "entries")
    write_entries(parse_entries(lines_df(spark, logs)), path, max_records_per_file=40)
    return path


def files_of(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


# ----------------------------------------------------------------- pages

@pytest.mark.parametrize("page_lines", [1, 7, 1 << 16])
def test_deep_pages_equal_offsets(spark, stored, tmp_path, page_lines):
    entries = read_entries(spark, stored)
    write_directory(entries, str(tmp_path / "pages"), page_lines)
    pages = spark.read.parquet(str(tmp_path / "pages"))
    total = entries.count()
    assert total == pages.agg(F.sum("n")).first()[0] == 325
    for offset, limit in ((0, 5), (2, 1), (199, 30), (total - 3, 10), (total, 5), (50, 0)):
        want = [(r.file_path, r.line_number) for r in page(entries, offset, limit).collect()]
        got = page_at(entries, pages, offset, limit)
        assert [(r.file_path, r.line_number) for r in got.collect()] == want


def test_a_deep_page_reads_its_stretch(spark, stored, tmp_path):
    entries = read_entries(spark, stored)
    write_directory(entries, str(tmp_path / "pages"), 16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = page_at(entries, spark.read.parquet(str(tmp_path / "pages")), 150, 10)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100")
    assert "offset" not in plan.lower() and "GreaterThanOrEqual(line_number" in plan and "EqualTo(file_path" in plan


def test_running_total_over_ranges(spark):
    rows = [(random.Random(k).randrange(50), k, k % 5) for k in range(400)]
    got = running_total(spark.createDataFrame(rows, "a int, b int, n int").repartition(6), ["a", "b"], "n", "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.a, r.b)):
        assert r.before == total
        total += r.n


# ----------------------------------------------------------------- skipping index

def test_search_reads_only_files_that_may_hold_the_literal(spark, stored, tmp_path):
    index = str(tmp_path / "grams")
    write_text_index(spark, stored, index)
    entries, n = read_entries(spark, stored), len(files_of(stored))
    assert n > 8
    key = lambda df: sorted((r.file_path, r.line_number) for r in df.collect())
    for text, sensitive in (("KOWALSKI-77", False), ("Kowalski", True), ("kowalski", True), ("load 7", False), ("TONS", False), ("zzzz", False),
                            ("a", False), ("m 12", False), ("wörld.Boje", False), ("WÖRLD", True), ("", False)):
        c = Criteria(search=text, case_sensitive=sensitive)
        hits, read = search_stored(spark, stored, index, c)
        assert key(hits) == key(filter_entries(entries, c)) and read.files == n
        if text.lower().startswith("kowalski"):
            assert read.skipped == n - 1
        if text == "zzzz":
            assert read.skipped == n and hits.columns == entries.columns
        if not literal_grams(text):
            assert read.skipped == 0
    hits, read = search_stored(spark, stored, index, Criteria(search="kowal.*77", regex=True))
    assert len(key(hits)) == 1 and read.skipped == 0
    hits, _ = search_stored(spark, stored, index, Criteria(search="kowalski", levels=["info"]))
    assert key(hits) == []


def test_files_written_after_the_index_are_read(spark, tmp_path):
    path, index = str(tmp_path / "e"), str(tmp_path / "grams")
    log = lambda name, text: parse_entries(lines_df(spark, {name: Entry(4, "INFO", "Lamp", text).header("tid") + "\n"}))
    write_entries(log("a", "harbour"), path)
    write_text_index(spark, path, index)
    write_entries(log("b", "lighthouse"), path, mode="append")
    hits, read = search_stored(spark, path, index, Criteria(search="lighthouse"))
    assert [r.file_path for r in hits.collect()] == ["b"] and (read.files, read.skipped) == (2, 1)
    assert files_without(spark, index, "harbour").count() == 0


# ----------------------------------------------------------------- class index

def sources(spark, label, order, classes):
    return spark.createDataFrame([(label, label, order, f"{label}/{c}.java", f"package ferry.deck;\n// {c} {label}\n") for c in classes],
                                 "repo_label string, repo_path string, repo_order int, source_path string, text string")


def test_reindexing_one_repository_leaves_the_others(spark, tmp_path):
    path, table = str(tmp_path / "index"), "ferry_index"
    both = CI.class_index(sources(spark, "north", 0, ["Ramp", "Buoy"]).unionByName(sources(spark, "south", 1, ["Ramp", "Tide"])))
    write_index(both, table, path, buckets=4)
    kept = {f: os.path.getmtime(f) for f in files_of(path) if "repo_label=south" in f}
    assert kept
    write_index(CI.class_index(sources(spark, "north", 0, ["Winch"])), table, path)
    now = {f: os.path.getmtime(f) for f in files_of(path) if "repo_label=south" in f}
    assert now == kept
    names = lambda: sorted((r.repo_label, r.fqcn) for r in spark.table(table).collect())
    assert names() == [("north", "ferry.deck.Winch"), ("south", "ferry.deck.Ramp"), ("south", "ferry.deck.Tide")]
    spark.sql(f"DROP TABLE {table}")  # another session: the files are found again
    assert sorted((r.repo_label, r.fqcn) for r in open_index(spark, table, path, 4).collect()) == names()
    drop_index(spark, table, "north")
    assert names() == [("south", "ferry.deck.Ramp"), ("south", "ferry.deck.Tide")]
    spark.sql(f"DROP TABLE {table}")


def test_look_up_does_not_shuffle_the_index(spark, tmp_path):
    path, table = str(tmp_path / "index"), "wide_index"
    rows = spark.range(5000).select(
        F.lit("north").alias("repo_label"), F.lit("north").alias("repo_path"), F.lit(0).alias("repo_order"),
        F.concat(F.lit("ferry.C"), F.col("id").cast("string")).alias("fqcn"), F.lit("x.java").alias("source_path"), F.lit(1).cast("long").alias("line_count"))
    write_index(rows, table, path, buckets=8)
    asked = spark.range(3000).select(F.lit("ferry").alias("package"), F.concat(F.lit("C"), F.col("id").cast("string"), F.lit("$1")).alias("class_name"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = CI.lookup_class(asked, open_index(spark, table, path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    index_side = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert len(index_side) == 1 and "Bucketed: true" in index_side[0]
    # between the scan and the join: no exchange
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if "FileScan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    k = at
    while "Join" not in lines[k]:
        assert "Exchange" not in lines[k], lines[k]
        k = max(j for j in range(k) if depth(lines[j]) < depth(lines[k]))
    spark.sql(f"DROP TABLE {table}")


# ----------------------------------------------------------------- named files, JSON maps

def test_named_files(spark, tmp_path):
    rows = [("a/b c/+x.java", "class A {}\n"), ("top.json", None), ("a/é.txt", "ü\r\n")]
    write_named_files(spark.createDataFrame(rows, "path string, text string").repartition(3), str(tmp_path))
    write_named_files(spark.createDataFrame(rows[:1], "path string, text string"), str(tmp_path))  # again
    found = {os.path.relpath(os.path.join(d, f), tmp_path): open(os.path.join(d, f), newline="").read() for d, _, fs in os.walk(tmp_path) for f in fs}
    assert found == {p: t or "" for p, t in rows}
    with pytest.raises(Exception, match="not below"):
        write_named_files(spark.createDataFrame([("../x", "y")], "path string, text string"), str(tmp_path))


def test_json_maps_of_many_objects(spark, tmp_path):
    pairs = spark.createDataFrame([(f"k{i}", f"v{i}") for i in range(95)] + [("_comment", "no")], "key string, value string")
    write_named_files(CI.json_objects(pairs, keys_each=10), str(tmp_path))
    assert len(os.listdir(tmp_path)) > 5
    (tmp_path / "zz.json").write_text('{"k3": "late", "new": "n"}')  # of a key in two objects the first file's counts
    got = {r["p"]: r["r"] for r in CI.load_map_json(spark, str(tmp_path), "p", "r").collect()}
    assert got == {f"k{i}": f"v{i}" for i in range(95)} | {"new": "n"}


# ----------------------------------------------------------------- file ends

@pytest.mark.parametrize("block", [1, 2, 7, 1 << 14])
def test_ends_are_those_of_a_whole_read(block):
    rng = random.Random(block)
    for _ in range(150):
        data = b"".join(rng.choice([b"a", b"bc ", b"\n", b"\r", b"\r\n", b"", "é".encode()]) for _ in range(rng.randrange(40)))
        if rng.random() < .2:
            data = b"\xef\xbb\xbf" + data
        lines = ends.BREAK.split(data.removeprefix(b"\xef\xbb\xbf"))
        lines = lines[:-1] if lines[-1] == b"" else lines
        for wanted in (0, 1, 3, 100):
            assert ends.head_lines(io.BytesIO(data), len(data), wanted, block)[0] == lines[:wanted]
            assert ends.tail_lines(io.BytesIO(data), len(data), wanted, block)[0] == lines[::-1][:wanted]


def test_formats_and_times_from_ends_equal_a_whole_read(spark, tmp_path):
    rng = random.Random(5)
    for k, (n, shape) in enumerate(((0, None), (1, "basic"), (40, "bracket"), (6000, "tid"), (30, None))):
        (tmp_path / f"log{k}.log").write_bytes("".join(x + "\n" for x in some_log(rng, n, shape)[0]).encode())
    (tmp_path / "late.log").write_bytes(b"x\n" * 12 + b"2031-07-04 10:00:00 y\n" + b"x\n" * 12)
    (tmp_path / "bad.txt").write_bytes(b"\xff 2031-07-04 10:00:00\rtail\xfe")
    (tmp_path / "none.log").write_bytes(b"")
    found = discover_logs(spark, str(tmp_path))
    lines = read_lines(spark, str(tmp_path))
    row = lambda r: (r["file_path"], r["file_type"], r["size_bytes"], r["first_timestamp"], r["last_timestamp"])
    assert sorted(map(row, ends.file_times(found).collect())) == sorted(map(row, file_metadata(lines, found).collect()))
    whole = {r.file_path: r.format for r in detect_format(lines).collect()}
    got = {r.file_path: r.format for r in ends.detect_file_formats(found).collect()}
    assert {p: f for p, f in got.items() if p in whole} == whole and set(got.values()) == {"tid", "bracket", "basic"}
    read = {r.file_path: r.n for r in ends.file_ends(found).groupBy("file_path").agg(F.max("bytes_read").alias("n")).collect()}
    big = max(found.collect(), key=lambda r: r.size_bytes)
    assert big.size_bytes > 300_000 and read[big.file_path] <= 4 * ends.BLOCK



def test_materialize_is_one_job(spark):
    """The schema of a stored table is known, so no job reads it from the files."""
    from pyspark.sql import functions as F
    from logweave.sources.sinks import materialize
    rows = spark.range(0, 10, 1, 2).select("id", F.lit(None).cast("string").alias("t"), F.array(F.struct(F.lit(1).alias("x"))).alias("a"))
    spark.sparkContext.setJobGroup("one-job", "")
    try:
        got = materialize(rows, "one-job")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-job")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.dtypes == rows.dtypes and all(f.nullable for f in got.schema)
    assert sorted(r.id for r in got.collect()) == list(range(10))
    assert materialize(rows.where("false"), "one-job").count() == 0
