"""S1 reader, S2 discovery, S3 metadata, S4 classification, S8 sink, streaming ingest."""
import gzip
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logweave.operators.parse import ENTRY_COLUMNS, parse_entries, parse_files
from logweave.sources.files import classify_file, discover_logs, file_metadata
from logweave.sources.lines import read_lines
from logweave.sources.sinks import materialize, read_entries, write_entries
from logweave.streaming.ingest import ingest_new_files
from tests.logmodel import Entry, some_log

QUAY = [Entry(second, level, "tide.Gauge", f"mark {second}", tenant="7")
        for second, level in ((40, "DEBUG"), (3700, "INFO"), (3702, "DEBUG"), (9000, "WARN"), (86000, "TRACE"))]
QUAY_LOG = "".join(e.header("tid") + "\n" for e in QUAY)


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _by_file(df):
    out = {}
    for r in df.collect():
        out.setdefault(os.path.basename(r.file_path), []).append((r.line_number, r.value))
    return {k: sorted(v) for k, v in out.items()}


def test_read_lines_edge_cases(spark, tmp_path):
    d = str(tmp_path)
    _write(f"{d}/crlf.log", b"a\r\nb\r\nc")
    _write(f"{d}/cr.log", b"a\rb\r")
    _write(f"{d}/bom.log", b"\xef\xbb\xbfx\ny\n")
    _write(f"{d}/bad.log", b"ok\n\xff\xfe end\n")
    _write(f"{d}/empty.log", b"")
    got = _by_file(read_lines(spark, d))
    assert got["crlf.log"] == [(1, "a"), (2, "b"), (3, "c")]
    assert got["cr.log"] == [(1, "a"), (2, "b")]
    assert got["bom.log"] == [(1, "x"), (2, "y")]
    assert got["bad.log"][1][1].endswith(" end") and "�" in got["bad.log"][1][1]
    assert "empty.log" not in got


def test_uris():
    from logweave.sources.listing import split_uri
    assert [split_uri(u) for u in ("/a/b", "file:///a", "file:/a", "hdfs://h:8020/x/y", "s3a://bucket/k", "s3a://bucket", "a/b:c")] == [
        ("file://", "/a/b"), ("file://", "/a"), ("file://", "/a"), ("hdfs://h:8020", "/x/y"), ("s3a://bucket", "/k"), ("s3a://bucket", ""),
        ("file://", "a/b:c")]


def test_read_lines_many_splits(spark, tmp_path):
    text = "".join(f"2024-01-01 00:00:00,{i % 1000:03d} INFO [a.B] - m{i}\n  cont {i}\n" for i in range(3000))
    p = str(tmp_path / "big.log")
    _write(p, text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, p)
        assert lines.rdd.getNumPartitions() > 10
        got = _by_file(lines)["big.log"]
        assert got == [(i + 1, v) for i, v in enumerate(text.splitlines())]
        e = parse_entries(lines)
        assert e.count() == 3000
        assert e.where(F.col("message") != F.concat(F.lit("m"), ((F.col("line_number") - 1) / 2).cast("long").cast("string"),
                                                      F.lit("\n  cont "),
                                                      ((F.col("line_number") - 1) / 2).cast("long").cast("string"))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_discover_and_skip_registered(spark, tmp_path):
    d = str(tmp_path)
    for name in ["app1.log", "app2.log", "readme.txt", "data.csv", "sub/deep/X.LOG", "app.log.1", "sub/.log"]:
        _write(f"{d}/{name}", b"x\n")
    found = discover_logs(spark, d)
    names = [os.path.basename(r.file_path) for r in found.collect()]
    assert names == sorted(names, key=lambda n: [r.file_path for r in found.collect()].index(
        [r.file_path for r in found.collect() if r.file_path.endswith(n)][0]))
    assert sorted(names) == ["X.LOG", "app1.log", "app2.log", "readme.txt"]
    again = discover_logs(spark, d, registered=found.select("file_path"))
    assert again.count() == 0


def test_classify_file(spark):
    names = ["wso2carbon.log", "wso2carbon-audit.log", "audit.log", "http_access_2024.log", "x_access_log.txt",
             "correlation.log", "something_else.log"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string")
           .select(classify_file("n")).collect()]
    assert got == ["wso2carbon", "wso2carbon", "audit", "http_access", "http_access", "correlation", "generic"]


def test_file_metadata(spark, tmp_path):
    p = str(tmp_path / "three.log")
    _write(p, QUAY_LOG.encode())
    body = "".join(f"line {i}\n" for i in range(20))
    _write(str(tmp_path / "late.log"), (body + "2024-02-02 10:00:00 x\n" + body).encode())
    meta = {os.path.basename(r.file_path): r for r in file_metadata(read_lines(spark, str(tmp_path))).collect()}
    m = meta["three.log"]
    assert (m.line_count, m.first_timestamp, m.last_timestamp) == (len(QUAY), QUAY[0].stamp[:19], QUAY[-1].stamp[:19])
    assert m.size_bytes == len(QUAY_LOG.encode())
    late = meta["late.log"]
    assert late.line_count == 41 and late.first_timestamp is None and late.last_timestamp is None


def test_sink_roundtrip_and_materialize(spark, tmp_path):
    p = str(tmp_path / "in.log")
    _write(p, QUAY_LOG.encode())
    e = parse_entries(read_lines(spark, p))
    out = str(tmp_path / "entries")
    write_entries(e, out)
    back = read_entries(spark, out)
    assert back.count() == len(QUAY) and back.select("log_date").distinct().collect()[0][0] == QUAY[0].stamp[:10]
    assert materialize(e, "t").count() == len(QUAY)


def test_ingest_new_files(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    _write(f"{src}/a.log", QUAY_LOG.encode())
    ingest_new_files(spark, src, out, checkpoint=ck)
    assert read_entries(spark, out).count() == len(QUAY)
    _write(f"{src}/b.log", QUAY_LOG.encode())
    _write(f"{src}/notes.csv", b"x\n")
    ingest_new_files(spark, src, out, checkpoint=ck)
    got = read_entries(spark, out)
    assert got.count() == 2 * len(QUAY)
    assert sorted(r[0].rpartition("-")[2] for r in got.select("batch_id").distinct().collect()) == ["0", "1"]


def _split_at(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))


@pytest.mark.parametrize("size", [512, 2048, 1 << 27])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_parse_files_equals_the_lines_path(spark, tmp_path, size, batch):
    """Files cut in many splits: headers, bodies and orphans at all edges, entries over several splits and batches."""
    rng = random.Random(17)
    for k, n in enumerate((0, 1, 40, 60)):
        _write(str(tmp_path / f"log{k}.log"), "".join(x + "\n" for x in some_log(rng, n)[0]).encode())
    one = Entry(5, "WARN", "Lamp", "long")
    _write(str(tmp_path / "tall.log"), ("\n".join([one.header("basic"), *(f"  rope {i}\n\tat lamp.Wick.trim(Wick.java:{i})" for i in range(400))])
                                        + "\n" + one.header("tid") + "\n\n").encode())
    _write(str(tmp_path / "c.log"), b"only orphans\n\n" * 300)
    _write(str(tmp_path / "quay.log"), QUAY_LOG.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    _split_at(spark, size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        a = sorted((tuple(r) for r in parse_files(spark, str(tmp_path)).select(*ENTRY_COLUMNS).collect()), key=repr)
        b = sorted((tuple(r) for r in parse_entries(read_lines(spark, str(tmp_path))).select(*ENTRY_COLUMNS).collect()), key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert a == b and len(a) == 101 + 2 + len(QUAY)


def test_a_gzip_file_of_many_chunks_equals_the_plain_one(spark, tmp_path):
    text = "".join(x + "\n" for x in some_log(random.Random(3), 900)[0]).encode()
    _write(str(tmp_path / "plain" / "a.log"), text)
    _write(str(tmp_path / "packed" / "a.log.gz"), gzip.compress(text))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # what a task holds at once, whatever the file's size
    _split_at(spark, 4096)
    try:
        columns = [c for c in ENTRY_COLUMNS if c != "file_path"]
        plain, packed = (sorted((tuple(r) for r in parse_files(spark, str(tmp_path / d)).select(*columns).collect()), key=repr)
                         for d in ("plain", "packed"))
    finally:
        _split_at(spark, 1 << 27)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert plain == packed and len(plain) == 900


def test_only_edges_of_splits_are_shuffled(spark, tmp_path):
    _write(str(tmp_path / "a.log"), "".join(x + "\n" for x in some_log(random.Random(9), 500)[0]).encode())
    plan = parse_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("PartitionFilters") >= 2
    whole, edges = plan.split("Union")[1].split("ObjectHashAggregate", 1)
    assert "Exchange hashpartitioning" not in whole and "BroadcastHashJoin" in whole and "_whole" in whole
    for scan in re.findall(r"FileScan parquet \[[^]]*raw[^]]*\].*?PartitionFilters: \[(.*?)\]", edges):
        assert "NOT _whole" in scan


def test_an_entry_too_large_for_a_list_is_named(spark, monkeypatch):
    import pyarrow as pa
    from logweave.operators import assemble
    monkeypatch.setattr(assemble, "LARGEST_ENTRY", 1000)
    rows = [("big.log", 0, i, 0 if i == 2 else None, 0 if i == 2 else 2, "x" * 50) for i in range(40)]
    schema = pa.schema([("file_path", pa.string()), ("_block", pa.int64()), ("_id", pa.int64()), ("_hk", pa.int32()),
                        ("_kind", pa.int8()), ("value", pa.string())])
    batches = [pa.record_batch(list(map(pa.array, zip(*rows[i:i + 5]))), [f.name for f in schema]).cast(schema) for i in range(0, 40, 5)]
    with pytest.raises(ValueError, match="big.log.* line 3 "):
        list(assemble.split_pieces(iter(batches)))


def test_listing_of_a_large_folder_keeps_the_plan_small(spark, tmp_path):
    deep = tmp_path / "a" / "b=1" / "_c=2"
    deep.mkdir(parents=True)
    for i in range(100_000):
        (deep / f"f{i}.log").touch()
    for hidden in ("_x/y.log", ".z/y.log", "a/.w.log", "a/_v.log"):
        _write(str(tmp_path / hidden), b"x\n")
    _write(str(tmp_path / "a" / "one+ %41.txt"), b"abc\n")
    found = discover_logs(spark, str(tmp_path))
    assert found.count() == 100_001 and found.where("size_bytes = 0").count() == 100_000
    assert len(found._jdf.queryExecution().toString()) < 30_000
    (one,) = found.where("size_bytes > 0").collect()
    assert (one.file_path, one.filename, one.size_bytes) == (f"file://{tmp_path}/a/one+ %41.txt", "one+ %41.txt", 4)
    assert abs(one.modified.timestamp() - time.time()) < 86400


def test_log_files_catalogue_and_format_choice(spark, tmp_path):
    from logweave.operators.formats import effective_format
    from logweave.sources.files import log_files
    from logweave.sources.lines import read_files_as_text
    _write(str(tmp_path / "wso2carbon.log"), QUAY_LOG.encode())
    _write(str(tmp_path / "audit.log"), QUAY_LOG.encode())
    lines = read_lines(spark, str(tmp_path))
    fmts = lines.select("file_path").distinct().where(F.col("file_path").endswith("audit.log")) \
        .withColumn("format_id", F.lit("builtin-apim-audit"))
    cat = {os.path.basename(r.file_path): r for r in log_files(lines, fmts, default_format="builtin-tid").collect()}
    assert cat["audit.log"].format_id == "builtin-apim-audit" and cat["wso2carbon.log"].format_id == "builtin-tid"
    assert cat["wso2carbon.log"].file_type == "wso2carbon" and cat["audit.log"].line_count == len(QUAY)
    df = spark.createDataFrame([(None,), ("x",)], "f string")
    assert [r[0] for r in df.select(effective_format("f", "dflt")).collect()] == ["dflt", "x"]
    texts = {os.path.basename(r.file_path): r.text for r in read_files_as_text(spark, str(tmp_path)).collect()}
    assert texts["audit.log"] == QUAY_LOG


def test_time_filter_prunes_date_partitions(spark, tmp_path):
    from logweave.operators.filters import filter_entries
    text = ("2024-01-01 10:00:00,000 INFO [a.B] - one\n2024-01-02 10:00:00,000 INFO [a.B] - two\n"
            "2024-01-03 10:00:00,000 INFO [a.B] - three\n")
    _write(str(tmp_path / "t.log"), text.encode())
    out = str(tmp_path / "e")
    write_entries(parse_entries(read_lines(spark, str(tmp_path / "t.log"))), out)
    e = read_entries(spark, out)
    hits = filter_entries(e, time_from="2024-01-02 00:00:00", time_to="2024-01-02 23:59:59")
    assert [r.message for r in hits.collect()] == ["two"]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_catalogue_driven_by_listing(spark, tmp_path):
    from logweave.sources.files import log_files
    _write(str(tmp_path / "a.log"), QUAY_LOG.encode())
    _write(str(tmp_path / "blank.log"), b"\n\n")
    _write(str(tmp_path / "empty.log"), b"")   # no split, so no line: only the listing knows it
    found = discover_logs(spark, str(tmp_path))
    cat = {r.filename: r for r in log_files(read_lines(spark, str(tmp_path)), sizes=found).collect()}
    assert (cat["empty.log"].line_count, cat["empty.log"].size_bytes, cat["empty.log"].first_timestamp) == (0, 0, None)
    assert cat["a.log"].line_count == len(QUAY) and cat["a.log"].size_bytes == len(QUAY_LOG.encode())
    assert cat["blank.log"].line_count == 2 and cat["blank.log"].first_timestamp is None


def test_stored_entries_push_filters_and_prune_columns(spark, tmp_path):
    from logweave.operators.filters import filter_entries
    _write(str(tmp_path / "t.log"), QUAY_LOG.encode())
    out = str(tmp_path / "e")
    write_entries(parse_entries(read_lines(spark, str(tmp_path / "t.log"))), out)
    q = filter_entries(read_entries(spark, out), levels=["warn"]).select("file_path", "line_number")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(level), EqualTo(level,WARN)]" in plan
    assert "ReadSchema: struct<file_path:string,line_number:bigint,level:string>" in plan
    assert [r.line_number for r in q.collect()] == [4]


@pytest.mark.parametrize("most", [0, 100_000])
def test_parse_files_with_file_formats(spark, tmp_path, monkeypatch, most):
    """The formats go to all tasks, or (too many files) the lines to the formats and back into their order."""
    from logweave.operators import parse
    from logweave.operators.formats import LogFormat
    monkeypatch.setattr(parse, "BROADCAST_FILES", most)
    _write(str(tmp_path / "a.log"), b"2024-01-01 00:00:00,000|warn|a.b.C|x\n  more\n")
    _write(str(tmp_path / "b.log"), QUAY_LOG.encode())
    ff = (discover_logs(spark, str(tmp_path)).where(F.col("filename") == "a.log")
          .select("file_path", F.lit("mine").alias("format_id")))
    got = {os.path.basename(r.file_path): r for r in parse_files(
        spark, str(tmp_path), file_formats=ff, formats=[LogFormat("mine", "%d|%p|%c|%m")]).collect()
        if r.line_number == 1}
    assert (got["a.log"].level, got["a.log"].logger_short, got["a.log"].message) == ("WARN", "C", "x\n  more")
    assert got["b.log"].level == "DEBUG" and got["b.log"].tid == "7"


def test_ingest_with_file_formats(spark, tmp_path):
    from logweave.operators.formats import LogFormat
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    _write(f"{src}/a.log", b"2024-01-01 00:00:00,000|error|a.b.C|x\n")
    _write(f"{src}/b.log", QUAY_LOG.encode())
    ff = (discover_logs(spark, src).where(F.col("filename") == "a.log")
          .select("file_path", F.lit("mine").alias("format_id")))
    ingest_new_files(spark, src, out, checkpoint=ck, file_formats=ff,
                     formats=[LogFormat("mine", "%d|%p|%c|%m")])
    got = read_entries(spark, out)
    assert got.count() == len(QUAY) + 1
    a = got.where(F.col("file_path").endswith("/a.log")).collect()
    assert len(a) == 1 and (a[0].level, a[0].logger_short, a[0].message) == ("ERROR", "C", "x")
