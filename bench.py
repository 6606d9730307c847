"""Headline benchmark: prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
    BENCH_RUNS (default 3; the median run is reported per query).

Prepare (not timed, reported as ``prepare_sec``): the driver's tables are
rendered once into what a deployment would have in storage - log text files
(R1, the users' logs concatenated into 2 x cpus files), the same lines as a
Parquet table, the Java sources (R3) and their class index (built once per
repository, as the reference does at registration),
and the parsed entries (``write_entries``: parse once, query many).  All of it
goes below ``spark.checkpoint.dir``.

  parse_files      R1 text files -> numbered lines -> entries (S1, P3, P6, P7)
  parse_assemble   stored lines -> entries (P3, P6, P7)
  summary_groups   stored entries -> summary + five groupings in one pass (A5, A6)
  filter_page      stored entries -> combined filter, page and total (F8, L2)
  search_logs      stored entries -> cross-file search (L4)
  search_text      ``documents`` -> text and regex search (F6, F7)
  resolve_frames   stored entries -> frames -> resolved frames -> snippets (T6, J1-J4)

Every query runs to completion through the ``noop`` sink (nothing is
collected to the driver).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from logweave.operators import aggregates as A  # noqa: E402
from logweave.operators import codeindex as CI  # noqa: E402
from logweave.operators import filters as FL  # noqa: E402
from logweave.operators import resolve as RS  # noqa: E402
from logweave.operators.frames import entry_frames  # noqa: E402
from logweave.operators.parse import parse_entries, parse_files  # noqa: E402
from logweave.operators.search import search_entries, search_text  # noqa: E402
from logweave.plans import catalog  # noqa: E402
from logweave.session import get_spark, scratch_path  # noqa: E402
from logweave.sources import render  # noqa: E402
from logweave.sources.sinks import open_index, read_entries, write_entries, write_index  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="logweave-bench",
                      extra={"spark.ui.showConsoleProgress": "false",
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="logweave-bench-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="logweave-bench-"),
                             "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})

    t0 = time.time()
    tag = f"bench-{os.getpid()}"
    lines_df = catalog.r1_lines(spark, sf_dir)
    text_dir = scratch_path(spark, f"{tag}-logs")
    # log text files: the users' logs concatenated into 2 x cpus files of one folder
    (lines_df.repartition(2 * cpus, "file_path").sortWithinPartitions("file_path", "line_number")
     .select("value").write.text(text_dir))
    lines_path = scratch_path(spark, f"{tag}-lines")
    lines_df.write.parquet(lines_path)
    src_path = scratch_path(spark, f"{tag}-sources")
    catalog.r3_sources(spark, sf_dir).write.parquet(src_path)
    index_path, index_table = scratch_path(spark, f"{tag}-class-index"), f"bench_index_{os.getpid()}"
    write_index(CI.class_index(spark.read.parquet(src_path)), index_table, index_path)   # built once per repository
    entries_path = scratch_path(spark, f"{tag}-entries")
    write_entries(parse_entries(spark.read.parquet(lines_path)), entries_path)
    prepare = time.time() - t0

    lines = spark.read.parquet(lines_path)
    entries = read_entries(spark, entries_path)
    sources = spark.read.parquet(src_path)
    index = open_index(spark, index_table, index_path)
    n_lines = lines.count()
    pm = catalog.package_map(spark)

    def q_parse_files():
        run(parse_files(spark, text_dir, glob="*.txt"))

    def q_parse_assemble():
        run(parse_entries(lines))

    def q_summary_groups():
        run(A.summary(entries))
        run(A.group_entries_multi(entries, ("level", "component", "logger", "tenant", "correlationId")))

    def q_filter_page():
        hits = FL.filter_entries(entries, levels=["error", "fatal"], has_stack_trace=True,
                                 time_from="2024-01-02 00:00:00", search="failed")
        run(FL.page(hits, 0, 500))
        run(hits.select(F.count(F.lit(1))))

    def q_search_logs():
        run(search_entries(entries, catalog.SEARCH_QUERY, levels=catalog.SEARCH_LEVELS, limit=100))

    def q_search_text():
        d = catalog.table(spark, sf_dir, "documents")
        run(search_text(d, "text", catalog.DOC_TEXT).select("doc_id"))
        run(search_text(d, "text", catalog.DOC_REGEX, regex=True).select("doc_id"))

    def q_resolve_frames():
        frames = entry_frames(entries)   # cheap to recompute from stored entries
        r = RS.resolve_frames(frames, index, pm, sources=sources, vendor_prefixes=render.R3_VENDOR_PREFIXES)
        run(r.where(F.col("resolved")))

    queries = {"parse_files": q_parse_files, "parse_assemble": q_parse_assemble,
               "summary_groups": q_summary_groups, "filter_page": q_filter_page,
               "search_logs": q_search_logs, "search_text": q_search_text, "resolve_frames": q_resolve_frames}
    q_parse_assemble()  # JVM warm-up
    times = {}
    for name, fn in queries.items():
        samples = []
        for _ in range(runs):
            t = time.time()
            fn()
            samples.append(time.time() - t)
        times[name] = round(statistics.median(samples), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_median_query_time", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus, "runs": runs, "lines": n_lines,
        "parse_files_lines_per_sec": round(n_lines / times["parse_files"], 1) if times["parse_files"] else None,
        "parse_lines_per_sec": round(n_lines / times["parse_assemble"], 1) if times["parse_assemble"] else None,
        "prepare_sec": round(prepare, 3),
    }))


if __name__ == "__main__":
    main()
