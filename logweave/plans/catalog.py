"""Named queries over the driver's tables (used by ``__spark_entry__`` and the
bench).  Each takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names and types match the SQL oracle in ``plans.oracle``.

Only test parameters live here (which levels, which text, which page); the
work is done by the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.operators import aggregates as A
from logweave.operators import filters as FL
from logweave.operators.formats import format_report as _format_report
from logweave.operators.parse import detect_format as _detect_format
from logweave.operators.formats import best_format
from logweave.operators.parse import header_entries, parse_entries, parse_files
from logweave.operators.search import search_lines, search_text
from logweave.sources import render
from logweave.session import scratch_path
from logweave.sources.files import classify_file, discover_logs, log_files
from logweave.sources.files import file_metadata as _file_metadata
from logweave.sources.files import skip_registered as _skip_registered
from logweave.sources.lines import read_lines
from logweave.sources.ends import detect_file_formats, file_times
from logweave.sources.named import write_named_files, write_named_lines
from logweave.sources.sinks import open_index, page_at, read_entries, write_directory, write_entries, write_index
from logweave.sources.textindex import search_stored, write_text_index
from logweave.operators import artifacts as AR
from logweave.operators import codeindex as CI
from logweave.operators import frames as FR
from logweave.operators import resolve as RS

# ----------------------------------------------------------------- test parameters
LEVELS = ["error", "Warn"]
COMPONENTS = ["P7", "org.example.small.P12"]
CORRELATION = "c13"
TIME_FROM, TIME_TO = "2024-01-02 00:00:00", "2024-01-05 12:00:00"
TEXT = "EVENT 12"
REGEX = r"event \d*7 user 1\d"
COMBINED = dict(levels=["error", "fatal"], has_stack_trace=True, time_from=TIME_FROM,
                search="FAILED")
PAGE_OFFSET, PAGE_LIMIT = 200, 200
PAGE_AFTER = ("user-12.log", 9)
FILTER_PAGE = dict(levels=["warn"], search="items=1")
FILTER_PAGE_LIMIT = 500
SEARCH_QUERY, SEARCH_LEVELS, SEARCH_LIMIT = "event 4", ["ERROR", "WARN"], 100
DOC_TEXT = 'Token = "'
DOC_REGEX = r'token\s*=\s*"[0-9a-f]{6}'
INDEXED_TEXT = "Signup event 4"
JSON_KEYS = 50
REGISTERED_MIN_VALUE = 200   # files of users with such a signup count as registered (J6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r1_lines(spark, sf_dir):
    return render.event_lines(table(spark, sf_dir, "events"))


def r2_lines(spark, sf_dir):
    return render.event_lines_layout(table(spark, sf_dir, "events"))


def r1_entries(spark, sf_dir):
    return parse_entries(r1_lines(spark, sf_dir))


def r2_entries(spark, sf_dir):
    return parse_entries(r2_lines(spark, sf_dir), layout=render.R2_LAYOUT)


def r1_headers(spark, sf_dir):
    return header_entries(r1_lines(spark, sf_dir))


def r2_headers(spark, sf_dir):
    return header_entries(r2_lines(spark, sf_dir), layout=render.R2_LAYOUT)


ENTRY_OUT = ["file_path", "line_number", "timestamp", "level", "logger", "message"]


def _entry_view(e: DataFrame) -> DataFrame:
    return e.select(*ENTRY_OUT)


# ----------------------------------------------------------------- parsing

def q_entries_auto(spark, sf_dir):
    e = r1_entries(spark, sf_dir)
    return e.select("file_path", "line_number", "raw", "timestamp", "timestamp_ms", "level", "logger",
                    "logger_short", "message", "tid", "app_name", "has_stack_trace",
                    F.size(F.coalesce("stack_trace", F.array())).cast("long").alias("stack_len"),
                    F.concat_ws("\n", "stack_trace").alias("stack_text"))


def q_entries_layout(spark, sf_dir):
    e = r2_entries(spark, sf_dir)
    return e.select("file_path", "line_number", "timestamp", "timestamp_ms", "level", "logger",
                    "logger_short", "message", "thread", "correlation_id", "tenant_domain",
                    "has_stack_trace",
                    F.size(F.coalesce("stack_trace", F.array())).cast("long").alias("stack_len"))


def q_detect_format(spark, sf_dir):
    return _detect_format(r1_lines(spark, sf_dir))


def q_format_report(spark, sf_dir):
    r = _format_report(r1_lines(spark, sf_dir))
    return r.select("file_path", "format_id", "lines_tested", "lines_matched", "first_matched_line", "match_ratio", "error",
                    F.col("captured")["logger"].alias("captured_logger"))


def q_best_formats(spark, sf_dir):
    return best_format(_format_report(r1_lines(spark, sf_dir)))


def q_file_metadata(spark, sf_dir):
    return _file_metadata(r1_lines(spark, sf_dir))


# ----------------------------------------------------------------- real files

FILE_RE = r"/log=([^/]+)\.txt$"
NO_LOG = "__HIVE_DEFAULT_PARTITION__"  # the log of lines without a path, named as Spark names it
LOG_FOLDERS = 64  # that the logs are dealt out to


def _write_logs(spark, sf_dir):
    """R1 as text files, one per log, below folders with a blank and a '+' in
    their names; returns the root folder."""
    root = scratch_path(spark, f"rendered logs+{uuid.uuid4().hex[:12]}")
    folder = F.pmod(F.xxhash64("file_path"), F.lit(LOG_FOLDERS)).cast("string")
    path = F.concat(F.lit("logs "), folder, F.lit("/log="), F.coalesce("file_path", F.lit(NO_LOG)), F.lit(".txt"))
    write_named_lines(r1_lines(spark, sf_dir).select(path.alias("path"), "line_number", "value"), root)
    return root


def _logical(df):
    return df.withColumn("file_path", F.regexp_extract("file_path", FILE_RE, 1))


def q_files_entries(spark, sf_dir):
    e = _logical(parse_files(spark, _write_logs(spark, sf_dir), recursive=True))
    return e.select("file_path", "line_number", "raw", "timestamp", "timestamp_ms", "level", "logger",
                    "logger_short", "message", "tid", "app_name", "has_stack_trace",
                    F.size(F.coalesce("stack_trace", F.array())).cast("long").alias("stack_len"),
                    F.concat_ws("\n", "stack_trace").alias("stack_text"))


def q_files_catalogue(spark, sf_dir):
    """Discovery, metadata and effective format of real files; sizes from the listing."""
    root = _write_logs(spark, sf_dir)
    found = discover_logs(spark, root)
    of = F.regexp_extract("file_path", r"user-([0-9]+)\.log", 1).try_cast("long")
    formats = found.select("file_path", F.when(of % 2 == 0, "builtin-bracket").alias("format_id")).where("format_id IS NOT NULL")
    files = log_files(read_lines(spark, root, recursive=True), formats, "builtin-tid", found)
    return _logical(files).select("file_path", "size_bytes", "line_count", "first_timestamp", "last_timestamp", "format_id")


def q_files_formats(spark, sf_dir):
    """Every file with an even user is read by the bracket layout, an unknown id means automatic."""
    root = _write_logs(spark, sf_dir)
    of = F.regexp_extract("file_path", r"user-([0-9]+)\.log", 1).try_cast("long")
    ff = discover_logs(spark, root).select("file_path", F.when(of % 2 == 0, "builtin-bracket").otherwise("no-such").alias("format_id"))
    e = _logical(parse_files(spark, root, recursive=True, file_formats=ff))
    return e.groupBy("file_path").agg(F.count(F.lit(1)).alias("entries"), F.min("line_number").alias("first_line"))


def q_stored_entries(spark, sf_dir):
    path = scratch_path(spark, f"entries-{uuid.uuid4().hex[:12]}")
    write_entries(r1_entries(spark, sf_dir), path)
    return read_entries(spark, path).select(*ENTRY_OUT, "log_date")


def q_file_types(spark, sf_dir):
    """Names made from the events' users, one for each rule."""
    u = F.col("user_id")
    name = F.concat(F.element_at(F.array(*map(F.lit, ["wso2carbon", "AUDIT", "http_access_", "Correlation", "other"])), (u % 5 + 1).cast("int")),
                    F.lit("-"), u.cast("string"), F.lit(".log"))
    names = table(spark, sf_dir, "events").select(name.alias("filename")).distinct()
    return names.select("filename", classify_file("filename").alias("file_type"))


# ----------------------------------------------------------------- filters / pages

def q_filter_levels(spark, sf_dir):
    return _entry_view(FL.filter_lines(r1_lines(spark, sf_dir), levels=LEVELS))


def q_filter_component(spark, sf_dir):
    return _entry_view(FL.filter_lines(r1_lines(spark, sf_dir), components=COMPONENTS))


def q_filter_correlation(spark, sf_dir):
    e = FL.filter_lines(r2_lines(spark, sf_dir), correlation_id=CORRELATION,
                        parse_kw={"layout": render.R2_LAYOUT})
    return e.select(*ENTRY_OUT, "correlation_id", "tenant_domain", "thread")


def q_filter_stack(spark, sf_dir):
    return _entry_view(FL.filter_entries(r1_entries(spark, sf_dir), has_stack_trace=True))


def q_filter_time(spark, sf_dir):
    return _entry_view(FL.filter_lines(r1_lines(spark, sf_dir), time_from=TIME_FROM, time_to=TIME_TO))


def q_filter_text(spark, sf_dir):
    return _entry_view(FL.filter_entries(r1_entries(spark, sf_dir), search=TEXT))


def q_filter_regex(spark, sf_dir):
    return _entry_view(FL.filter_entries(r1_entries(spark, sf_dir), search=REGEX, regex=True))


def q_filter_combined(spark, sf_dir):
    return _entry_view(FL.filter_lines(r1_lines(spark, sf_dir), **COMBINED))


def q_errors_only(spark, sf_dir):
    c = FL.Criteria.from_query("", errors_only=True)
    return _entry_view(FL.filter_lines(r1_lines(spark, sf_dir), c))


def q_page_entries(spark, sf_dir):
    return _entry_view(FL.page(r1_entries(spark, sf_dir), PAGE_OFFSET, PAGE_LIMIT))


def q_filter_page(spark, sf_dir):
    hits = FL.filter_lines(r1_lines(spark, sf_dir), **FILTER_PAGE)
    return _entry_view(FL.page(hits, 0, FILTER_PAGE_LIMIT))


def q_page_after(spark, sf_dir):
    """The page after a given row, without an offset."""
    return _entry_view(FL.page(r1_entries(spark, sf_dir), limit=PAGE_LIMIT, after=PAGE_AFTER))


# ----------------------------------------------------------------- aggregates

def q_ordered_groups(spark, sf_dir):
    """The groups' places in the order that ``ordered_groups`` gives."""
    ordered = A.ordered_groups(A.group_entries(r1_headers(spark, sf_dir), "component")).withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("_at"))
    return ordered.select("file_path", "key", "count", place.cast("long").alias("place"))


def q_summary(spark, sf_dir):
    s = A.summary_of_lines(r1_lines(spark, sf_dir))
    text = F.concat_ws(",", F.transform(F.map_entries("level_counts"),
                                        lambda kv: F.concat(kv["key"], F.lit("="), kv["value"].cast("string"))))
    return s.select("file_path", "total_entries", "first_timestamp", "last_timestamp",
                    "has_stack_traces", text.alias("level_counts"))


def q_level_counts(spark, sf_dir):
    return A.level_counts(r1_headers(spark, sf_dir))


def q_top_components(spark, sf_dir):
    return A.top_components(r1_headers(spark, sf_dir)).select(
        "file_path", "component", "count", F.col("rank").cast("long").alias("rank"))


def _groups(e, by):
    return A.group_entries(e, by).select("file_path", "key", "count", "first_seen", "last_seen",
                                         "error_count", "first_at")


def q_group_level(spark, sf_dir):
    return _groups(r1_headers(spark, sf_dir), "level")


def q_group_component(spark, sf_dir):
    return _groups(r1_headers(spark, sf_dir), "component")


def q_group_logger(spark, sf_dir):
    return _groups(r1_headers(spark, sf_dir), "logger")


def q_group_tenant(spark, sf_dir):
    return _groups(r2_headers(spark, sf_dir), "tenant")


def q_group_correlation(spark, sf_dir):
    return _groups(r2_headers(spark, sf_dir), "correlationId")


def q_group_all(spark, sf_dir):
    return A.group_entries_multi(r2_headers(spark, sf_dir)).select(
        "file_path", "group_by", "key", "count", "first_seen", "last_seen", "error_count", "first_at")


# ----------------------------------------------------------------- search

def q_search_files(spark, sf_dir):
    return _entry_view(search_lines(r1_lines(spark, sf_dir), SEARCH_QUERY, levels=SEARCH_LEVELS,
                                    limit=SEARCH_LIMIT))


def q_search_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return search_text(d, "text", DOC_TEXT).select("doc_id", "lang", "n_chars")


def q_search_documents_regex(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return search_text(d, "text", DOC_REGEX, regex=True).select("doc_id", "lang", "n_chars")


# ----------------------------------------------------------------- frames / code index

def r3_sources(spark, sf_dir):
    return render.part_sources(table(spark, sf_dir, "part"))


def package_map(spark):
    return spark.createDataFrame(render.R3_PACKAGE_MAP, "prefix string, repo string")


def r1_frames(spark, sf_dir):
    return FR.entry_frames(r1_entries(spark, sf_dir))


def _frame_out():
    return ["file_path", "entry_line", F.col("frame_pos").cast("long").alias("frame_pos"), "package",
            "class_name", "method", "file_name", F.col("line_no").cast("long").alias("line_no"), "raw"]


def q_frames(spark, sf_dir):
    return r1_frames(spark, sf_dir).select(*_frame_out())


def q_pasted_frames(spark, sf_dir):
    """Each entry's trace as text pasted with escaped line breaks."""
    e = r1_entries(spark, sf_dir).where("has_stack_trace")
    pasted = e.select("file_path", F.col("line_number").alias("entry_line"), F.concat_ws("\\r\\n", "stack_trace").alias("trace"))
    return FR.extract_frames(pasted, "trace", ["file_path", "entry_line"]).select(*_frame_out())


def q_vendor_frames(spark, sf_dir):
    f = r1_frames(spark, sf_dir)
    return f.select(*_frame_out(), FR.is_vendor_frame("package", render.R3_VENDOR_PREFIXES).alias("is_vendor"))


def q_class_index(spark, sf_dir):
    ci = CI.class_index(r3_sources(spark, sf_dir))
    return ci.select("repo_label", F.col("repo_order").cast("long").alias("repo_order"), "fqcn",
                     "source_path", "line_count")


def q_repo_stats(spark, sf_dir):
    st = CI.repo_stats(r3_sources(spark, sf_dir))
    return st.select("repo_label", F.col("repo_order").cast("long").alias("repo_order"), "file_count",
                     "class_count")


def _part_packages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("org.example."), F.lower("p_type"), F.lit("."),
                             F.lower(F.substring_index("p_name", " ", 1))).alias("package"))


def q_resolve_packages(spark, sf_dir):
    return CI.resolve_package(_part_packages(spark, sf_dir), package_map(spark))


def _resolved(spark, sf_dir, with_sources=False):
    src = r3_sources(spark, sf_dir)
    return RS.resolve_frames(r1_frames(spark, sf_dir), CI.class_index(src), package_map(spark),
                             sources=src if with_sources else None,
                             vendor_prefixes=render.R3_VENDOR_PREFIXES)


def q_resolve_frames(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return r.select("file_path", "entry_line", F.col("frame_pos").cast("long").alias("frame_pos"), "package",
                    "class_name", F.col("line_no").cast("long").alias("line_no"), "resolved", "reason",
                    "repo", "source_path", "repo_label")


def q_resolution_counts(spark, sf_dir):
    return RS.resolution_counts(_resolved(spark, sf_dir))


def q_callpath(spark, sf_dir):
    """T4: the frames of each trace in the order that ``callpath`` gives, numbered."""
    path = RS.callpath(_resolved(spark, sf_dir)).withColumn("_at", F.monotonically_increasing_id())
    step = F.row_number().over(Window.partitionBy("file_path", "entry_line").orderBy("_at"))
    return path.select("file_path", "entry_line", step.cast("long").alias("step"), "class_name", "resolved")


def q_frame_snippets(spark, sf_dir):
    r = _resolved(spark, sf_dir, with_sources=True).where(F.col("resolved"))
    return r.select("file_path", "entry_line", F.col("frame_pos").cast("long").alias("frame_pos"),
                    "source_path", F.col("line_no").cast("long").alias("line_no"), "snippet")


def q_source_window(spark, sf_dir):
    src = r3_sources(spark, sf_dir)
    req = (_resolved(spark, sf_dir).where(F.col("resolved"))
           .select("source_path", F.col("line_no").alias("line")))
    w = RS.source_window(req, src, RS.WINDOW_CONTEXT)
    return w.select("source_path", F.col("target_line").cast("long").alias("target_line"), "total_lines",
                    F.col("start_line").cast("long").alias("start_line"),
                    F.col("end_line").cast("long").alias("end_line"), "content")


# ----------------------------------------------------------------- artifacts

def r4_jars(spark, sf_dir):
    return render.part_jar_rows(table(spark, sf_dir, "part"))


def jar_versions(spark, sf_dir):
    return AR.artifact_versions(AR.scan_artifacts(r4_jars(spark, sf_dir)))


def q_artifact_versions(spark, sf_dir):
    return jar_versions(spark, sf_dir)


def q_package_versions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pk = p.select(F.concat(F.lit("org.example."), F.lower("p_type"), F.lit("."),
                           F.regexp_replace("p_name", " ", "-")).alias("package"))
    ov = spark.createDataFrame(render.R4_OVERRIDES, "prefix string, artifact_id string")
    return AR.resolve_artifact_version(pk, ov, jar_versions(spark, sf_dir))


def _r4_tags(spark, sf_dir):
    """Release tags of the R4 jars: ``v{version}`` for even keys, else the bare version."""
    j = AR.scan_artifacts(r4_jars(spark, sf_dir), keep=("k", "org"))
    tag = F.when(F.col("k") % 2 == 0, F.concat(F.lit("v"), F.col("version"))).otherwise(F.col("version"))
    return j.select("org", F.col("artifact_id").alias("repo"), tag.alias("tag"), "k", "path")


def q_release_tags(spark, sf_dir):
    versions = jar_versions(spark, sf_dir).select(F.col("artifact_id").alias("repo"), "version")
    return AR.match_release_tags(versions, _r4_tags(spark, sf_dir).select("org", "repo", "tag"), render.R4_ORGS)


def q_github_urls(spark, sf_dir):
    t = _r4_tags(spark, sf_dir)
    rel = F.concat(F.lit("src/main/java/P"), (F.col("k") % 50).cast("string"), F.lit(".java"))
    return t.select("path", FR.github_url("org", "repo", "tag", rel, F.col("k") % 5).alias("url"))


def q_packages_of_repo(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("org.example."), F.lower("p_type")).alias("package"))
    repos = CI.resolve_package(p, package_map(spark)).where(F.col("repo").isNotNull())
    return CI.packages_of_repo(package_map(spark), repos)


def q_feature_repos(spark, sf_dir):
    feats = spark.createDataFrame(render.FEATURES, "keyword string, repos array<string>")
    kw = table(spark, sf_dir, "part").select(F.lower("p_type").alias("keyword"))
    return CI.feature_repos(feats, kw).select("keyword", F.col("repo_pos").cast("long").alias("repo_pos"), "repo")


def _as_json(pairs) -> str:
    """``pairs(key, value)`` as a folder of JSON objects."""
    path = scratch_path(pairs.sparkSession, f"map-{uuid.uuid4().hex[:12]}")
    write_named_files(CI.json_objects(pairs, JSON_KEYS), path)
    return path


def q_dims_from_json(spark, sf_dir):
    """A package map derived from the parts, written as many JSON objects and loaded again."""
    pairs = _part_packages(spark, sf_dir).distinct().select(
        F.col("package").alias("key"), F.concat(F.lit("r-"), F.substring_index("package", ".", -1)).alias("value"))
    return CI.load_map_json(spark, _as_json(pairs), "prefix", "repo")


def q_features_from_json(spark, sf_dir):
    """The brands of each part type as keyword -> repositories, through JSON objects."""
    p = table(spark, sf_dir, "part")
    brands = p.groupBy(F.lower("p_type").alias("key")).agg(F.array_sort(F.collect_set("p_brand")).alias("value"))
    return CI.feature_repos(CI.load_features_json(spark, _as_json(brands))).select(
        "keyword", F.col("repo_pos").cast("long").alias("repo_pos"), "repo")


def q_files_class_index(spark, sf_dir):
    """The rendered sources as a tree of .java files (excluded folders included), read and indexed."""
    root = scratch_path(spark, f"trees-{uuid.uuid4().hex[:12]}")
    # Parts are far smaller than the files made of them, so many of them may be in one split.
    part = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    paths = F.array("source_path", F.concat("source_path", F.lit(".txt")))  # the second is not Java
    write_named_files(render.part_sources(part).select(F.explode(paths).alias("path"), "text"), root)
    found = CI.class_index(CI.read_sources(spark, [(f"repo-{k}", f"{root}/repo-{k}") for k in (0, 1)]))
    return found.select("repo_label", F.col("repo_order").cast("long").alias("repo_order"), "fqcn",
                        F.regexp_extract("source_path", "(repo-[01]/m.*)$", 1).alias("source_path"), "line_count")


def q_stored_index(spark, sf_dir):
    """The class index in buckets; one repository is stored with wrong rows first and indexed again, then the
    classes of all frames are looked up in the stored index."""
    name, src = f"class_index_{uuid.uuid4().hex[:12]}", r3_sources(spark, sf_dir)
    path = scratch_path(spark, name)
    index = CI.class_index(src)
    write_index(index.withColumn("fqcn", F.when(F.col("repo_label") == "repo-1", F.concat("fqcn", F.lit("Old"))).otherwise(F.col("fqcn"))),
                name, path)
    write_index(index.where("repo_label = 'repo-1'"), name, path)
    asked = r1_frames(spark, sf_dir).select("package", "class_name").distinct()
    return CI.lookup_class(asked, open_index(spark, name, path)).select("package", "class_name", "repo_label", "source_path", "indexed_fqcn")


def q_page_deep(spark, sf_dir):
    """L1: a page two thirds down all entries, by the page directory."""
    path = scratch_path(spark, f"entries-{uuid.uuid4().hex[:12]}")
    write_entries(r1_entries(spark, sf_dir), path)
    stored = read_entries(spark, path)
    write_directory(stored, path + "-pages", page_lines=64)
    pages = spark.read.parquet(path + "-pages")
    total = pages.agg(F.sum("n")).first()[0]
    return _entry_view(page_at(stored, pages, total * 2 // 3, PAGE_LIMIT))


def q_search_indexed(spark, sf_dir):
    """F6 on stored entries with a skipping index."""
    path = scratch_path(spark, f"entries-{uuid.uuid4().hex[:12]}")
    write_entries(r1_entries(spark, sf_dir), path, max_records_per_file=500)
    write_text_index(spark, path, path + "-grams")
    return _entry_view(search_stored(spark, path, path + "-grams", FL.Criteria(search=INDEXED_TEXT))[0])


def q_files_formats_detected(spark, sf_dir):
    """P4 from the heads of real files."""
    return _logical(detect_file_formats(discover_logs(spark, _write_logs(spark, sf_dir))))


def q_files_times(spark, sf_dir):
    """S3 from the ends of real files."""
    return _logical(file_times(discover_logs(spark, _write_logs(spark, sf_dir)))).select(
        "file_path", "file_type", "size_bytes", "first_timestamp", "last_timestamp")


def q_source_windows(spark, sf_dir):
    """Sources of 40 lines, asked for at both ends, in the middle, behind the end and whole."""
    line = F.element_at(F.array(*map(F.lit, [1, 3, 20, 38, 40, 60, None])), (F.col("p_partkey") % 7 + 1).cast("int"))
    # Part keys are far smaller than the sources made of them, so many of them may be in one split.
    part = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    src = render.part_sources(part.withColumn("line", line), lines=40, keep=("line",))
    asked = src.select("source_path", "line")
    return RS.source_window(asked, src).select("source_path", F.col("target_line").cast("long").alias("target_line"), "total_lines",
                                               F.col("start_line").cast("long").alias("start_line"),
                                               F.col("end_line").cast("long").alias("end_line"), "content")


def q_release_tags_normalised(spark, sf_dir):
    """All four forms of a tag, the organisations in order, and the link to the tag."""
    v = render.part_versions(table(spark, sf_dir, "part"))
    found = AR.match_release_tags(v, v.where("tag IS NOT NULL").select("org", "repo", "tag"), render.R4_ORGS)
    return found.select("repo", "version", "org", "tag", F.when(F.col("tag").isNotNull(), FR.github_url(
        "org", "repo", "tag", F.lit("pom.xml"), F.lit(None).cast("int"))).alias("url"))


def q_skip_registered(spark, sf_dir):
    found = r1_lines(spark, sf_dir).select("file_path").distinct()
    ev = table(spark, sf_dir, "events")
    registered = ev.where((F.col("event_type") == "signup") & (F.col("value") > REGISTERED_MIN_VALUE)).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(".log")).alias("file_path"))
    return _skip_registered(found, registered)


QUERIES = {
    "entries_auto": q_entries_auto,
    "entries_layout": q_entries_layout,
    "detect_format": q_detect_format,
    "format_report": q_format_report,
    "best_formats": q_best_formats,
    "files_entries": q_files_entries,
    "files_catalogue": q_files_catalogue,
    "files_formats": q_files_formats,
    "stored_entries": q_stored_entries,
    "file_types": q_file_types,
    "page_after": q_page_after,
    "ordered_groups": q_ordered_groups,
    "pasted_frames": q_pasted_frames,
    "callpath": q_callpath,
    "dims_from_json": q_dims_from_json,
    "file_metadata": q_file_metadata,
    "filter_levels": q_filter_levels,
    "filter_component": q_filter_component,
    "filter_correlation": q_filter_correlation,
    "filter_stack": q_filter_stack,
    "filter_time": q_filter_time,
    "filter_text": q_filter_text,
    "filter_regex": q_filter_regex,
    "filter_combined": q_filter_combined,
    "errors_only": q_errors_only,
    "page_entries": q_page_entries,
    "filter_page": q_filter_page,
    "summary": q_summary,
    "level_counts": q_level_counts,
    "top_components": q_top_components,
    "group_level": q_group_level,
    "group_component": q_group_component,
    "group_logger": q_group_logger,
    "group_tenant": q_group_tenant,
    "group_correlation": q_group_correlation,
    "group_all": q_group_all,
    "search_files": q_search_files,
    "search_documents": q_search_documents,
    "search_documents_regex": q_search_documents_regex,
    "frames": q_frames,
    "vendor_frames": q_vendor_frames,
    "class_index": q_class_index,
    "repo_stats": q_repo_stats,
    "resolve_packages": q_resolve_packages,
    "resolve_frames": q_resolve_frames,
    "resolution_counts": q_resolution_counts,
    "frame_snippets": q_frame_snippets,
    "source_window": q_source_window,
    "artifact_versions": q_artifact_versions,
    "package_versions": q_package_versions,
    "release_tags": q_release_tags,
    "github_urls": q_github_urls,
    "packages_of_repo": q_packages_of_repo,
    "feature_repos": q_feature_repos,
    "skip_registered": q_skip_registered,
    "features_from_json": q_features_from_json,
    "files_class_index": q_files_class_index,
    "stored_index": q_stored_index,
    "page_deep": q_page_deep,
    "search_indexed": q_search_indexed,
    "files_formats_detected": q_files_formats_detected,
    "files_times": q_files_times,
    "source_windows": q_source_windows,
    "release_tags_normalised": q_release_tags_normalised,
}
