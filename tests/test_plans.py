"""Plan checks for every registered query: no cartesian product or nested
loop join, no Python UDF, no window without a partition key, filters and
column pruning reach the Parquet scan."""
import re

import pytest

from logweave.plans import catalog
from tests.conftest import SF_SMALL

BAD = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_plan_shape(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    plan = _plan(df)
    for bad in BAD:
        assert bad not in plan, f"{name}: {bad}"
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[", plan):
        assert m.group(1).strip(), f"{name}: window without partition key"


def test_scan_prunes_columns(spark):
    plan = _plan(catalog.q_search_documents(spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,n_chars:bigint>" in plan
    plan = _plan(catalog.q_group_level(spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_line_windows_are_chunked(spark):
    """Skew guard: every window over lines is partitioned by (file, chunk) or
    (file, split); only one-row-per-chunk tables use a window by file."""
    plan = _plan(catalog.q_entries_auto(spark, SF_SMALL))
    specs = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan)
    assert specs
    for part, order in specs:
        if "line_number" in order or "_id" in order or "event_id" in order or re.search(r"\bn#", order):
            assert "_chunk" in part or "_block" in part, (part, order)


@pytest.mark.parametrize("name", ["level_counts", "top_components", "group_level", "group_component", "group_logger", "group_tenant",
                                  "group_correlation", "group_all", "summary"])
def test_header_queries_shuffle_no_text(spark, name):
    """What is grouped by header fields never sorts or shuffles a line's text."""
    lines = spark.createDataFrame([("a.log", 1, "x")], "file_path string, line_number long, value string")
    from logweave.operators import aggregates as A
    from logweave.operators.parse import header_entries
    heads = header_entries(lines)
    df = {"level_counts": lambda: A.level_counts(heads), "top_components": lambda: A.top_components(heads),
          "group_all": lambda: A.group_entries_multi(heads), "summary": lambda: A.summary_of_lines(lines)}.get(
        name, lambda: A.group_entries(heads, {"group_correlation": "correlationId"}.get(name, name.removeprefix("group_"))))()
    wide = [step for step in df._jdf.queryExecution().executedPlan().toString().split("\n")
            if re.search(r"(Exchange|Sort) ", step)]
    node = df._jdf.queryExecution().executedPlan()

    def walk(n):
        yield n
        kids = n.children()
        for i in range(kids.size()):
            yield from walk(kids.apply(i))
        if "AdaptiveSparkPlan" in n.nodeName():
            yield from walk(n.executedPlan())
    for n in walk(node):
        if n.nodeName() in ("Exchange", "Sort"):
            names = [n.output().apply(i).name() for i in range(n.output().size())]
            assert "value" not in names and "raw" not in names, (name, names)
    assert wide


def _nodes(df):
    def walk(n):
        yield n
        kids = n.children()
        for i in range(kids.size()):
            yield from walk(kids.apply(i))
        if "AdaptiveSparkPlan" in n.nodeName():
            yield from walk(n.executedPlan())
    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("name", ["summary", "group_all", "group_level", "group_over_files", "file_metadata"])
def test_order_statistics_are_hash_aggregates(spark, name):
    """First and last texts never sort the rows: what reads entries or lines is a hash aggregate of numbers."""
    from logweave.operators import aggregates as A
    from logweave.sources.files import file_metadata
    entries = spark.createDataFrame([], "file_path string, line_number long, timestamp string, level string, logger string, "
                                        "logger_short string, tenant_domain string, correlation_id string, has_stack_trace boolean")
    lines = spark.createDataFrame([], "file_path string, line_number long, value string")
    df = {"summary": lambda: A.summary(entries), "group_all": lambda: A.group_entries_multi(entries), "group_level": lambda: A.group_entries(entries, "level"),
          "group_over_files": lambda: A.group_entries(entries, "level", per_file=False), "file_metadata": lambda: file_metadata(lines)}[name]()

    def reads_rows(n):
        """No aggregate between this node and the rows."""
        kids = n.children()
        return all(kids.apply(i).nodeName() != "HashAggregate" and reads_rows(kids.apply(i)) for i in range(kids.size()))
    first = [n for n in _nodes(df) if "Aggregate" in n.nodeName() and reads_rows(n)]
    assert first and {n.nodeName() for n in first} == {"HashAggregate"}
