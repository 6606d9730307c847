"""F1-F9, L1-L5, A1-A6 on rendered events (sf0.001) and invariants from the
reference's API tests."""
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import packed as P
from logweave.operators import aggregates as A
from logweave.operators import filters as FL
from logweave.operators.search import search_entries, search_text, search_total
from logweave.plans import catalog
from tests.conftest import SF_SMALL, lines_df
from logweave.operators.parse import parse_entries


@pytest.fixture(scope="module")
def entries(spark):
    return catalog.r1_entries(spark, SF_SMALL).cache()


def test_totals_and_level_counts_agree(entries):
    s = {r.file_path: r for r in A.summary(entries).collect()}
    total = entries.count()
    assert sum(r.total_entries for r in s.values()) == total == 1000
    for r in s.values():
        assert sum(r.level_counts.values()) == r.total_entries
    lv = {r.level: r["count"] for r in A.level_counts(entries, per_file=False).collect()}
    assert lv == {"FATAL": 22, "ERROR": 179, "WARN": 202, "INFO": 409, "DEBUG": 188}


def test_logger_groups_sum_to_total(entries):
    g = A.group_entries(entries, "logger", per_file=False).collect()
    assert sum(r["count"] for r in g) == 1000


def test_group_key_validation(entries):
    with pytest.raises(ValueError):
        A.group_entries(entries, "thread")


def test_pages_disjoint_and_in_file_order(entries):
    p1 = [(r.file_path, r.line_number) for r in FL.page(entries, 0, 300).collect()]
    p2 = [(r.file_path, r.line_number) for r in FL.page(entries, 300, 300).collect()]
    assert not set(p1) & set(p2)
    assert p1 + p2 == sorted(p1 + p2)
    page, total = FL.page_with_total(entries, 0, 200)
    assert total == 1000 and page.count() == 200


def test_level_filter_case_insensitive(entries):
    a = FL.filter_entries(entries, levels=["error"]).count()
    b = FL.filter_entries(entries, levels=["ERROR"]).count()
    assert a == b == 179


def test_invalid_regex_is_ignored(entries):
    c = FL.Criteria(search="([", regex=True)
    assert FL.filter_entries(entries, c).count() == 1000
    assert c.warnings


def test_query_syntax(entries):
    c = FL.Criteria.from_query("/event 1[0-9]{2} /", errors_only=True)
    assert c.regex and c.search == "event 1[0-9]{2} " and c.levels == ["ERROR", "FATAL"]
    assert not FL.Criteria.from_query("//").regex


def test_time_filter_keeps_entries_without_timestamp(spark):
    df = lines_df(spark, {"x.log": "2024-01-01 00:00:00,000 INFO [a.B] - a\n"})
    e = parse_entries(df).withColumn("timestamp", F.lit(None).cast("string"))
    assert FL.filter_entries(e, time_from="2030-01-01").count() == 1


def test_component_filter(entries):
    n = FL.filter_entries(entries, components=["P7"]).count()
    m = entries.where(F.col("logger_short") == "P7").count()
    assert n == m > 0


def test_search_limit_and_order(entries):
    hits = search_entries(entries, "EVENT", limit=7).collect()
    assert len(hits) == 7
    keys = [(r.file_path, r.line_number) for r in hits]
    assert keys == sorted(keys)
    only = search_entries(entries, "event", file_paths=["user-3.log"], limit=1000).collect()
    assert {r.file_path for r in only} == {"user-3.log"}


def test_top_components_limit(entries):
    top = A.top_components(entries, n=3).collect()
    per = {}
    for r in top:
        per.setdefault(r.file_path, []).append((r["rank"], r["count"]))
    for ranks in per.values():
        ranks.sort()
        assert [x for x, _ in ranks] == list(range(1, len(ranks) + 1)) and len(ranks) <= 3
        assert [c for _, c in ranks] == sorted([c for _, c in ranks], reverse=True)


def test_search_text_on_documents(spark):
    d = catalog.table(spark, SF_SMALL, "documents")
    n_ci = search_text(d, "text", "THE").count()
    n_cs = search_text(d, "text", "THE", case_sensitive=True).count()
    assert n_ci >= n_cs
    assert search_text(d, "text", "(", regex=True).count() == d.count()


def test_group_entries_multi_equals_single(entries):
    multi = A.group_entries_multi(entries)
    for by in A.GROUP_KEYS:
        one = sorted(tuple(r) for r in A.group_entries(entries, by).collect())
        m = sorted(tuple(r) for r in multi.where(F.col("group_by") == by).drop("group_by").collect())
        assert one == m, by


def test_search_total_is_exact(entries):
    n = search_total(entries, "EVENT 1")
    assert n == FL.filter_entries(entries, search="event 1").count() > 100
    assert len(search_entries(entries, "EVENT 1", limit=100).collect()) == 100


def test_ordered_groups_and_callpath(spark, entries):
    from logweave.operators import resolve as RS
    g = A.ordered_groups(A.group_entries(entries, "level")).collect()
    per = {}
    for r in g:
        per.setdefault(r.file_path, []).append((r["count"], r.first_at))
    for rows in per.values():
        assert rows == sorted(rows, key=lambda x: (-x[0], x[1]))
    fr = spark.createDataFrame([("f", 1, 2, True), ("f", 1, 0, False), ("f", 1, 1, True)],
                               "file_path string, entry_line long, frame_pos int, resolved boolean")
    assert [r.frame_pos for r in RS.callpath(fr).collect()] == [0, 1, 2]


@pytest.mark.parametrize("kw", [dict(levels=["error", "warn"]), dict(components=["P7"], search="event"),
                                dict(time_from="2024-01-02 00:00:00", has_stack_trace=True),
                                dict(levels=["fatal"], time_to="2024-01-03 00:00:00", search="failed")])
def test_filter_lines_equals_filter_after_parse(spark, entries, kw):
    lines = catalog.r1_lines(spark, SF_SMALL)
    cols = ["file_path", "line_number", "level", "message", "stack_trace"]
    early = sorted(tuple(r) for r in FL.filter_lines(lines, parse_kw={"chunk_lines": 37}, **kw).select(*cols).collect())
    late = sorted(tuple(r) for r in FL.filter_entries(entries, **kw).select(*cols).collect())
    assert early == late and len(early) > 0


def test_search_lines_equals_search_after_parse(spark, entries):
    from logweave.operators.search import search_lines
    lines = catalog.r1_lines(spark, SF_SMALL)
    a = [(r.file_path, r.line_number) for r in search_lines(lines, "event", levels=["warn"], limit=50,
                                                             parse_kw={"chunk_lines": 41}).collect()]
    b = [(r.file_path, r.line_number) for r in search_entries(entries, "event", levels=["warn"], limit=50).collect()]
    assert a == b and len(a) == 50


def test_repeat_runs_equal_and_line_numbers_unique(spark, entries):
    again = catalog.r1_entries(spark, SF_SMALL)
    cols = ["file_path", "line_number", "level", "message", "stack_trace"]
    assert sorted(tuple(r) for r in again.select(*cols).collect()) == \
        sorted(tuple(r) for r in entries.select(*cols).collect())
    assert entries.select("file_path", "line_number").distinct().count() == entries.count()


def test_packed_timestamps_come_back(spark):
    texts = ["2031-07-04 23:59:59,007", "2031-07-04T00:00:00.5", "0000-00-00 00:00:00", "9999-99-99 99:99:99,12345678901234567"]
    odd = ["", "x", "2031-07-04 23:59:59,", "2031-07-04 23:59:59,123456789012345678", "2031-07-04  3:59:59", "２031-07-04 23:59:59", "2031-07-04 23:59:59,1 "]
    df = spark.createDataFrame([(t,) for t in [*texts, *odd, None]], "ts string")
    rows = df.withColumn("t", P.pack_time("ts")).withColumn("f", P.pack_fraction("ts")).select(
        "ts", "t", P.unpack("t", "f").alias("back"), P.odd("ts").alias("odd")).collect()
    for r in rows:
        assert (r.back, r.odd) == ((r.ts, None) if r.ts in texts else (None, r.ts))


@pytest.mark.parametrize("per_file", [True, False])
def test_first_and_last_of_any_timestamps(spark, per_file):
    """Null, empty and odd timestamps mixed with packed ones, against plain Python."""
    rng = random.Random(per_file)
    stamps = [None, "", "later", "2031-07-04 23:59:59,1", "2031-07-04T23:59:59", "1999-01-01 00:00:00.000000000000000000001"]
    rows = [(f"f{rng.randrange(3)}", n, rng.choice(stamps), rng.choice(["INFO", "ERROR"]), rng.random() < .3) for n in range(300)]
    df = spark.createDataFrame(rows, "file_path string, line_number long, timestamp string, level string, has_stack_trace boolean").repartition(5)
    got = {((r.file_path,) if per_file else ()) + (r.key,): (r["count"], r.first_seen, r.last_seen, r.error_count)
           for r in A.group_entries(df, "level", per_file).collect()}
    want = {}
    for f, n, ts, level, _ in sorted(rows):
        key = ((f,) if per_file else ()) + (level,)
        count, first, _, errors = want.get(key, (0, ts, ts, 0))
        want[key] = (count + 1, first, ts, errors + (level == "ERROR"))
    assert got == want
    if per_file:
        for r in A.summary(df).collect():
            own = sorted((n, ts, level, st) for f, n, ts, level, st in rows if f == r.file_path)
            dated = [ts for _, ts, _, _ in own if ts]
            assert (r.total_entries, r.first_timestamp, r.last_timestamp, r.has_stack_traces) == (
                len(own), dated[0], dated[-1], sum(st for *_, st in own))
            assert r.level_counts == {lv: sum(x[2] == lv for x in own) for lv in {x[2] for x in own}}
