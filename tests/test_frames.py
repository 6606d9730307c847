"""T1-T6, C1, A7-A9, J1-J5 on literal inputs."""
import os

from pyspark.sql import functions as F

from logweave.operators import codeindex as CI
from logweave.operators import resolve as RS
from logweave.operators.frames import extract_frames, github_url, is_vendor_frame, normalise_trace

# (package, class, method, file, line) of the frames of a trace that is rendered below.
CALLS = [("ferry.deck", "Ramp", "lower", "Ramp.java", 31), ("ferry.deck", "Ramp$Chain", "pull", "Ramp.java", 77),
         ("ferry.hold.pump", "Bilge", "<init>", "Bilge.java", 8)]


def rendered(calls, head="ferry.Stuck: no steam"):
    return "\n".join([head, *[f"\tat {p}.{c}.{m}({f}:{n})" for p, c, m, f, n in calls]]) + "\n"


def frames_of(spark, text):
    df = spark.createDataFrame([(1, text)], "trace_id int, trace string")
    return sorted(extract_frames(df, "trace", ["trace_id"]).collect(), key=lambda r: r.frame_pos)


def test_extract_frames(spark):
    text = rendered(CALLS) + "\tat ferry.deck.Ramp.lift(Unknown Source)\n\tat ferry.deck.Ramp.lift(Native Method)\nCaused by: rust\n"
    got = frames_of(spark, text)
    assert [(f.package, f.class_name, f.method, f.file_name, f.line_no) for f in got][:2] == CALLS[:2]
    assert [f.frame_pos for f in got] == list(range(len(got)))
    assert got[0].raw == "at ferry.deck.Ramp.lower(Ramp.java:31)"


def test_normalise_escaped_newlines(spark):
    text = "x\\n  at a.b.C.d(C.java:1)\\r\\n  at a.b.C.e(C.java:2)\r  at a.b.C.f(C.kt:3)"
    fr = frames_of(spark, text)
    assert [f.method for f in fr] == ["d", "e"]
    got = spark.createDataFrame([("a\\nb\\rc\r\nd\re",)], "t string").select(normalise_trace("t")).first()[0]
    assert got == "a\nbc\nd\ne"


def test_vendor_prefixes(spark):
    df = spark.createDataFrame([("org.wso2",), ("org.wso2.x",), ("org.wso2x",), ("org.apache.axis2.y",), ("com.a",)],
                               "p string")
    assert [r[0] for r in df.select(is_vendor_frame("p")).collect()] == [True, True, False, True, False]


def test_longest_prefix_not_dot_bounded(spark):
    pm = spark.createDataFrame([("org.a.b", "r1"), ("org.a", "r0"), ("org.a.bb.c", "r2")], "prefix string, repo string")
    pk = spark.createDataFrame([(" org.a.bb ",), ("org.a.bb.c.d",), ("org.x",), ("org.a.b",)], "package string")
    got = {r.package: (r.repo, r.matched_prefix) for r in CI.resolve_package(pk, pm).collect()}
    assert got == {"org.a.bb": ("r1", "org.a.b"), "org.a.bb.c.d": ("r2", "org.a.bb.c"), "org.x": (None, None),
                   "org.a.b": ("r1", "org.a.b")}


def _repo(tmp, name, files):
    root = os.path.join(tmp, name)
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(text)
    return root


def java(package, name, lines, terminated=True):
    """A class of ``lines`` lines, the first of which names the package (if any)."""
    head = [f"package {package};"] if package else ["// in no package"]
    body = [f"    // {name} {n}" for n in range(2, lines)]
    return "\n".join([*head, *body, f"final class {name} {{}}"][:lines]) + ("\n" if terminated else "")


def test_index_resolve_and_snippet(spark, tmp_path):
    tmp = str(tmp_path)
    ramp = java("ferry.deck", "Ramp", 12)
    north = _repo(tmp, "north", {"src/Ramp.java": ramp, "build/out/Ghost.java": java("ferry.deck", "Ghost", 3),
                                 "src/Buoy.java": java(None, "Buoy", 4, terminated=False)})
    south = _repo(tmp, "south", {"x/Ramp.java": java("ferry.deck", "Ramp", 2), "x/Tide.java": "  " + java("ferry.sea", "Tide", 5)})
    src = CI.read_sources(spark, [("north", north), ("south", south)])
    assert {r.repo_label: (r.file_count, r.class_count) for r in CI.repo_stats(src).collect()} == {"north": (2, 2), "south": (2, 2)}
    index = {(r.repo_label, r.fqcn): r.line_count for r in CI.class_index(src).collect()}
    assert index == {("north", "ferry.deck.Ramp"): 12, ("north", "Buoy"): 4, ("south", "ferry.deck.Ramp"): 2, ("south", "ferry.sea.Tide"): 5}
    pm = spark.createDataFrame([("ferry.deck", "decks")], "prefix string, repo string")
    asked = [("ferry.deck", "Ramp", 3), ("ferry.deck", "Ramp$Chain$1", 11), ("ferry.deck", "Ramp$$Lambda$4", 1),
             ("ferry.sea", "Tide", 1), ("ferry.deck", "Ghost", 1), ("island", "Map", 1)]
    frames = spark.createDataFrame([("t", k, *a) for k, a in enumerate(asked)],
                                   "trace string, frame_pos int, package string, class_name string, line_no int")
    resolve = lambda **kw: RS.resolve_frames(frames, CI.class_index(src), pm, vendor_prefixes=["ferry"], **kw)
    rows = {r.frame_pos: r for r in resolve(sources=src).collect()}
    for k in (0, 1, 2):  # of two repositories the one registered first, inner and lambda classes by their outer one
        assert rows[k].resolved and rows[k].repo_label == "north" and rows[k].source_path.endswith("/north/src/Ramp.java")
        n, lines = asked[k][2], ramp.splitlines(keepends=True)
        assert rows[k].snippet == "".join(lines[max(0, n - 6):n + 5])
    assert [rows[k].reason for k in (3, 4, 5)] == [RS.NO_REPO, RS.NOT_FOUND, RS.NON_VENDOR]
    assert rows[5].repo is None
    (counts,) = RS.resolution_counts(resolve(), keys=("trace",)).collect()
    assert (counts.resolved_count, counts.total_count) == (3, 6)


def test_snippet_rules(spark):
    text = "".join(f"l{i}\n" for i in range(1, 21))
    df = spark.createDataFrame([(text, 10), (text, 1), (text, 20), (text, 30), ("a\nb", 2)], "t string, n int")
    got = [r[0] for r in df.select(RS.snippet_of(F.col("t"), F.col("n"), 2)).collect()]
    assert got == ["l8\nl9\nl10\nl11\nl12\n", "l1\nl2\nl3\n", "l18\nl19\nl20\n", "", "a\nb"]


def test_source_window(spark):
    text = "\n".join(f"line {i}" for i in range(1, 21)) + "\n"
    src = spark.createDataFrame([("F.java", text)], "source_path string, text string")
    req = spark.createDataFrame([("F.java", 10), ("F.java", None)], "source_path string, line int")
    rows = {r.target_line: r for r in RS.source_window(req, src, context=2).collect()}
    w = rows[10]
    assert (w.start_line, w.end_line, w.total_lines) == (8, 12, 20)
    assert w.content == "line 8\nline 9\nline 10\nline 11\nline 12"
    assert rows[None].content == text and rows[None].start_line is None


def test_github_url(spark):
    df = spark.createDataFrame([("o", "r", "1.0", "a/B.java", 5), ("o", "r", "v2", "a/B.java", 0),
                                ("o", "r", "v2", "x", None)], "o string, r string, t string, p string, n int")
    got = [x[0] for x in df.select(github_url("o", "r", "t", "p", "n")).collect()]
    assert got == ["https://github.com/o/r/blob/v1.0/a/B.java#L5", "https://github.com/o/r/blob/v2/a/B.java",
                   "https://github.com/o/r/blob/v2/x"]
