"""Frame resolution (J3), snippets (J4), source windows (J5), counts (A7),
call path (T4).

Plan for millions of frames: every look-up runs on *distinct* keys first
(packages for J1, ``(package, class_name)`` for J2, ``(source_path, line)``
for J4), whose number is bounded by the code base, then the answers are
equi-joined back to the frames.  The join back has a small, deduplicated
right side; AQE broadcasts it when its runtime size is under the threshold
and otherwise splits skewed frame partitions (a hot class) in a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.codeindex import lookup_class, resolve_package
from logweave.operators.frames import VENDOR_PREFIXES, is_vendor_frame
from logweave.sources.sinks import materialize

# The unresolved reasons and the context sizes.
NON_VENDOR = "non_wso2_frame"
NO_REPO = "no_repo_mapping"
NOT_FOUND = "class_not_found_in_registered_repos"
SNIPPET_CONTEXT = 5
WINDOW_CONTEXT = 10
MAX_WINDOW_CONTEXT = 200
# line breaks of Python's str.splitlines()
SPLITLINES_RE = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def resolve_keys(keys: DataFrame, index: DataFrame, package_map: DataFrame,
                 sources: DataFrame | None = None, context: int = SNIPPET_CONTEXT) -> DataFrame:
    """J1 + J2 + J3 (+J4) on distinct vendor-frame keys
    ``(package, class_name, line_no)``: ``repo``, ``resolved``, ``reason``,
    ``source_path``, ``repo_label``, ``repo_path`` (and ``snippet``)."""
    repos = resolve_package(keys.select("package"), package_map).select("package", "repo")
    classes = lookup_class(keys.select("package", "class_name"), index)
    r = keys.join(repos, "package", "left").join(classes, ["package", "class_name"], "left")
    found = F.col("repo").isNotNull() & F.col("source_path").isNotNull()
    r = r.select(
        "package", "class_name", "line_no", "repo", found.alias("resolved"),
        F.when(F.col("repo").isNull(), F.lit(NO_REPO))
        .when(F.col("source_path").isNull(), F.lit(NOT_FOUND)).alias("reason"),
        F.when(found, F.col("source_path")).alias("source_path"),
        F.when(found, F.col("repo_label")).alias("repo_label"),
        F.when(found, F.col("repo_path")).alias("repo_path"))
    if sources is not None:
        r = attach_snippet(r, sources, context)
    return r


def resolve_frames(frames: DataFrame, index: DataFrame, package_map: DataFrame,
                   sources: DataFrame | None = None, vendor_prefixes=VENDOR_PREFIXES,
                   context: int = SNIPPET_CONTEXT, store: bool = False) -> DataFrame:
    """J3 (+J4 when ``sources`` is given): each frame with ``resolved``,
    ``reason``, ``repo``, ``source_path``, ``repo_label``, ``repo_path`` (and
    ``snippet``).  Rules in order: vendor gate, package -> repo mapping (the
    mapped repo only gates), class search in every indexed repository.

    Plan: the distinct vendor keys ``(package, class_name, line_no)`` (a
    partial aggregation, so a hot class costs one row per task) are resolved
    against the class index (stored in buckets by ``sinks.write_index``, it is
    not shuffled) and the answers joined to the frames.  Lazy: nothing runs
    before an action, which reads ``frames`` twice; at run time Spark takes a
    broadcast join if the answers are small and splits a hot class otherwise.

    ``store``: for frames that are dear to compute, or so many that they must
    not be shuffled: frames and answers (bounded by the code base) are written
    below ``spark.checkpoint.dir`` first (eager), so the planner knows the
    answers' size and leaves the frames where they are if it is under the
    broadcast threshold.
    """
    if store:
        frames = materialize(frames, "frames")
    vendor = is_vendor_frame("package", vendor_prefixes)
    keys = frames.where(vendor).select("package", "class_name", "line_no").distinct()
    answers = resolve_keys(keys, index, package_map, sources, context)
    if store:
        answers = materialize(answers, "frame-answers")
    a = answers.select(*[F.col(c).alias("_a_" + c) for c in answers.columns])
    out = frames.join(a, (frames["package"] == a["_a_package"]) & (frames["class_name"] == a["_a_class_name"])
                      & frames["line_no"].eqNullSafe(a["_a_line_no"]), "left")
    v = vendor
    cols = [*[frames[c] for c in frames.columns],
            (v & F.coalesce(F.col("_a_resolved"), F.lit(False))).alias("resolved"),
            F.when(~v, F.lit(NON_VENDOR)).otherwise(F.col("_a_reason")).alias("reason"),
            F.when(v, F.col("_a_repo")).alias("repo"),
            F.when(v, F.col("_a_source_path")).alias("source_path"),
            F.when(v, F.col("_a_repo_label")).alias("repo_label"),
            F.when(v, F.col("_a_repo_path")).alias("repo_path")]
    if sources is not None:
        cols.append(F.when(v, F.col("_a_snippet")).alias("snippet"))
    return out.select(*cols)


def _lines_of(text: Column) -> Column:
    """Physical lines as ``readlines()`` sees them, without terminators; a
    trailing terminator leaves an empty last element."""
    return F.split(text, "\r\n|\r|\n", -1)


def snippet_of(text: Column, line: Column, context: int = SNIPPET_CONTEXT) -> Column:
    """J4 rule: lines ``[line-context, line+context]`` clipped to the file,
    each with its line break, concatenated (the last line of a file without a
    final newline has none)."""
    return _snippet(_lines_of(text), line, context)


def _snippet(parts: Column, line: Column, context: int) -> Column:
    size = F.size(parts)
    n_lines = F.when(F.element_at(parts, -1) == "", size - 1).otherwise(size)
    start = F.greatest(F.lit(0), line - 1 - context)
    end = F.least(n_lines, line + context)
    body = F.concat_ws("\n", F.slice(parts, start + 1, F.greatest(end - start, F.lit(0))))
    tail = F.when(end < size, F.lit("\n")).otherwise(F.lit(""))
    return F.when(end > start, F.concat(body, tail)).otherwise(F.lit(""))


def _texts(sources: DataFrame) -> DataFrame:
    """One text per source path: of a path in several roots, that of the first registered one.

    Texts are dealt out by path before they are aggregated: below the exchange an aggregate would sort all texts that a task
    reads or renders.  The number of partitions is given, as they would be merged by their size as compressed."""
    dealt = sources.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_path")
    if "repo_order" not in sources.columns:
        return dealt.groupBy("source_path").agg(F.min("text").alias("text"))
    first = dealt.groupBy("source_path").agg(F.min(F.struct("repo_order", "text")).alias("first"))
    return first.select("source_path", F.col("first.text").alias("text"))


def attach_snippet(resolved: DataFrame, sources: DataFrame, context: int = SNIPPET_CONTEXT) -> DataFrame:
    """Add ``snippet`` for resolved frames.  A file's text is joined and
    split once, to the distinct lines asked of it (at most as many as it has),
    and its snippets are cut from the split text (no range join); a missing
    file gives null."""
    asked = (resolved.where(F.col("resolved")).groupBy("source_path")
             .agg(F.collect_set("line_no").alias("_asked")))
    parts = asked.join(_texts(sources), "source_path").select("source_path", "_asked", _lines_of(F.col("text")).alias("_parts"))
    cut = F.transform("_asked", lambda n: F.struct(n.alias("line_no"), _snippet(F.col("_parts"), n, context).alias("snippet")))
    snippets = parts.select("source_path", cut.alias("_cut")).select("source_path", F.inline_outer("_cut"))
    return resolved.join(snippets, ["source_path", "line_no"], "left")


def _splitlines(text: Column) -> Column:
    """Python ``str.splitlines()``: no empty element after a final break."""
    trimmed = F.regexp_replace(text, "(" + SPLITLINES_RE + ")$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLITLINES_RE, -1))


def source_window(requests: DataFrame, sources: DataFrame, context: int = WINDOW_CONTEXT) -> DataFrame:
    """For ``requests(source_path, line)`` the text around ``line``
    (``context`` 0..200 lines each side, clipped), with ``start_line``,
    ``end_line``, ``total_lines``, ``target_line``; a null line returns the
    whole text.  Lines follow ``str.splitlines()`` and are joined by LF."""
    if not 0 <= context <= MAX_WINDOW_CONTEXT:
        raise ValueError(f"context must be within 0..{MAX_WINDOW_CONTEXT}")
    # a file's text is joined and split once, to the distinct lines asked of it
    asked = requests.groupBy("source_path").agg(F.collect_set(F.struct("line")).alias("_asked"))
    j = asked.join(_texts(sources), "source_path").select("source_path", "_asked", "text", _splitlines(F.col("text")).alias("_lines"))
    total = F.size("_lines")

    def window(line: Column) -> Column:
        start = F.greatest(F.lit(0), line - 1 - context)
        end = F.least(total, line + context)
        body = F.concat_ws("\n", F.slice("_lines", start + 1, F.greatest(end - start, F.lit(0))))
        whole = line.isNull()
        return F.struct(
            line.alias("target_line"), total.cast("long").alias("total_lines"),
            F.when(~whole, start + 1).alias("start_line"), F.when(~whole, end).alias("end_line"),
            F.when(whole, F.col("text")).when(end > start, body).otherwise(F.lit("")).alias("content"))

    cut = j.select("source_path", F.transform("_asked", lambda a: window(a["line"])).alias("_cut"))
    return cut.select("source_path", F.inline_outer("_cut"))


def resolution_counts(resolved: DataFrame, keys=("file_path", "entry_line")) -> DataFrame:
    """Resolved and total frames per trace."""
    return resolved.groupBy(*keys).agg(F.count_if(F.col("resolved")).alias("resolved_count"),
                                       F.count(F.lit(1)).alias("total_count"))


def callpath(resolved: DataFrame, keys=("file_path", "entry_line")) -> DataFrame:
    """T4: the resolved frames of each trace, top to bottom."""
    return resolved.orderBy(*keys, "frame_pos")
