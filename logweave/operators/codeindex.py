"""Java source index and package look-ups.

``source_files(repo_label, repo_path, repo_order, source_path, text)`` is one
row per ``.java`` file as whole text (source files are small; whole-text rows
make the multi-line package rule and line slicing exact).

Longest-prefix joins (J1) never use a theta join: every prefix of each
*distinct* package is generated (one row per prefix length) and equi-joined
to the map, then the longest hit wins.  The work is bounded by the number of
distinct packages times their length, which grows with the code base, not
with the log volume.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import py_strip
from logweave.sources.listing import file_system, list_trees, located, skipped
from logweave.sources.paths import below, scanned_path
from logweave.sources.texts import read_texts

# Directories never indexed, the package declaration rule.
EXCLUDED_DIRS = ["target", "build", ".git", "node_modules"]
PACKAGE_RE = r"(?mU)^\s*package\s+([\w.]+)\s*;"


# ----------------------------------------------------------------- S6 / S7

def _unread(name: str) -> bool:
    """What Spark's readers leave out below a root: ``listing.skipped`` but for folders of this beginning."""
    return skipped(name) and not name.startswith(("_metadata", "_common_metadata"))


def _opened(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` is one folder of a file system that pyarrow opens."""
    try:
        return not re.search(r"[*?\[{\\]", root) and bool(file_system(located(spark, root)[0]))
    except (pa.ArrowException, OSError):
        return False


def read_sources(spark: SparkSession, repos: list[tuple[str, str]]) -> DataFrame:
    """Every ``*.java`` file below each repository root that is not empty, as whole text.

    ``repos`` is the registration-ordered list of ``(label, root path)``.  The trees are listed and read on the executors
    (``sources.listing``, eager; ``sources.texts``); roots with patterns and those of file systems that only Spark opens are
    read by its text source.
    """
    if not repos:
        raise ValueError("no repositories given")
    columns = lambda order, label, root, path: [
        label.alias("repo_label"), root.alias("repo_path"), order.alias("repo_order"), path.alias("source_path"), "text"]
    found, rest = [], []
    for order, repo in enumerate(repos):
        (found if _opened(spark, repo[1]) else rest).append((order, *repo))
    out = []
    if found:
        files = (list_trees(spark, [root for _, _, root in found], _unread)
                 .where(F.col("file_path").endswith(".java") & (F.col("size_bytes") > 0) & ~F.col("file_path").rlike("/_[^=/]*$")))
        order, label, root = (F.element_at(F.array(*map(F.lit, c)), F.col("tree") + 1) for c in zip(*found))
        out.append(read_texts(files).select(*columns(order, label, root, F.col("file_path"))))
    for order, label, root in rest:
        df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.java").withColumnRenamed("value", "text")
        out.append(df.select(*columns(*map(F.lit, (order, label, root)), scanned_path())))
    return reduce(DataFrame.unionByName, out)


def _json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the JSON objects at ``path``: one file, or a folder of files of one object each (a map that grows is
    written as many bounded objects, e.g. one per hash bucket).  Of a key in several objects the first file by path counts;
    ``_comment`` is no key."""
    raw = spark.read.text(path, wholetext=True).select(scanned_path().alias("_file"), "value")
    pairs = raw.select("_file", F.explode(F.from_json("value", "map<string,string>")).alias("_k", "_v"))
    return (pairs.where(F.col("_k") != "_comment").groupBy(F.col("_k").alias("key"))
            .agg(F.min_by("_v", "_file").alias("value")))


def load_map_json(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """JSON objects ``{key: "value", ...}`` as rows."""
    return _json_objects(spark, path).select(F.col("key").alias(key), F.col("value").alias(value))


def load_features_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects ``{keyword: [repo, ...]}`` as ``features(keyword, repos)``."""
    return (_json_objects(spark, path).select(F.col("key").alias("keyword"), F.from_json("value", "array<string>").alias("repos"))
            .where(F.col("repos").isNotNull()))


def json_objects(pairs: DataFrame, keys_each: int = 1000) -> DataFrame:
    """``pairs(key, value)`` (distinct keys) as files for ``sources.named``: (path, text), JSON objects of about ``keys_each``
    keys by hash of the key.  Eager: counts the pairs."""
    buckets = max(1, -(-pairs.count() // keys_each))
    grouped = pairs.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("_b")).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("text"))
    return grouped.select(F.concat(F.lit("part-"), F.lpad(F.col("_b").cast("string"), 8, "0"), F.lit(".json")).alias("path"), "text")


# ----------------------------------------------------------------- C1 / A8 / A9

def indexed_files(sources: DataFrame) -> DataFrame:
    """C1 per file: package, class (file stem), fqcn, line count, after
    dropping files with an excluded directory below the repository root."""
    rel = below(F.col("source_path"), F.col("repo_path"))
    kept = sources.where(~F.arrays_overlap(F.split(rel, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS])))
    text = F.col("text")
    pkg = F.when(text.rlike(PACKAGE_RE), F.regexp_extract(text, PACKAGE_RE, 1))
    stem = F.regexp_replace(F.substring_index(F.col("source_path"), "/", -1), r"\.[^.]*$", "")
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    unterminated = F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
    return kept.select(
        "repo_label", "repo_path", "repo_order", "source_path",
        pkg.alias("package"), stem.alias("class_name"),
        F.when(pkg.isNotNull(), F.concat(pkg, F.lit("."), stem)).otherwise(stem).alias("fqcn"),
        (newlines + unterminated).cast("long").alias("line_count"))


def class_index(sources: DataFrame) -> DataFrame:
    """C1 + A9: one row per (repository, fqcn); the smallest path wins."""
    files = indexed_files(sources)
    return (files.groupBy("repo_label", "repo_path", "repo_order", "fqcn")
            .agg(F.min_by(F.struct("source_path", "line_count"), F.col("source_path")).alias("f"))
            .select("repo_label", "repo_path", "repo_order", "fqcn",
                    F.col("f.source_path").alias("source_path"), F.col("f.line_count").alias("line_count")))


def repo_stats(sources: DataFrame) -> DataFrame:
    """Files scanned (duplicates included) and distinct classes per repo."""
    return (indexed_files(sources).groupBy("repo_label", "repo_order")
            .agg(F.count(F.lit(1)).alias("file_count"), F.count_distinct("fqcn").alias("class_count")))


# ----------------------------------------------------------------- J1 / C3 / C4

def _prefixes(s: Column) -> Column:
    """Every non-empty prefix of ``s`` (shortest first)."""
    n = F.length(s)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(s, 1, k))) \
        .otherwise(F.array().cast("array<string>"))


def longest_prefix_match(keys: DataFrame, key: str, mapping: DataFrame, prefix: str,
                         value: str) -> DataFrame:
    """``(key, value, matched_prefix)`` for each distinct ``key``: the value
    of the longest mapping prefix the key starts with (not dot-bounded);
    null when none.  Duplicate prefixes in ``mapping`` keep the smallest value."""
    m = mapping.groupBy(F.col(prefix).alias("_prefix")).agg(F.min(value).alias("_value"))
    distinct_keys = keys.select(F.col(key).alias("_k")).distinct()
    # one row per (key, prefix); a left join keeps keys without any match,
    # whose best is then null (rows with a null ordering are ignored)
    cand = distinct_keys.select("_k", F.explode_outer(_prefixes(F.col("_k"))).alias("_prefix"))
    best = (cand.join(m, "_prefix", "left")
            .groupBy("_k")
            .agg(F.max_by(F.struct("_value", "_prefix"),
                          F.when(F.col("_value").isNotNull(), F.length("_prefix"))).alias("_best")))
    return best.select(F.col("_k").alias(key), F.col("_best._value").alias(value),
                       F.col("_best._prefix").alias("matched_prefix"))


def resolve_package(packages: DataFrame, package_map: DataFrame, column: str = "package") -> DataFrame:
    """``(package, repo, matched_prefix)``; the package text is stripped."""
    p = packages.select(py_strip(F.col(column)).alias("package"))
    return longest_prefix_match(p, "package", package_map, "prefix", "repo")


def packages_of_repo(package_map: DataFrame, repos: DataFrame) -> DataFrame:
    """The package prefixes mapped to each repo in ``repos(repo)``."""
    return package_map.join(repos.select("repo").distinct(), "repo").select("repo", "prefix")


def feature_repos(features: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """C4: ``(keyword, repo)`` rows; restricted to ``keywords(keyword)`` when given."""
    f = features if keywords is None else features.join(keywords.select("keyword").distinct(), "keyword")
    return f.select("keyword", F.posexplode("repos").alias("repo_pos", "repo"))


# ----------------------------------------------------------------- J2

def normalised_class(cls) -> Column:
    """Inner, anonymous and lambda classes map to their outer class
    (``Foo$$Lambda$1``, ``Foo$Inner``, ``Foo$1`` -> ``Foo``)."""
    c = F.col(cls) if isinstance(cls, str) else cls
    return F.substring_index(c, "$", 1)


def class_candidates(keys: DataFrame) -> DataFrame:
    """For ``keys(package, class_name)``: the look-up keys in priority order,
    exact FQCN (0) then the normalised one (1) when different."""
    exact = F.concat(F.col("package"), F.lit("."), F.col("class_name"))
    norm = F.concat(F.col("package"), F.lit("."), normalised_class("class_name"))
    arr = F.when(exact == norm, F.array(F.struct(exact.alias("fqcn"), F.lit(0).alias("prio")))) \
        .otherwise(F.array(F.struct(exact.alias("fqcn"), F.lit(0).alias("prio")),
                           F.struct(norm.alias("fqcn"), F.lit(1).alias("prio"))))
    return keys.select("package", "class_name", F.explode(arr).alias("c")) \
        .select("package", "class_name", "c.fqcn", "c.prio")


def lookup_class(keys: DataFrame, index: DataFrame) -> DataFrame:
    """J2 + J3's repo rule: per ``(package, class_name)``, the indexed class of
    the first repository (registration order) that has the exact or the
    normalised FQCN; inside one repository the exact name wins."""
    cand = class_candidates(keys.select("package", "class_name").distinct())
    hits = cand.join(index, "fqcn")
    best = hits.groupBy("package", "class_name").agg(
        F.min_by(F.struct("repo_label", "repo_path", "source_path", "fqcn"),
                 F.struct("repo_order", "prio")).alias("hit"))
    return best.select("package", "class_name", F.col("hit.repo_label").alias("repo_label"),
                       F.col("hit.repo_path").alias("repo_path"),
                       F.col("hit.source_path").alias("source_path"),
                       F.col("hit.fqcn").alias("indexed_fqcn"))
