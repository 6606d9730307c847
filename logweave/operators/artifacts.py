"""Jar artifacts and versions.

Look-ups are equi-joins on generated keys, never theta joins: every prefix
(J7 step 2) or every gram (J7 step 3, artifact ids filed under their rarest
gram) of each *distinct* package is generated and joined on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.codeindex import longest_prefix_match

# The jar file-name shape, the tag normalisation rule and the
# default organisation order.
JAR_RE = r"(?U)^(.+?)[-_](\d[\d.]*(?:[A-Za-z][A-Za-z0-9.]*)?)(?:_(\d+))?\.jar$"
WSO2V_RE = r"(\d)\.wso2v"
WSO2V_REPL = "$1-wso2v"
DEFAULT_ORGS = ["wso2", "wso2-extensions"]


def scan_artifacts(paths: DataFrame, column: str = "path", keep=()) -> DataFrame:
    """``(artifact_id, version, path, *keep)`` for every jar name matching
    the artifact rule; ``version = base[.patch]``."""
    name = F.substring_index(F.col(column), "/", -1)
    hit = name.rlike(JAR_RE)
    base = F.regexp_extract(name, JAR_RE, 2)
    patch = F.regexp_extract(name, JAR_RE, 3)
    return paths.where(hit).select(
        F.regexp_extract(name, JAR_RE, 1).alias("artifact_id"),
        F.when(patch != "", F.concat(base, F.lit("."), patch)).otherwise(base).alias("version"),
        F.col(column).alias("path"), *keep)


def artifact_versions(artifacts: DataFrame) -> DataFrame:
    """A10: one version per artifact, from the smallest path."""
    return (artifacts.groupBy("artifact_id")
            .agg(F.min_by(F.struct("version", "path"), F.col("path")).alias("a"))
            .select("artifact_id", F.col("a.version").alias("version"), F.col("a.path").alias("path")))


#: Length of the grams that ids are found by.
GRAM = 5


def _grams(s: Column, lengths: Column) -> Column:
    """Distinct substrings of ``s`` of each of ``lengths``."""
    def of(n: Column) -> Column:
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n))
                      ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def contained_ids(packages: DataFrame, ids: DataFrame, gram: int = GRAM) -> DataFrame:
    """(package, artifact_id, ...) of every pair whose lower-cased id is part of the lower-cased package, for distinct
    ``packages(package)`` and ``ids(artifact_id, ...)``.

    An id is found by one of its grams (of ``gram`` characters, or itself if it is shorter): that which the fewest
    packages hold.  A package emits its grams, a number in proportion to its length, fetches the ids that are filed under
    them and looks for those whole.  Ids with a gram that no package holds are not filed at all."""
    low = packages.select("package", F.lower("package").alias("_low"))
    held = low.select("package", "_low", F.explode(_grams(F.col("_low"), F.sequence(F.lit(1), F.lit(gram)))).alias("_gram"))
    frequency = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = F.array(F.least(F.length("_id"), F.lit(gram)))
    filed = (ids.withColumn("_id", F.lower("artifact_id")).where("_id <> ''").withColumn("_own", _grams(F.col("_id"), own))
             .select("*", F.size("_own").alias("_size"), F.explode("_own").alias("_gram")).drop("_own"))
    columns = [*ids.columns, "_id", "_size"]
    rarest = (filed.join(frequency, "_gram").groupBy(*columns).agg(F.min(F.struct("_n", "_gram")).alias("_r"), F.count(F.lit(1)).alias("_found"))
              .where("_found = _size").select(*ids.columns, "_id", F.col("_r._gram").alias("_gram")))
    return held.join(rarest, "_gram").where(F.col("_low").contains(F.col("_id"))).select("package", *ids.columns)


def resolve_artifact_version(packages: DataFrame, overrides: DataFrame, jar_map: DataFrame,
                             column: str = "package") -> DataFrame:
    """``(package, artifact_id, version, rule)`` per distinct package.

    1/2. the longest override prefix of the package (an exact key is the
         longest one), used only if its artifact is in ``jar_map``;
    3.   else the longest artifact id whose lower case is a substring of the
         package's lower case (ties: smallest artifact id).
    ``overrides(prefix, artifact_id)``, ``jar_map(artifact_id, version)``.
    """
    pk = packages.select(F.col(column).alias("package")).distinct()
    jm = jar_map.select("artifact_id", "version")

    step2 = (longest_prefix_match(pk, "package", overrides, "prefix", "artifact_id")
             .join(jm, "artifact_id")
             .select("package", F.col("artifact_id").alias("a2"), F.col("version").alias("v2")))

    step3 = (contained_ids(pk.join(step2, "package", "left_anti"), jm)
             .groupBy("package")
             .agg(F.min_by(F.struct("artifact_id", "version"), F.struct(-F.length("artifact_id"), F.col("artifact_id"))).alias("b"))
             .select("package", F.col("b.artifact_id").alias("a3"), F.col("b.version").alias("v3")))
    out = pk.join(step2, "package", "left").join(step3, "package", "left")
    return out.select(
        "package",
        F.coalesce("a2", "a3").alias("artifact_id"),
        F.coalesce("v2", "v3").alias("version"),
        F.when(F.col("a2").isNotNull(), F.lit("override"))
        .when(F.col("a3").isNotNull(), F.lit("fuzzy")).alias("rule"))


def tag_candidates(version) -> Column:
    """Candidate release tags of a version, in trial order, duplicates
    removed: ``v{base}``, ``base``, ``v{norm}``, ``norm`` with ``base`` the
    version without a leading 'v' and ``norm`` = base with ``N.wso2v`` ->
    ``N-wso2v``."""
    v = F.col(version) if isinstance(version, str) else version
    base = F.when(v.startswith("v"), F.substring(v, 2, 1 << 30)).otherwise(v)
    norm = F.regexp_replace(base, WSO2V_RE, WSO2V_REPL)
    return F.array_distinct(F.array(F.concat(F.lit("v"), base), base, F.concat(F.lit("v"), norm), norm))


def match_release_tags(versions: DataFrame, tags: DataFrame, orgs: list[str] = DEFAULT_ORGS) -> DataFrame:
    """For ``versions(repo, version)`` the release tag to check out:
    organisations in ``orgs`` order, candidate tags in trial order, first
    existing ``tags(org, repo, tag)`` wins.  Unmatched versions get nulls."""
    v = versions.select("repo", "version").distinct()
    cand = v.select("repo", "version", F.posexplode(tag_candidates("version")).alias("cand_pos", "tag"))
    rank = F.array_position(F.array(*[F.lit(o) for o in orgs]), F.col("org"))
    # duplicates of a tag (many jars of one artifact) are collapsed map-side first
    t = tags.select("org", "repo", "tag").where(rank > 0).distinct().withColumn("org_rank", rank)
    hits = (cand.join(t, ["repo", "tag"])
            .groupBy("repo", "version")
            .agg(F.min_by(F.struct("org", "tag"), F.struct("org_rank", "cand_pos")).alias("m")))
    return (v.join(hits, ["repo", "version"], "left")
            .select("repo", "version", F.col("m.org").alias("org"), F.col("m.tag").alias("tag")))
