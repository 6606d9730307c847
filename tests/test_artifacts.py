"""C2, A10, J7, J8, C3, C4, S7."""
import json
import random

from logweave.operators import artifacts as AR
from logweave.operators import codeindex as CI


def test_scan_and_versions(spark):
    made = {f"lib/{k:02d}/{name}{sep}{version}.jar": (name, version) for k, (name, sep, version) in enumerate([
        ("ferry.deck", "_", "3.1.4"), ("ferry.hold-pump", "-", "0.9.0"), ("winch", "-", "12"), ("crane_arm", "_", "7.0.0")])}
    other = ["lib/x/manual.txt", "lib/x/noversion.jar", "lib/99/winch-13.jar"]  # the smallest path wins
    df = spark.createDataFrame([(p,) for p in [*other, *made]], "path string")
    got = {r.artifact_id: r.version for r in AR.artifact_versions(AR.scan_artifacts(df)).collect()}
    assert got == dict(made.values())


def test_resolve_version(spark):
    jars = spark.createDataFrame([("ferry.hold.pump", "0.9.0"), ("pump", "1.1"), ("crane-arm", "7.0")], "artifact_id string, version string")
    overrides = spark.createDataFrame([("crane.c", "crane-arm"), ("crane.c.lost", "not-built")], "prefix string, artifact_id string")
    asked = {"ferry.hold.pump.valve": ("ferry.hold.pump", "0.9.0", "fuzzy"), "crane.c.hook": ("crane-arm", "7.0", "override"),
             "island.map": (None, None, None), "crane.c.lost.pin": (None, None, None)}
    pk = spark.createDataFrame([(p,) for p in asked], "package string")
    assert {r.package: (r.artifact_id, r.version, r.rule) for r in AR.resolve_artifact_version(pk, overrides, jars).collect()} == asked


def test_contained_ids_equal_brute_force(spark):
    """Random ids over few letters: many contain each other, some are shorter than a gram, some occur in no package."""
    rng = random.Random(12)
    word = lambda low, high: "".join(rng.choice("abAB.é") for _ in range(rng.randint(low, high)))
    ids = sorted({word(1, 9) for _ in range(150)} | {"", "zz", "abab", "ABAB"})
    packages = sorted({word(0, 30) for _ in range(120)})
    jars = spark.createDataFrame([(a, f"v{k}") for k, a in enumerate(ids)], "artifact_id string, version string")
    asked = spark.createDataFrame([(p,) for p in packages], "package string")
    want = sorted((p, a) for p in packages for a in ids if a and a.lower() in p.lower())
    for gram in (1, 3, 5):
        assert sorted((r.package, r.artifact_id) for r in AR.contained_ids(asked, jars, gram).collect()) == want
    none = spark.createDataFrame([], "prefix string, artifact_id string")
    got = {r.package: r.artifact_id for r in AR.resolve_artifact_version(asked, none, jars).collect()}
    assert got == {p: min((a for q, a in want if q == p), key=lambda a: (-len(a), a), default=None) for p in packages}


def test_few_candidates_are_fetched(spark):
    """Ids share all but a few of their grams: the rarest gram fetches next to nothing but the answers."""
    ids = [f"harbour.crane.part{k:03d}" for k in range(200)]
    jars = spark.createDataFrame([(a, "1") for a in ids], "artifact_id string, version string")
    asked = spark.createDataFrame([(f"org.{a}.sub",) for a in ids], "package string")
    hits = AR.contained_ids(asked, jars)
    assert hits.count() == 200
    fetched = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in fetched and "CartesianProduct" not in hits._jdf.queryExecution().executedPlan().toString()


def test_tag_candidates_and_match(spark):
    df = spark.createDataFrame([("v12.3.wso2v7",), ("1.2",)], "v string")
    got = [r[0] for r in df.select(AR.tag_candidates("v")).collect()]
    assert got == [["v12.3.wso2v7", "12.3.wso2v7", "v12.3-wso2v7", "12.3-wso2v7"], ["v1.2", "1.2"]]
    versions = spark.createDataFrame([("syn", "12.3.wso2v7"), ("k", "1.2"), ("z", "9")], "repo string, version string")
    tags = spark.createDataFrame([("org-b", "syn", "v12.3.wso2v7"), ("org-a", "syn", "12.3-wso2v7"),
                                  ("org-a", "k", "1.2"), ("org-b", "k", "v1.2"), ("other", "z", "9")],
                                 "org string, repo string, tag string")
    got = {r.repo: (r.org, r.tag) for r in AR.match_release_tags(versions, tags, ["org-a", "org-b"]).collect()}
    assert got == {"syn": ("org-a", "12.3-wso2v7"), "k": ("org-a", "1.2"), "z": (None, None)}


def test_dims_from_json(spark, tmp_path):
    p = tmp_path / "features.json"
    p.write_text(json.dumps({"_comment": "x", "mooring": ["pier-ropes"], "tide": ["a", "b"]}))
    f = CI.load_features_json(spark, str(p))
    got = {(r.keyword, r.repo_pos, r.repo) for r in CI.feature_repos(f).collect()}
    assert got == {("mooring", 0, "pier-ropes"), ("tide", 0, "a"), ("tide", 1, "b")}
    m = tmp_path / "map.json"
    m.write_text(json.dumps({"_comment": "c", "org.a": "r1", "org.b": "r2"}))
    pm = CI.load_map_json(spark, str(m), "prefix", "repo")
    assert sorted(tuple(r) for r in pm.collect()) == [("org.a", "r1"), ("org.b", "r2")]
    repos = spark.createDataFrame([("r2",)], "repo string")
    assert [tuple(r) for r in CI.packages_of_repo(pm, repos).collect()] == [("r2", "org.b")]
