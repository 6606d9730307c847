"""URL filters against every rule tried on every URL."""
import random
import re

from logweave.llm import url_filters as U
from logweave.llm.queries import URL_RULES

RULES = [*URL_RULES, U.Place("a.b", "/x", "block"), U.Place("b", "/x/yy", "allow"), U.Place("b", "/x/zz", "block"), U.Pattern("ads*.track/"),
         U.Pattern("||ab"), U.Pattern(".Good-*/")]


def plain_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if isinstance(r, U.Place) and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict, r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    hit = False
    for r in rules:
        if isinstance(r, U.Pattern):
            body = "[\\s\\S]*".join(re.escape(p.lower()) for p in r.text.removeprefix("||").split("*"))
            hit |= bool(re.search((r"^(?:[^/]*\.)?" if r.text.startswith("||") else "") + body, (host + path).lower()))
    return host, path, None, "block" if hit else "allow"


def test_matches_every_rule_tried(spark):
    rng = random.Random(8)
    parts = ["example", "org", "com", "a", "b", "casino-win", "free-bets", "ads1.track", "ab", "EN", "good-x", "orgx", "ünï"]
    urls = [None, "", "no scheme", "://", "http://", "https://ORG/", "http://org", "x://org?/", "http://a.b/x\n", "http://b/x/yy#z", "http://xorg/"]
    for _ in range(400):
        host = ".".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
        path = "".join("/" + rng.choice(["en", "es", "fr", "de", "1", "11", "x", "yy", "zz", "track", ""]) for _ in range(rng.randrange(4)))
        urls.append(f"http://{host}{path}" + rng.choice(["", "?q=://org/", "#org"]))
    urls += urls[:30]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, RULES).collect()), key=str)
    assert got == sorted(((i if i % 50 else None, *plain_judge(u, RULES)) for i, u in enumerate(urls)), key=str)
    assert {r.verdict for r in U.judge(pages, []).collect()} == {"allow"} and U.judge(pages.limit(0), RULES).count() == 0


def test_safe_tokens_are_whole():
    tokens = {r["rule"]: r["tokens"] for r in map(U.compile_rule, RULES)}
    assert tokens["example.org/en/1"] == ["en", "example", "org"] and tokens["org/"] == ["org"] and tokens["||ab"] == []
    assert tokens["||casino-*."] == ["casino"] and tokens["ads*.track/"] == ["track"] and tokens[".Good-*/"] == ["good"]
