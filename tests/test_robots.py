"""Robots texts against a plain reading of their rules."""

import random
import re

import pytest

from cardamom.sources import robots

TEXT = "\ufeffUser-agent: a\nUser-agent: b\nDisallow: /x # no\n\nAllow : /x/y\nnonsense\nUser-agent:*\nDisallow: /\nCrawl-delay: 10\nUser-agent: abc/2\nDisallow:\nDisallow: /q\nCrawl-delay: soon\nCrawl-delay: 0.5\nCrawl-delay: 9\nuser-agent: A\nDisallow: /late"


@pytest.mark.parametrize(
    ("agent", "rules", "delay"),
    [("A/1.0", {("/x", False), ("/x/y", True), ("/late", False)}, None), ("b", {("/x", False), ("/x/y", True)}, None), ("abcd", {("/q", False)}, 2.0), ("other", {("/", False)}, 10.0), ("", {("/", False)}, 10.0)],
)
def test_groups_of_agents(spark, agent, rules, delay):
    texts = spark.createDataFrame([("h", TEXT), ("none", None), ("empty", ""), ("r", "Disallow: /early\rUser-agent: *\rDisallow: /r")], "host string, body string")
    got = robots.robots_rules(texts, agent).collect()
    assert {(r["pattern"], r["allow"]) for r in got if r["host"] == "h"} == rules
    assert {(r["host"], r["pattern"]) for r in got if r["host"] != "h"} == {("r", "/r")}
    assert {r["host"]: r["delay"] for r in robots.crawl_delays(texts, agent).collect()} == ({"h": delay} if delay else {})


def plain(path, rules):
    best = (0, True)
    for pattern, allow in rules:
        body = pattern.removesuffix("$")
        regex = ".*".join(map(re.escape, re.split(r"\*+", body)))
        if re.compile(regex + ("$" if body != pattern else ""), re.S).match(path) and (len(pattern), allow) > best:
            best = (len(pattern), allow)
    return best[1]


def test_patterns_equal_plain_matching(spark):
    rnd = random.Random(8)
    hosts = {f"h{i}": list({"/" + "".join(rnd.choice("ab/?*") for _ in range(rnd.randint(0, 5))) + rnd.choice(["", "", "$", "*$", "*"]): rnd.random() < 0.5 for _ in range(9)}.items()) for i in range(6)}
    hosts["h0"].append(("*b", False))
    paths = [(h, "/" + "".join(rnd.choice("ab/?") for _ in range(rnd.randint(0, 9)))) for h in [*hosts, "free"] for _ in range(80)]
    rules = spark.createDataFrame([(h, p, a) for h, of in hosts.items() for p, a in of], "host string, pattern string, allow boolean")
    requests = spark.createDataFrame([*paths, (None, "/a"), ("h1", None), ("h1", "")], "host string, path string")
    got = robots.permitted(requests, rules).collect()
    assert len(got) == len(paths) + 3
    for r in got:
        assert r["allowed"] == (plain(r["path"], hosts.get(r["host"], [])) if r["path"] is not None else True), r


def test_a_long_path_makes_few_rows(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/b", True), ("h", "/abc*d", True)], "host string, pattern string, allow boolean")
    requests = spark.createDataFrame([("h", "/abc" + "x" * 5000 + "d")], "host string, path string")
    df = robots.permitted(requests, rules)
    assert df.first()["allowed"] and "sequence(1" not in df._jdf.queryExecution().optimizedPlan().toString()
