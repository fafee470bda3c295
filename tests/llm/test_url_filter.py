"""Url verdicts against plain Python, and the cascade against plain membership."""

import random

import pytest
from pyspark.sql import functions as F

from eventspark.llm import url_filter as uf

URLS = [
    None,
    "",
    "no scheme/here",
    "http://",
    "https://Example.ORG/en/1?x#y",
    "https://a.example.org/en/2",
    "https://notexample.org/es/1",
    "http://example.org/es/#top",
    "http://example.com#://bad.net/",
    "http://x.spam-farm.example.com/fr/1",
    "http://x.spam-farm.example.com/en",
    "http://x.spam-farm.example.com/en",
    "http://spam-farm.example.com.",
    "odd\nline://HÖST.com/de/\nx?q",
    "http://host.com/" + "a" * 100_000,
]


def plain(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.name), len(r.host)))
        return host, path, best.name, best.verdict
    labels = host.split(".") if host else []
    inside = any(".".join(labels[i:]) in listed for i in range(len(labels)))
    return host, path, None, "block" if inside else "allow"


def frame(spark, urls):
    rows = [(i, u, 1, 2, "c") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, key int, listed int, host string")


@pytest.mark.parametrize("max_keys", [1, 1000])
def test_judge(spark, max_keys):
    listed = ["spam-farm.example.com", "bad.net", None, "host.com", "host.com", "unknown.test", "höst.com"]
    names = spark.createDataFrame([(x,) for x in listed], "key string")
    out = uf.judge(frame(spark, URLS), uf.RULES, names, max_keys=max_keys)
    assert sorted(out.columns) == sorted(["page_id", "url", "key", "listed", "host", "path", "rule", "verdict"])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: plain(u, uf.RULES, set(listed)) for i, u in enumerate(URLS)}
    assert {r.key for r in out.collect()} == {1}


def test_longest_rule_wins_and_ties_go_to_the_longer_host(spark):
    rules = [uf.Rule("allow", "com", "/abc/"), uf.Rule("block", "a.com", "/ab"), uf.Rule("allow", "b.a.com", "")]
    urls = ["http://a.com/abc/", "http://x.com/abc/", "http://b.a.com/ab", "http://b.a.com/", "http://a.com/a"]
    none = spark.createDataFrame([], "key string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.judge(frame(spark, urls), rules, none).collect()}
    assert got == {i: plain(u, rules, set())[2:] for i, u in enumerate(urls)}
    assert {r.verdict for r in uf.judge(frame(spark, urls), [], none).collect()} == {"allow"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "key string")
    assert uf.judge(frame(spark, []), uf.RULES, none).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 0.97, 1.0])
def test_cascade_is_exact_on_its_universe(spark, share):
    r = random.Random(int(share * 100))
    keys = [(f"k{i}.example", r.random() < share) for i in range(20_000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean").cache()
    levels = uf.cascade(universe)
    assert universe.filter(uf.member(levels, F.col("key")) != F.col("listed")).count() == 0
    assert (len(levels) > 2) == (0 < share < 1)
    if share == 0.01:
        # far fewer bits than the keys need as hashes
        assert sum(x.bits for x in levels) < 20 * sum(x[1] for x in keys)


def test_listed_urls_need_no_join_and_no_python(spark, capsys):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    uf.judge(pages, uf.RULES, uf.listed_domains(pages)).explain()
    plan = capsys.readouterr().out
    main = plan.split("Subquery")[0] if plan.startswith("Subquery") else plan
    assert "Join" not in main and "Python" not in plan and "Arrow" not in plan
