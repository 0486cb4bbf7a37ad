"""URL filter against a plain search of all rules."""

import random
import re

import pytest

from matricula.llm import url_filter as U

RULE = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", tail).groups()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), -((h + p).find("/") + 1), h + p, v) for h, p, v in rules
            if h and p is not None and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, urls, rules, **settings):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int").repartition(3)
    table = spark.createDataFrame(rules, RULE)
    out = U.judge_urls(pages, table, **settings)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(urls)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


URLS = [
    None, "", "no scheme", "http://", "http:///en/x", "https://Example.COM/en/a?q#f", "https://www.example.com/en/", "https://wwwexample.com/en/",
    "https://a.b.example.com/en/", "https://example.com/EN/", "https://example.com/en", "https://example.com#/en/", "https://example.com?/en/",
    "ftp://x.net/es/1", "https://x.net/es", "https://net/fr/", "https://É.net/fr/é", "https://a..com/", "https://example.com:80/en/", "x://com/x://net/es/",
]


def test_stated_rules(spark):
    got = judged(spark, URLS, list(U.RULES))
    assert got == {i: plain(u, U.RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("blocks", [1, U.MAX_BLOCKS])
def test_many_rules_hot_urls_and_false_positives(spark, monkeypatch, blocks):
    """With one block nearly every key passes the filter, and the join removes what is not listed."""
    monkeypatch.setattr(U, "MAX_BLOCKS", blocks)
    draw = random.Random(blocks)
    host = lambda: ".".join(draw.choice("abcde") for _ in range(draw.randint(1, 4)))
    path = lambda: "".join("/" + draw.choice(("p", "q", "rr")) for _ in range(draw.randint(0, 3)))
    rules = list({(h, p): (h, p, draw.choice(("allow", "block"))) for h, p in ((host(), path()) for _ in range(800))}.values())
    urls = [f"http://{host()}{path()}{draw.choice(('', '?x', '#y', '/tail'))}" for _ in range(600)] + ["http://a.b.c/p/q"] * 300
    got = judged(spark, urls, rules, default="unknown")
    assert got == {i: plain(u, rules, "unknown") for i, u in enumerate(urls)}


def test_long_urls(spark):
    urls = ["https://" + "a." * 3000 + "com/en/" + "x" * 50_000, "https://net/" + "es/" * 10_000]
    assert judged(spark, urls, list(U.RULES)) == {i: plain(u, U.RULES) for i, u in enumerate(urls)}


def test_odd_rules(spark):
    """Null and empty parts are ignored; of equal rules the larger verdict counts."""
    rules = [(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("b.com", "", "block")]
    urls = ["http://a.com/x", "http://a.com/", "http://b.com", "http://c.b.com/y", "http:///"]
    assert judged(spark, urls, rules) == {
        0: ("a.com", "/x", "a.com/x", "block"), 1: ("a.com", "/", None, "allow"), 2: ("b.com", "", "b.com", "block"),
        3: ("c.b.com", "/y", "b.com", "block"), 4: ("", "/", None, "allow")}


def test_empty_list_and_empty_table(spark):
    assert {v[3] for v in judged(spark, URLS, [], default="block").values()} == {"block"}
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(pages, spark.createDataFrame(list(U.RULES), RULE)).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = U.judge_urls(pages, spark.createDataFrame(list(U.RULES), RULE))._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan
