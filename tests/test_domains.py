"""Registrable domains by public-suffix rules."""

import pytest
from pyspark.sql import functions as F

from matricula.operators import directory as R
from matricula.operators import domains as D

LIST = """// comment
com
edu.pl   trailing words are no part of a rule

pl
*.ck
!www.ck
*.kobe.jp
!city.kobe.jp
jp
*
UK
ac.uk
"""


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "list.dat"
    path.write_text(LIST)
    return D.read_suffix_rules(spark, str(path))


CASES = [
    ("a.b.example.com", "com", "example.com"), ("uw.edu.pl", "edu.pl", "uw.edu.pl"), ("math.uw.edu.pl", "edu.pl", "uw.edu.pl"),
    ("pw.edu.pl", "edu.pl", "pw.edu.pl"), ("edu.pl", "edu.pl", None), ("pl", "pl", None), ("x.town.ck", "town.ck", "x.town.ck"),
    ("town.ck", "town.ck", None), ("ck", "ck", None), ("a.www.ck", "ck", "www.ck"), ("www.ck", "ck", "www.ck"),
    ("b.port.kobe.jp", "port.kobe.jp", "b.port.kobe.jp"), ("a.b.port.kobe.jp", "port.kobe.jp", "b.port.kobe.jp"),
    ("x.city.kobe.jp", "kobe.jp", "city.kobe.jp"), ("kobe.jp", "jp", "kobe.jp"), ("a.b.unlisted", "unlisted", "b.unlisted"),
    ("localhost", "localhost", None), ("10.0.0.7", None, None), ("[::1]", None, None), ("ox.ac.uk", "ac.uk", "ox.ac.uk"),
]


def test_rules_decide(spark, rules):
    hosts = spark.createDataFrame([(h,) for h, *_ in CASES] * 2 + [(None,)], "host string")
    got = {r.host: (r.suffix, r.domain) for r in D.registrable(hosts, rules).collect()}
    assert got == {h: (s, d) for h, s, d in CASES}


def test_lines_become_rules(rules):
    assert {tuple(r) for r in rules.collect()} == {
        ("com", 0), ("edu.pl", 0), ("pl", 0), ("ck", 1), ("www.ck", -1), ("kobe.jp", 1), ("city.kobe.jp", -1), ("jp", 0), ("uk", 0), ("ac.uk", 0)}


@pytest.mark.parametrize("url,host", [
    ("https://Me:pw@WWW.X.edu:8080/a@b", "www.x.edu"), ("x.edu/a", "x.edu"), ("//x.edu", "x.edu"), ("https://x.edu.", "x.edu"),
    ("https://[::1]:80/", "[::1]"), ("https:///path", None), ("", None), (None, None)])
def test_hosts(one, url, host):
    assert one(D.host(F.lit(url).cast("string"))) == (host,)


def test_links_of_one_site(spark, rules):
    links = [("https://www.bard.edu.pl/f", "https://math.bard.edu.pl/p", True), ("https://bard.edu.pl/", "https://other.edu.pl/", False),
             ("http://10.0.0.1/a", "http://10.0.0.1/b", True), ("http://10.0.0.1/a", "http://10.0.0.2/b", False),
             ("https://edu.pl/", "https://edu.pl/x", True), ("https://a.town.ck", "https://b.town.ck", False),
             ("https://a.www.ck", "https://b.www.ck", True), ("https://x.com", None, False), ("https://x.com", "/relative", False)]
    table = spark.createDataFrame([(p, h, i) for i, (p, h, _) in enumerate(links)], "page_url string, href string, pos int")
    assert {r.pos for r in R.same_domain(table, rules).collect()} == {i for i, (*_, keep) in enumerate(links) if keep}


def test_distinct_hosts_meet_rules_in_an_equi_join(spark, rules):
    hosts = spark.range(10).select(F.concat(F.lit("h"), "id", F.lit(".edu.pl")).alias("host"))
    plan = D.registrable(hosts, rules)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
