import pytest
from pyspark.sql import functions as F

from lodestar.llm.host_reputation import UrlRule, judge, parsed, reputation
from lodestar.llm.registry import URL_RULES

URLS = {
    "http://A.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://example.net/de/1?x=/en/": ("example.net", "/de/1", "net/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
    "http://b.example.com/de/7#top": ("b.example.com", "/de/7", "example.com/de/", "block"),
    "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
    "http://x.net": ("x.net", "", None, None),
    "http://x.net?/": ("x.net", "", None, None),
    "x://y://z/q": ("y:", "//z/q", None, None),
    "no scheme": ("", "", None, None),
    "http://line\nbreak.net/a\nb?c": ("line\nbreak.net", "/a\nb", "net/", "block"),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def test_parsing_and_rules(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, good int")
    got = {r["url"]: r for r in judge(pages, none, URL_RULES).collect()}
    for url, (host, path, rule, verdict) in URLS.items():
        r = got[url]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert verdict is None or r["verdict"] == verdict


def test_good_hosts_pass_and_bad_ones_do_not(spark):
    rows = [("good.a.com", 1)] * 200 + [("bad.a.com", 0)] * 200 + [("few.a.com", 0)] * 2 + [("other.org", 1)] * 50 + [("x.other.org", 1)] * 9 + [(None, 1), ("good.a.com", None)]
    outcomes = spark.createDataFrame(rows, "host string, good int")
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate(["good.a.com", "bad.a.com", "x.other.org"])], "page_id long, url string")
    got = {r["host"]: r for r in judge(pages, outcomes, []).collect()}
    assert [got[h]["verdict"] for h in ("good.a.com", "bad.a.com", "x.other.org")] == ["allow", "block", "allow"]
    table = {r["host"]: r for r in reputation(outcomes)[0].collect()}
    assert 0 < table["few.a.com"]["mean"] < 0.75 and table["bad.a.com"]["mean"] < 0.05  # little evidence is shrunk more
    assert table["good.a.com"]["n"] == 200


def test_unseen_hosts_are_judged_by_their_domain_then_their_suffix(spark):
    rows = [(f"{k}.good.com", 1) for k in range(9) for _ in range(60)] + [(f"{k}.bad.com", 0) for k in range(9) for _ in range(60)]
    rows += [(f"h.{k}.fine", 1) for k in range(9) for _ in range(60)] + [(f"h.{k}.poor", 0) for k in range(9) for _ in range(60)]
    outcomes = spark.createDataFrame(rows, "host string, good int")
    hosts = {"new.good.com": "allow", "new.bad.com": "block", "new.new.fine": "allow", "new.new.poor": "block"}
    pages = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate([*hosts, "0.good.com"])], "page_id long, url string")
    got = {r["host"]: r for r in judge(pages, outcomes, []).collect()}
    assert {h: got[h]["verdict"] for h in hosts} == hosts
    assert {got[h]["n_outcomes"] for h in hosts} == {0} and got["0.good.com"]["n_outcomes"] == 60
    assert got["new.bad.com"]["bound"] < got["new.good.com"]["bound"] < got["0.good.com"]["bound"]


def test_ties_go_to_the_longer_rule_then_by_text(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, good int")
    r = judge(pages, none, [UrlRule("allow", "c/x/y"), UrlRule("block", "b.c/x"), UrlRule("block", "c/")]).first()
    assert (r["rule"], r["verdict"]) == ("c/x/y", "allow")


def test_clashing_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x", "y")], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "host string, good int")
    assert judge(pages, none, URL_RULES).first()["host"] == "a.b"
    assert judge(pages.limit(0), none, URL_RULES).count() == 0
    assert parsed(pages).filter(F.col("host") == "a.b").count() == 1


@pytest.mark.parametrize("copies", [1, 3])
def test_repeated_pages_are_judged_each(spark, copies):
    pages = spark.createDataFrame([(1, "http://a.net/")] * copies, "page_id long, url string")
    assert judge(pages, spark.createDataFrame([], "host string, good int"), URL_RULES).count() == copies
