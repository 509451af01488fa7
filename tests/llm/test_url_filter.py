"""URL judgements against a direct reading of the rules, and against SQL."""

import random

import duckdb
import pytest

from yearweave.errors import ParameterFailure
from yearweave.llm.url_filter import ORACLE, judged, op1_url_filter

RULES = [
    ("org/", "allow"), ("b.org/", "block"), ("a.org/en/1", "allow"), ("a.com/a", "block"),
    ("com/", "block"), ("com/", "allow"), ("com/", "block"), ("b.com/en/1", "block"),
    (None, "block"), ("nopath", "block"), ("É/", "block"), ("A.a/", "block"), ("x/", None),
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    best = None
    for rule, verdict in rules:
        if rule and "/" in rule and verdict:
            rule_host, _, tail = rule.partition("/")
            rule_host = "".join(c.lower() if c.isascii() else c for c in rule_host)
            if host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + tail):
                key = (len(rule), len(rule_host), verdict, rule)
                best = max(best, key) if best else key
    return (host, path, best[3], best[2]) if best else (host, path, None, default)


def test_rules_against_a_plain_reading(spark):
    rnd = random.Random(3)
    urls = [None, "", "x", "://", "http://", "http://a.b", "HTTP://A.B.org?x", "http://é.org/É", "a://b://c/d"]
    urls += ["http://org/", "http://.org/x", "http://b.org./", "http://org", "http://x.org#/"]
    urls += ["http://" + "a." * 300 + "org/" + "y/" * 3000]
    for _ in range(200):
        host = ".".join(rnd.choice(["a", "b", "org", "com", "É", "A"]) for _ in range(rnd.randint(1, 4)))
        path = "/".join(rnd.choice(["a", "en", "1", "12"]) for _ in range(rnd.randint(0, 3)))
        urls.append(f"http://{host}{rnd.choice(['', '/', '?q'])}{path}{rnd.choice(['', '#f/x', '?a=/b'])}")
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[9], None), (3, urls[3], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = judged(pages, rules, salts=3).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [(i, *plain(u, RULES)) for i, u, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert [r.verdict for r in judged(pages, none, default="block").collect()] == ["block"]
    assert judged(pages.limit(0), spark.createDataFrame(RULES, none.schema)).count() == 0


def test_a_rule_that_is_too_long_is_an_error(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    with pytest.raises(ParameterFailure):
        judged(pages, spark.createDataFrame([("a/" + "x" * 5000, "block")], "rule string, verdict string"))


def test_registered_query_against_sql(spark, sf_dir):
    got = op1_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect()
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(ORACLE).fetchall())
