"""URL filters against a loop over all rules."""

import random

import duckdb
import pytest

from tidemark.llm import queries, urlfilter
from tidemark.llm.common import spread_lookup

LOWER = str.maketrans(urlfilter._UPPER, urlfilter._LOWER)


def split_brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


def judged_brute(url, rules, default="allow"):
    host, path = split_brute(url)
    best = None
    for h, p, v in rules:
        if not h or p is None or v is None or h != h.translate(LOWER):
            continue
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), h + p, v == "block", v))
    return host, path, best and best[2], best[4] if best else default


URLS = [
    None, "", "no scheme/x", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/1", "http://m.example.net/en", "http://example.net/en/?q=/x",
    "http://notexample.net/en/1", "https://example.com/de/", "https://x.example.com/de/7#top", "https://example.com?x=/de/", "http://x.org/fr/2136.html", "http://org/fr/", "ftp://a://b.net/",
    "http://a..net/", "http://.net/", "http://net./", "http://u@a.net:80/", "http://a.net:80/", "http://\u00c4.NET/\u00e9", "http://a.net/\nx?y", "http://" + "a." * 5000 + "net/" + "p" * 20000, "http://example.com/DE/", "//a.net/",
]


def test_contract_rules(spark):
    rows = list(enumerate(URLS)) + [(0, "http://a.net/"), (None, "http://b.net/x")]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = urlfilter.filter_urls(df, urlfilter.rule_table(spark, urlfilter.RULES))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, u, *judged_brute(u, urlfilter.RULES)) for i, u in rows), key=key)


def test_many_rules_match_brute_force(spark):
    rng = random.Random(3)
    name = lambda: ".".join(rng.choice(("a", "b", "cc", "net", "")) for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join(rng.choice("/ab\u00e9") for _ in range(rng.randrange(0, 5)))
    rules = [(name(), path(), rng.choice(("allow", "block", "review"))) for _ in range(150)] + [("A", "/", "block"), (None, "/", "block"), ("a", None, "block"), ("a", "/", None)]
    urls = [f"http://{name()}/{path()}" for _ in range(300)] + ["http://a.net/a"] * 400
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, urlfilter.rule_table(spark, rules), default="review").collect()}
    assert got == {i: judged_brute(u, rules, "review") for i, u in enumerate(urls)}


def test_without_rules_or_urls(spark):
    none = urlfilter.rule_table(spark, [])
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in urlfilter.filter_urls(one, none).collect()] == [(1, "http://a.net/", "a.net", "/", None, "allow")]
    assert urlfilter.filter_urls(one.where("page_id > 1"), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


def test_short_prefixes_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "PREFIX", 1)
    urls = [f"http://h{i}.net/en/{i}" for i in range(200)] + [f"http://h{i}.example.org/de/{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in urlfilter.filter_urls(df, urlfilter.rule_table(spark, urlfilter.RULES)).collect()}
    assert got == {i: judged_brute(u, urlfilter.RULES)[2] for i, u in enumerate(urls)}


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
    want = con.execute(queries.op11_sql()).fetchall()
    got = [tuple(r) for r in queries.op11_url_filter(spark, at).collect()]
    assert len(got) > 200 and sorted(got, key=str) == sorted(want, key=str)
    assert {v for *_, v in got} == {"allow", "block"}


@pytest.mark.parametrize("inner", [False, True])
def test_spread_lookup_with_hot_keys(spark, inner):
    rows = [("hot", i) for i in range(600)] + [(f"k{i % 400}", i) for i in range(800)] + [("none", 1)]
    got = spread_lookup(spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame([("hot", -1), *[(f"k{i}", i) for i in range(399)]], "k string, a int"), ["k"], inner=inner).collect()
    want = [(k, i, -1 if k == "hot" else int(k[1:])) if k not in ("none", "k399") else (k, i, None) for k, i in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, (w for w in want if not inner or w[2] is not None)))
