from collections import Counter

from pyspark.sql import types as T

from tidelight.llm import urlfilter as U

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("verdict", T.StringType()),
                     T.StructField("key", T.StringType())])
URLS = ["http://Example.COM/en/a", "https://www.example.com/en/", "http://x.y.example.com/fr/1?q=/en/", "http://a.net/es/1", "http://a.net/fr",
        "http://net/es/q#x", "http://anet/es/", "ftp://a.org", "a.org/x://y/z", "no scheme", None, "", "://", "http://a.org/b/", "https://www.a.org/b?x",
        "http://com", "http://com/", "http://.com/x", "http://É.com/én/", "http://h" + "." * 3000 + "com/" + "p" * 50_000]


def brute(url, rules, listed, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    host, tail = low(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    name = (host[4:] if host.startswith("www.") else host) + path.rstrip("/")
    verdict = best[1] if best else "block" if host and name in listed else default
    return host, path, best[0] if best else None, verdict


def run(spark, urls, rules, listed):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, urls[0], "x", "y")] * 2, PAGE)
    rule_rows = spark.createDataFrame(rules, "rule string, verdict string")
    list_rows = spark.createDataFrame([(f"http://{x}", "block") for x in listed], "url string, verdict string")
    got = Counter(map(tuple, U.judge_urls(pages, rule_rows, list_rows).drop("listed").collect()))
    want = Counter((i, *brute(u, rules, set(listed))) for i, u in enumerate(urls))
    want.update([(None, *brute(urls[0], rules, set(listed)))] * 2)
    assert got == want


def test_rules_and_list(spark):
    run(spark, URLS, list(U.RULES), ["a.org/b", "q.org", "q.org"])


def test_many_entries(spark):
    """More keys than one block of the filter holds, and unlisted URLs beside them."""
    urls = [f"http://s{i}.org/p/{j}" for i in range(40) for j in range(5)]
    run(spark, urls, [(f"s{i}.org/p/1", "block") for i in range(0, 40, 3)], [f"s{i}.org/p/{i % 5}" for i in range(40)])


def test_empty(spark):
    rules = spark.createDataFrame([], "rule string, verdict string")
    listed = spark.createDataFrame([], "url string, verdict string")
    assert U.judge_urls(spark.createDataFrame([], PAGE), rules, listed).collect() == []
    run(spark, URLS[:4], [("zz/", "block")], [])


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    blooms = U.build_filter(keys, 94)
    assert U.passing(keys, blooms, 94).count() == 3000
    assert U.passing(spark.range(3000).selectExpr("concat('n', id) AS key"), blooms, 94).count() < 150
