import random

from pyspark.sql import functions as F

from confab.llm import url_filters as u


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [None, "", "nothing", "http://", "http://COM/x", "https://a.Example.com/en/1?x=/fr/", "http://www.example.com/en/", "http://deep.www.example.com/en/x#y", "http://b.net/es/", "http://b.net/es", "http://net/fr/q", "http://xnet/fr/q", "http://example.com", "http://example.com?/en/", "ftp://u:p@c.com:80/en/://x", "http://example.org/en/", "x" * 5000 + "://a.com/" + "y" * 20000]


def test_judgements(spark):
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)] * 2, "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in u.judge_urls(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judge(r.url, u.RULES)
    assert u.judge_urls(pages.limit(0)).collect() == []
    assert {r.verdict for r in u.judge_urls(pages, rules=(), default="block").collect()} == {"block"}


def test_cascade_is_exact_over_its_universe(spark):
    r = random.Random(5)
    keys = [f"h{r.randrange(10**6)}.com/" for _ in range(4000)]
    listed = spark.createDataFrame([(k,) for k in keys[:300]], "key string").distinct()
    universe = spark.createDataFrame([(k,) for k in keys], "key string").distinct()
    levels = u.cascade(universe, listed, "test")
    assert len(levels) > 1
    assert {x.key for x in universe.filter(F.expr(u.contains(levels, "key"))).collect()} == set(keys[:300])


def test_long_lists_are_joined_with_equal_results(spark):
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)] * 3, "page_id long, url string").withColumns({"rule": F.lit("clash"), "_n": F.lit(1)})
    rules = spark.createDataFrame([*u.RULES, ("other", "a.com", "/"), ("block", None, "/")], "verdict string, host string, path string")
    for most in (0, 1, 100):
        got = u.judge_urls(pages, rules, most=most)
        assert got.columns == ["page_id", "url", "rule", "_n", "host", "path", "verdict"]
        rows = got.collect()
        assert len(rows) == 3 * len(URLS)
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == judge(r.url, u.RULES)
