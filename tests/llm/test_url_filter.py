from __future__ import annotations

import random
import re

from plumbline.llm import url_filter

PAGES = "page_id long, url string, host string, verdict int"
RULES = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))


def brute(url):
    if not url or "://" not in url:
        return "", "", None, None
    m = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3 :], re.S)
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            return host, path, h + p, verdict
    return host, path, None, None


URLS = [
    None, "", "no scheme", "http://", "http://Example.com", "http://example.com/", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/1", "https://a.www.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/fr/a b",
    "http://x.net/ES/", "http://x.net/es", "ftp://x.org/a://b/c", "http://x.org?q=://e.com/", "http://x.org#f/en/", "http://user@x.com:80/en/", "http://bad.org/page/?utm_source=a&ref=b&k=2&j=1#top", "https://bad.org/page?j=1&k=2", "http://bad.org/page", "http://É.org/x\n/y",
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "h", 0) for i, u in enumerate(URLS)] + [(None, URLS[7], "h", 0), (3, URLS[3], "h", 0)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame([("http://BAD.org/page/?k=2&j=1&ref=z",), (None,), ("",)], "url string")).collect()
    assert len(out) == len(rows)
    by_id = {r.page_id: r for r in out if r.page_id is not None}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        listed = i in (18, 19)
        assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, rule), u
        assert by_id[i].verdict == (verdict or ("block" if listed else "allow")), u


def test_false_positives_of_the_filter_are_removed(spark, monkeypatch):
    """With one bit a key nearly every probe is possible; the exact join must give the same verdicts."""
    rnd = random.Random(2)
    urls = [f"http://h{rnd.randint(0, 40)}.org/p{rnd.randint(0, 40)}" for _ in range(3000)]
    listed = sorted(set(urls))[::7]
    pages = spark.createDataFrame([(i, u, "", 0) for i, u in enumerate(urls)], PAGES)
    frame = spark.createDataFrame([(u,) for u in listed], "url string")
    for bits, size in ((1, 64 << 20), (16, 64 << 20), (16, 0)):
        monkeypatch.setattr(url_filter, "BITS_PER_KEY", bits)
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", size)
        got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, frame).collect()}
        assert got == {i: "block" if u in set(listed) else "allow" for i, u in enumerate(urls)}


def test_no_listed_url_is_lost_by_the_filter(spark):
    from functools import reduce

    from pyspark.sql import functions as F

    keys = spark.range(5000).selectExpr("concat('k', id) AS canon")
    blocks, n = url_filter.bloom_blocks(keys, "canon", 5000)
    probe = spark.range(20000).selectExpr("id", "concat('k', id) AS canon").withColumn("block", url_filter._block(F.col("canon"), n)).join(blocks, "block", "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(url_filter._masks(F.col("canon")))])
    out = probe.select((F.col("id") < 5000).alias("listed"), F.coalesce(hit, F.lit(False)).alias("hit")).groupBy("listed", "hit").count().collect()
    counts = {(r.listed, r.hit): r["count"] for r in out}
    assert counts.get((True, False), 0) == 0
    assert counts.get((False, True), 0) < 0.02 * 15000


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "url string")
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES), empty).count() == 0
    assert [r.verdict for r in url_filter.filter_urls(spark.createDataFrame([(1, "http://a.org/", "", 0)], PAGES), empty).collect()] == ["allow"]


def test_no_python_in_the_plan(spark):
    df = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.org/", "", 0)], PAGES), spark.createDataFrame([("http://a.org/",)], "url string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_all_spam_hosts_are_listed(spark, tmp_path):
    from plumbline.llm import registry

    names = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track", "notadult-x", "tionsh"]
    rows = [(i, f"http://blog.{n}.example.net/a", "", 0) for i, n in enumerate(names)]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in registry.QUERIES["op7_url_filter_all_hosts"](spark, str(tmp_path)).collect()}
    assert got == {i: "block" if i < 6 else "allow" for i in range(8)}
    assert registry.ALL_SPAM_HOSTS in registry.ORACLE_SQL["op7_url_filter_all_hosts"]
