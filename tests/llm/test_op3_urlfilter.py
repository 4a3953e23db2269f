import re

from llm_frames import FILL, CLASHING
from panelcast.llm import urlfilter
from pyspark.sql import functions as F

URLS = [
    (1, "http://Example.NET/en/5"), (2, "https://a.b.example.net/en"), (3, "https://example.net/EN/1"), (4, "ftp://net"), (5, "ftp://net/"),
    (6, "https://notnet/x"), (7, "https://example.org/fr/2?x=1"), (8, "https://example.org/de/2"), (9, "https://example.com/de/2#top"),
    (10, None), (11, ""), (12, "no scheme here/net/"), (13, "https://x.org/search?page=2&q=cats"), (14, "https://x.org/research?q=cats"),
    (15, "https://x.org/f.exe"), (16, "https://x.org/f.exe?x"), (17, "https://x.org/login"), (18, "https://x.org/logins"), (None, "https://x.org/cart?x"),
    (19, "https://x.org/a?utm_source=feed"), (19, "https://x.org/a?utm_source=feed"), (20, "https://x.org/a?utm_source=feedly"), (21, "a://b://net/"), (22, "x://" + "y" * 50_000 + "/login"),
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urlfilter._UPPER, urlfilter._LOWER)), m[2]) if m else ("", "")
    site = []
    for rule, verdict in urlfilter.SITE_RULES:
        h, _, p = rule.partition("/")
        if url is not None and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            site.append((len(rule), verdict, rule))
    patterns = []
    for rule, verdict in urlfilter.PATTERN_RULES:
        regex = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in rule.rstrip("|")) + ("$" if rule.endswith("|") else "")
        if url is not None and re.search(regex, url):
            patterns.append((len(rule), verdict, rule))
    verdict = max(site)[1] if site else max(patterns)[1] if patterns else "allow"
    return host, path, max(site)[2] if site else None, verdict, max(patterns)[2] if patterns and not site else None


def test_against_all_rules_on_all_urls(spark):
    pages = spark.createDataFrame([(i, u, *FILL) for i, u in URLS], f"page_id bigint, url string, {CLASHING}")
    out = urlfilter.judge(pages, urlfilter.rule_table(spark))
    got = [tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict", "pattern").collect()]
    want = [(i, *brute(u)) for i, u in URLS]
    assert sorted(map(str, got)) == sorted(map(str, want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rules_are_filed_under_their_rarest_literal(spark):
    rules = spark.createDataFrame([("a", "/blog/rare/", "block"), ("b", "*.gif|", "block"), ("c", "x*y", "block")], "rule string, pattern string, verdict string")
    urls = spark.createDataFrame([("http://h/blog/rare/1",), ("http://h/blog/2",), ("http://h/xay.gif",)], "url string")
    tokens = urls.select("url", F.explode(urlfilter.url_tokens(F.col("url"))).alias("token"))
    index = {r["rule"]: r["token"] for r in urlfilter.rule_index(rules, tokens).collect()}
    assert index == {"a": "rare", "b": "gif", "c": ""}
    pages = urls.withColumn("page_id", F.lit(1).cast("bigint"))
    assert sorted(r["verdict"] for r in urlfilter.judge(pages, rules).collect()) == ["allow", "block", "block"]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    rules = urlfilter.rule_table(spark)
    assert urlfilter.judge(pages, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a/b")], "page_id bigint, url string")
    assert [r["verdict"] for r in urlfilter.judge(some, rules.limit(0)).collect()] == ["allow"]
