"""URL filters against brute force."""

import re

from topiclog.llm import url_filter

URLS = [
    (1, "http://a.example.com/en/5?x=1"),
    (2, "https://Example.COM/en/7.html"),
    (3, "https://example.com/en/71#t"),
    (4, "http://net/de/"),
    (5, "http://x.example.net/de/8/9"),
    (6, "http://myexample.net/de/8"),
    (7, "http://a.org/es"),
    (8, "http://a.org/es/x"),
    (9, None),
    (10, "no scheme/en/"),
    (11, "://com/en/"),
    (12, "http://com"),
    (13, "http://a.com?x=/en/"),
    (None, "http://spam-farm.example.org/fr/1"),
    (14, "http://a://b.com/en/"),
    (14, "http://a://b.com/en/"),
    (15, ""),
    (16, "http://É.COM/EN/\nx"),
]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        name, slash, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return host, path, best and best[1], best and best[2]


def test_explicit_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'x' host", "'y' rule", "'z' verdict", "1 items", "2 token")
    labels = spark.createDataFrame([], "url string, block boolean")
    got = sorted(map(str, url_filter.filter_urls(pages, labels).collect()))
    want = []
    for page, url in URLS:
        host, path, rule, verdict = judged(url, url_filter.RULES)
        want.append((page, host, path, rule, verdict or "allow"))
    assert got == sorted(str(r) for r in spark.createDataFrame(want, "page_id long, host string, path string, rule string, verdict string").collect())
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_block_what_labels_block(spark):
    import itertools

    rows = []
    for i, (kind, tld) in enumerate(itertools.islice(itertools.cycle(itertools.product(("bets", "farm", "news", "blog"), ("fr", "it"))), 800)):
        rows.append((f"http://{kind}-{i % 7}.x.{tld}/q/{i}", kind == "bets" or (kind == "farm" and tld == "it")))
    labels = spark.createDataFrame([*rows, (None, True), ("http://n.x.fr/", None)], "url string, block boolean")
    pages = spark.createDataFrame([(1, "http://bets.y.de/z"), (2, "http://farm.x.it/"), (3, "http://farm.x.fr/"), (4, "http://blog-1.x.fr/q/5"), (5, "http://bets.com/en/")], "page_id long, url string")
    mined = url_filter.mine(labels.select(url_filter.tokens(url_filter.host(labels.url), url_filter.path(labels.url)).alias("items"), "block"))
    assert sorted(tuple(r.antecedent) for r in mined.collect() if r.confidence > 0.99) == [("h:bets",), ("h:farm", "h:it")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("com/en/", "block")}
