"""Mined URL rules against a miner by brute force, wide templates, odd labels, and the DuckDB SQL."""

import itertools
import random
import time

import duckdb
import pytest

from topiclog.llm import oracle, url_filter


def brute(rows, least, confidence, longest):
    """Minimal sure sets of tokens, by listing all sets of each blocked row; rows: (set of tokens, block)."""
    known = [(frozenset(t), b) for t, b in rows if b is not None]
    found = {frozenset(s) for t, b in known if b for k in range(1, longest + 1) for s in itertools.combinations(sorted(t), k)}
    sure = {}
    for s in found:
        n, bad = sum(s <= t for t, _ in known), sum(b and s <= t for t, b in known)
        if bad >= least and bad >= confidence * n:
            sure[s] = bad / n
    return {s for s in sure if not any(s - {x} in sure and sure[s - {x}] >= sure[s] for x in s)}


@pytest.mark.parametrize("wide", [14, 0])
def test_rules_fit_what_brute_force_fits(spark, monkeypatch, wide):
    monkeypatch.setattr(url_filter, "WIDE", wide)
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        t = {x for x in "abcdefg" if rnd.random() < 0.4} | ({"twin1", "twin2"} if rnd.random() < 0.3 else set())
        rows.append((sorted(t), ("a" in t and "c" in t and rnd.random() < 0.9) or ("twin1" in t and "g" in t) or rnd.random() < 0.1))
    rows += [(["a"], None), ([], True), ([], False)]
    mined = url_filter.mine(spark.createDataFrame(rows, "items array<string>, block boolean"), 0.0, 0.7, 12, 3)
    pages = [(i, list(t)) for i, t in enumerate(itertools.chain.from_iterable(itertools.combinations("abcdefg", k) for k in range(4)))]
    pages += [(1000 + i, [*t, twin]) for i, (t, twin) in enumerate(itertools.product([(), ("g",), ("a", "b")], ["twin1", "twin2"]))]
    got = {r[0] for r in url_filter.matched(spark.createDataFrame(pages, "k long, items array<string>"), mined, ["k"]).collect()}
    rules = brute(rows, 12, 0.7, 3)
    assert rules and got == {k for k, t in pages if any(s <= set(t) for s in rules)}


def test_a_long_shared_template_is_one_item(spark):
    words = [f"w{chr(97 + k // 5)}{chr(97 + k % 5)}" for k in range(30)]
    rows = [("http://x.example/" + "/".join(words), True)] * 60 + [("http://y.example/" + "/".join(words[:2]), False)] * 60
    labels = spark.createDataFrame(rows, "url string, block boolean")
    pages = spark.createDataFrame([(1, "http://z.example/" + words[7]), (2, "http://z.example/" + words[0]), (3, "http://x.example/q")], "page_id long, url string")
    start = time.time()
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, labels, rules=[]).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"} and time.time() - start < 60


def test_numbers_are_no_tokens(spark):
    labels = spark.createDataFrame([(f"http://a{k % 2}.example/en/77", True) for k in range(30)] + [(f"http://b.example/en/{k}", False) for k in range(90)], "url string, block boolean")
    mined = url_filter.mine(labels.select(url_filter.tokens(url_filter.host(labels.url), url_filter.path(labels.url)).alias("items"), "block"))
    assert not any("77" in x for r in mined.collect() for x in r.antecedent)


def test_rules_hold_on_pages_that_were_not_mined(spark):
    rnd = random.Random(3)
    kinds = ["bets", "pills", "news", "blog", "shop", "wiki"]
    rows = []
    for i in range(1200):
        kind, tld = rnd.choice(kinds), rnd.choice(["fr", "it", "pl"])
        bad = rnd.random() < (0.85 if kind == "bets" or (kind, tld) == ("pills", "it") else 0.15)
        rows.append((i, f"http://{kind}.{tld}/p/{i}", bad))
    table = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    got = url_filter.filter_urls(table.where("page_id % 2 = 0"), table.where("page_id % 2 = 1"), rules=[]).where("verdict = 'block'")
    blocked = {r.page_id for r in got.collect()}
    assert len(blocked) > 80 and sum(rows[i][2] for i in blocked) / len(blocked) >= 0.6


def test_sql_mines_the_same(spark):
    rnd = random.Random(9)
    pages, labels = [], []
    for i in range(600):
        kind, tld = rnd.choice(["bets", "news", "blog"]), rnd.choice(["fr", "it"])
        pages.append((i, f"http://{kind}.x.{tld}/q/{i}"))
        if i % 2:
            labels.append((i, 0 if (kind == "bets" or (kind, tld) == ("blog", "it")) and rnd.random() < 0.9 else 1, 0))
    pages += [(None, None), (600, "http://a.com/en/1"), (600, "http://a.com/en/1"), (601, "no scheme"), (602, "http://A.example.net/de/8?x")]
    p = spark.createDataFrame(pages, "page_id long, url string")
    got = url_filter.filter_urls(p, url_filter.page_labels(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    own = duckdb.connect()
    own.execute("create table pages(page_id bigint, url varchar)").executemany("insert into pages values (?, ?)", pages)
    own.execute("create table labels(doc_id bigint, quality int, toxic int)").executemany("insert into labels values (?, ?, ?)", labels)
    want = own.execute(oracle.url_filter()).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.rule is None and r.verdict == "block" for r in got) > 150


def test_ties_and_very_long_urls(spark):
    long = "http://a.example/" + "x" * 100_000 + "/" + "/".join(f"y{k}z" for k in range(5000))
    rules = [("allow", "a.example/x"), ("block", "a.example/x"), ("block", "b.example/"), ("allow", "example/xxx"), ("allow", "b.example/")]
    labels = spark.createDataFrame([(long, True), (None, False)] * 30, "url string, block boolean")
    pages = spark.createDataFrame([(1, long), (2, "http://b.example/"), (3, "http://a.example/x"), (4, "http://c.example/q")], "page_id long, url string")
    start = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels, rules=rules).collect()}
    # of equally long rules the last by name, then by verdict
    assert got == {1: ("example/xxx", "allow"), 2: ("b.example/", "block"), 3: ("a.example/x", "block"), 4: (None, "block")}
    assert time.time() - start < 60
