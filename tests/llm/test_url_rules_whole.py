"""Mined URL rules: none is lost to redundant ones, to its length or to the size of the index."""

import itertools

import pytest

from topiclog.llm import url_filter


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_no_rule_is_lost(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "BROADCAST", bound, raising=False)
    template = "http://" + ".".join(f"t{k}" for k in range(14)) + "/"
    seven = [f"s{k}" for k in range(7)]
    rows = [(template, True)] * 60 + [("http://farm/", i % 4 > 0) for i in range(40)] + [("http://news/", False)] * 100
    rows += [("http://" + ".".join(seven), True)] * 20 + [("http://" + ".".join(s), False) for s in itertools.combinations(seven, 6) for _ in range(20)]
    labels = spark.createDataFrame(rows, "url string, block boolean")
    pages = spark.createDataFrame([(1, template), (2, "http://farm/"), (3, "http://news/"), (4, "http://" + ".".join(seven)), (5, "http://" + ".".join(seven[1:]))], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, labels, rules=[]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow"}
