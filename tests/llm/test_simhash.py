"""SimHash near duplicates against brute force."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from topiclog.llm import simhash
from topiclog.llm.components import connected


def print_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    ws = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def groups(prints):
    """Smallest index of each index's component under at most three differing bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_near_duplicates(spark, clashing, sample, which):
    docs = clashing if which == "odd" else spark.read.parquet(f"{sample}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [print_of(t) for _, t in rows]
    lowest = defaultdict(list)
    for (doc, _), g in zip(rows, root := groups(prints), strict=True):
        lowest[g] += [doc] * (doc is not None)
    want = sorted((str(d), f"{p:016x}", str(min(lowest[g], default=None))) for (d, _), p, g in zip(rows, prints, root, strict=True))
    assert sorted((str(a), b, str(c)) for a, b, c in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 250), st.integers(0, 5), st.integers(1, 40), st.integers(4, 600))
def test_trie_join(seed, n, flips, leaf, width):
    rnd = np.random.default_rng(seed)
    keys = rnd.integers(0, 2**64, max(1, n // 15), dtype=np.uint64)[rnd.integers(0, max(1, n // 15), n)]
    for _ in range(flips):
        keys = keys ^ (np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64))
    keys = np.unique(keys)
    got = simhash.trie_join(keys, np.array([0]), 0, leaf=leaf, width=width)
    assert got.tolist() == groups([int(k) for k in keys])


@pytest.mark.parametrize("run", [4, 1 << 14])
def test_links_of_a_dense_group(spark, monkeypatch, run):
    """Runs that are too large are cut again, over all rounds, and no link is lost."""
    monkeypatch.setattr(simhash, "RUN", run)
    monkeypatch.setattr(simhash, "HELD", 64 if run == 4 else 1 << 18)
    rnd = np.random.default_rng(5)
    keys = np.full(400, 0x0123456789ABCDEF, np.uint64)
    for _ in range(4):
        keys = keys ^ (np.uint64(1) << rnd.integers(0, 64, 400).astype(np.uint64))
    keys = np.unique(np.concatenate([keys, rnd.integers(0, 2**64, 300, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    links = simhash.near_links(frame)
    assert links.count() < 16 * len(keys)
    roots = {r.node: r.root for r in connected(links).collect()}
    names = [roots.get(int(k), int(k)) for k in keys.view(np.int64)]
    want = groups([int(k) for k in keys])
    assert len(set(zip(names, want, strict=True))) == len(set(names)) == len(set(want))


def test_connected(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100), (301, 300)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 200: 100, 301: 300}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_one_task(spark):
    """Few links and star steps give the same roots, and few links run a handful of stages at most, whatever the component's diameter."""
    from topiclog.llm.components import connected

    pairs = [(k, k + 1) for k in range(-300, 300)] + [(1000, 2000), (3000, 2000), (5, 5), (None, 7), (2**62, -(2**62)), (2000, 1000)]
    for kind in ("long", "int"):
        links = spark.createDataFrame([p for p in pairs if kind == "long" or abs(p[0] or 0) < 2**31], f"a {kind}, b {kind}")
        spark.sparkContext.setJobGroup(f"few {kind}", "")
        found = connected(links)
        rows = sorted(map(tuple, found.collect()))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"few {kind}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        steps = connected(links, few=0)
        assert found.schema == steps.schema and rows == sorted(map(tuple, steps.collect()))
        assert (300, -300) in rows and (3000, 1000) in rows and len(rows) == 602 + (kind == "long") and len(jobs) <= 8
    assert connected(links.limit(0)).count() == 0
