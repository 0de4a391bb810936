"""The classifier's statistics and trees against plain versions, its edge cases, and accuracy on documents that it did not see."""

import math
from collections import Counter

import numpy as np
import pytest

from topiclog.llm import quality_classifier as classifier


def plain_statistics(text):
    """The statistics by loops, in the order of NAMES."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [float(len(data))] + [0.0] * (len(classifier.NAMES) - 1)
    kinds = {k: 0 for k in ("lower", "upper", "digits", "space", "marks", "symbols", "control", "beyond_ascii")}
    for b in data:
        c = chr(b)
        kind = "beyond_ascii" if b > 127 else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digits" if "0" <= c <= "9" else "space" if c in " \t\n\x0b\f\r" else "marks" if c in ".,;:!?'\"()-" else "symbols" if c in "#$%&*+/<=>@[\\]^_`{|}~" else "control"
        kinds[kind] += 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, w, sizes = len(data), len(words), [len(x) for x in words]
    mean = sum(sizes) / w
    entropy = lambda counts: -sum(c / sum(counts) * math.log2(c / sum(counts)) for c in counts)
    threes = [tuple(words[i : i + 3]) for i in range(w - 2)]
    tops = Counter(words).most_common(1)[0][1]
    return [
        math.log1p(n), math.log1p(w), math.log1p(len(lines)), *(k / n for k in kinds.values()), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / w), len(set(words)) / w, tops / w, entropy(list(Counter(words).values())),
        sum(1 for t in threes if threes.count(t) > 1) / w, sum(words[i] == words[i + 1] for i in range(w - 1)) / w, 1 - len(set(lines)) / len(lines), n / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
        data.count(b"|") / w, data.count(b"!") / w, data.count(b".") / w, entropy(list(Counter(data).values())), sum(chr(x[-1]) not in ".,;:!?" for x in words) / w, sum("A" <= chr(x[0]) <= "Z" for x in words) / w, max(lines.count(x) for x in set(lines)) / len(lines),
    ]


def test_statistics_by_loops(odd_rows):
    for _, text, *_ in odd_rows:
        if text is None or len(text) < 20_000:
            assert classifier.statistics(text) == pytest.approx(plain_statistics(text), rel=1e-6, abs=1e-9), repr(text)[:60]


def plain_boosting(x, y, trees, depth, rate, bins, least, l2):
    """Trees as nested tuples, each split found by trying every cut of every feature on the rows themselves."""
    base = math.log(y.mean() / (1 - y.mean()))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    raw, out = np.full(len(y), base), []

    def build(rows, g, h, d):
        value = -rate * g[rows].sum() / (h[rows].sum() + l2)
        best, score = None, lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
        for j in range(x.shape[1]) if d else ():
            for c in cuts[j]:
                left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                if min(len(left), len(right)) >= least:
                    gain = score(left) + score(right) - score(rows)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = gain, j, c, left, right
        return value if best is None else (best[1], best[2], build(best[3], g, h, d - 1), build(best[4], g, h, d - 1))

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        out.append(build(np.arange(len(y)), p - y, p * (1 - p), depth))
        raw = raw + np.array([walk(out[-1], r) for r in x])
    return lambda rows: 1 / (1 + np.exp(-(base + np.array([sum(walk(t, r) for t in out) for r in rows]))))


def test_boosting_by_brute_force():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(250, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] + 0.2 * rnd.normal(size=250) > 0)).astype(float)
    options = {"trees": 12, "depth": 3, "rate": 0.3, "bins": 16, "least": 5.0, "l2": 1.0}
    trees = classifier.grow(x, y, **options)
    new = rnd.normal(size=(400, 4)).astype(np.float32)
    want = plain_boosting(x, y, **options)
    assert trees.predict(x) == pytest.approx(want(x), abs=1e-9)
    assert trees.predict(new) == pytest.approx(want(new), abs=1e-9)
    assert ((trees.predict(x) >= 0.5) == y).mean() > 0.85


def test_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(k % 20, f"text {k}") for k in range(2000)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(3, 0, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = classifier.labelled(docs, labels, 10_000).collect()
    assert len(rows) == 20 and sum(r.y for r in rows) == 19
    assert classifier.labelled(docs, labels, 7).count() <= 7
    got = classifier.classify(docs, labels).collect()
    assert len(got) == 2002 and all(0 <= r.score <= 1 for r in got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.predicted, seen[r.doc_id]) for r in classifier.classify(docs, labels).collect() if r.held_out and r.doc_id in seen]
    share = max(sum(y for _, y in got), sum(1 - y for _, y in got)) / len(got)
    assert len(got) > 80 and sum(p == y for p, y in got) / len(got) > share
