"""Near copies against brute force, and the pipeline's stage on copies that few differing bits do not reach."""

import random

import numpy as np
import pytest

import corpus_pipeline
from topiclog.llm import near_copies


def texts():
    """Random texts, each with copies of which 0 to 8 words in 120 are changed, and texts that share one passage."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    out, passage = [], [word() for _ in range(30)]
    for _ in range(40):
        base = [word() for _ in range(120)]
        out.append(base)
        for n in (0, 1, 2, 3, 4, 6, 8):
            copy = list(base)
            for i in rnd.sample(range(120), n):
                copy[i] = word()
            out.append(copy)
        out.append([*base[:60], *passage, *(word() for _ in range(40))])
    return [" ".join(x) for x in out] + ["", " \n", "one two", "One  two", "one three", None]


def brute(rows):
    def grams(text):
        ws = (text or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    sets, root = [grams(t) for t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("frequent", [False, True])
def test_components(spark, monkeypatch, frequent):
    rows = texts()
    if frequent:  # any order of the shingles gives the same
        some = np.unique(np.concatenate([near_copies.shingles(t) for t in rows])[::3])
        monkeypatch.setattr(near_copies, "frequent_shingles", lambda docs: some)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = dict(near_copies.near_copies(docs).collect())
    assert [got[i] for i in range(len(rows))] == brute(rows)
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, "").collect()}
    assert kept == set(brute(rows))


@pytest.mark.parametrize("seed", [16, 48])
def test_groups_around_the_similarity_that_links(spark, seed):
    """One group of copies with few and with too many changes, and texts of other sizes with them."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    base, rows = [word() for _ in range(1300)], []
    for _ in range(70):
        copy = list(base[: rnd.choice([120, 120, 120, 1300])])
        for i in rnd.sample(range(len(copy)), int(len(copy) * rnd.choice([0.01, 0.02, 0.03, 0.05]))):
            copy[i] = word()
        rows.append(" ".join(copy))
    rows += texts()[:60]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = dict(near_copies.near_copies(docs).collect())
    want = brute(rows)
    assert [got[i] for i in range(len(rows))] == want and len(set(want)) > 5
