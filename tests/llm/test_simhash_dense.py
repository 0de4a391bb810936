"""Runs that are cut in every round: fingerprints that agree in all but 27 bits, against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from topiclog.llm import simhash
from topiclog.llm.components import connected


def test_blocks_of_a_round_are_disjoint():
    free = 64
    for block in simhash.ROUNDS:
        assert (simhash.BUDGET + 1) * block <= free
        free -= block


def test_dense_runs_equal_all_pairs(spark):
    rnd = np.random.default_rng(3)
    own = np.unique(rnd.integers(0, 1 << 27, 20_000))
    lone = int(own[0]) ^ (1 << 6) ^ (1 << 13) ^ (1 << 26)  # bits of different blocks
    keys = np.unique(np.append(own, lone)).astype(np.int64) | (0x5A5A5A5A5 << 27)
    assert len(keys) > simhash.RUN
    root = np.arange(len(keys))
    u = keys.view(np.uint64)
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= simhash.BUDGET):
            a, b = i, int(j)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    for i in range(len(keys)):
        root[i] = root[root[i]]
    frame = spark.createDataFrame([(int(k),) for k in keys], "fp long")
    got = {r.node: r.root for r in connected(simhash.near_links(frame)).collect()}
    assert [got.get(int(k), int(k)) for k in keys] == [int(keys[r]) for r in root]
    assert frame.where(F.col("fp") == lone | (0x5A5A5A5A5 << 27)).count() == 1
