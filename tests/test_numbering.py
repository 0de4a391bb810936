"""Numbers and carried values over skewed orders, with many buckets, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from topiclog.operators import numbering, retention


def orders():
    rnd = random.Random(1)
    return {
        "outlier": [*range(2000), 10**15],
        "gaps": sorted(rnd.sample(range(10**12), 1000) + list(range(-500, 500))),
        "cluster": [*range(1800), *(10**9 * k for k in range(1, 200))],
        "falling": list(range(3000, 0, -1)),
    }


@pytest.mark.parametrize("kind", ["outlier", "gaps", "cluster", "falling"])
def test_buckets_are_even(spark, kind):
    values = orders()[kind]
    rows = spark.createDataFrame([(v,) for v in values], "at long")
    sizes = [r["count"] for r in numbering.bucketed(rows, "at", 100).groupBy("__bucket").count().collect()]
    assert sum(sizes) == len(values) and max(sizes) <= 200
    by = numbering.bucketed(rows, "at", 100).orderBy("at").collect()
    assert [r["__bucket"] for r in by] == sorted(r["__bucket"] for r in by)


@pytest.mark.parametrize("per", [1, 7, 100, 10**6])
def test_numbers_and_carried_values(spark, per):
    rnd = random.Random(per)
    rows = [("t" if rnd.random() < 0.8 else "u", v, rnd.choice([None, None, rnd.randint(0, 99)])) for v in orders()["outlier"][::3] + [10**15, 2**62]]
    rows = list({(t, v): (t, v, x) for t, v, x in rows}.values())
    frame = spark.createDataFrame(rows, "topic string, at long, x int")
    got = {(r.topic, r.at): (r.n, r.last) for r in numbering.carried(numbering.number(frame, ["topic"], "at", "n", per), ["topic"], "at", "x", "last", per).collect()}
    want = {}
    for topic in "tu":
        last = None
        for n, (_, at, x) in enumerate(sorted((r for r in rows if r[0] == topic), key=lambda r: r[1])):
            want[topic, at] = (n, last)
            last = x if x is not None else last
    assert got == want


@pytest.mark.parametrize("per", [50, 10**6])
def test_configuration_and_gaps_in_buckets(spark, per):
    produces = spark.createDataFrame([("t", k, f"v{k}") for k in range(600)] + [("u", 5, "w")], "topic string, cmd_seq long, v string")
    configs = spark.createDataFrame([("t", k, k % 5 or None) for k in range(3, 600, 97)], "topic string, cmd_seq long, most long")
    got = {(r.topic, r.cmd_seq): (r.v, r.most) for r in retention.config_in_force(produces, configs, ["most"], per).collect()}
    marks = [(k, k % 5 or None) for k in range(3, 600, 97)]
    want = {("t", k): (f"v{k}", next((m for at, m in reversed(marks) if at < k), None)) for k in range(600)} | {("u", 5): ("w", None)}
    assert got == want
    messages = produces.select("topic", F.col("cmd_seq").alias("msg_offset"), (F.col("cmd_seq") * F.col("cmd_seq")).alias("ts_ms"))
    assert sorted(r.gap_ms for r in retention.inter_arrival(messages, per).collect()) == [2 * k + 1 for k in range(599)]
