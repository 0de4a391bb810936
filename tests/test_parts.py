"""Parts of the log engine against plain loops: batches over blocks, forgetful deduplication, appends, snapshots, groups with something to get."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topiclog.operators import ack, deliver, metrics, pacing, produce, replay
from topiclog.plans import catalogue
from topiclog.sources import stored_log

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [16, 50, 10**6])
def test_batches_do_not_depend_on_blocks(spark, block):
    rnd = random.Random(block)
    rows = [(3 * k, None if k % 31 == 0 else "x" * rnd.choice([0, 1, 5, 40, 120])) for k in range(700)]
    got = sorted(map(tuple, pacing.byte_batches(spark.createDataFrame(rows, "arrival long, payload string"), 16, 200, block).collect()))
    want, batch = [], []
    for at, payload in rows:
        batch.append((at, len(payload or "")))
        if len(batch) == 16 or sum(n for _, n in batch) >= 200:
            want.append((len(want), len(batch), sum(n for _, n in batch), batch[0][0], batch[-1][0]))
            batch = []
    if batch:
        want.append((len(want), len(batch), sum(n for _, n in batch), batch[0][0], batch[-1][0]))
    assert got == want
    assert pacing.byte_batches(spark.createDataFrame([], "arrival long, payload string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(1, 9), st.integers(1, 60))
def test_next_is_where_a_batch_ends(sizes, items, cap):
    import numpy as np

    for start, end in enumerate(pacing._next(np.array(sizes, np.int64), items, cap)):
        at, total = start, 0
        while at < len(sizes) and at - start < items and total < cap:
            total += sizes[at]
            at += 1
        assert end == at


@pytest.mark.parametrize("cap", [1, 3, 10, 10**6])
def test_forgotten_keys_are_accepted_again(spark, cap):
    from topiclog.operators.kernel import Topic

    rnd = random.Random(cap)
    rows = [("big" if rnd.random() < 0.8 else "small", k, rnd.choice(["p", "q", "", None]), rnd.randint(0, 8)) for k in range(300)]
    log = spark.createDataFrame(rows, "topic string, arrival long, producer_id string, seq long")
    topics, want = {}, {}
    for topic, arrival, producer, seq in rows:
        offset, fresh = topics.setdefault(topic, Topic(dedup=cap)).produce(producer or "", seq, 0, 0)
        want[arrival] = (offset, not fresh)
    assert {r.arrival: (r.msg_offset, r.duplicate) for r in produce.offsets(log, cap).collect()} == want
    assert {r.arrival: r.msg_offset for r in produce.accepted(log, 40, cap).collect()} == {a: o for a, (o, d) in want.items() if not d}
    got = {r.topic: (r.attempts, r.accepted, r.duplicates) for r in produce.attempts(log, cap).collect()}
    for topic, state in topics.items():
        n = sum(r[0] == topic for r in rows)
        assert got[topic] == (n, state.next_offset, n - state.next_offset)


def test_replies_lie_where_their_commands_do(spark):
    log = spark.createDataFrame([("t", 1, "p", 1), ("u", 2, "p", 1), ("t", 5, "p", 1), ("t", 7, "", 0), ("u", 9, "p", 2)], "topic string, arrival long, producer_id string, seq long")
    got = sorted((r.batch_id, r.item, r.topic, r.msg_offset) for r in produce.batch_replies(log, 3).collect())
    assert got == [(0, 0, "t", 0), (0, 1, "u", 0), (0, 2, "t", 0), (1, 0, "t", 1), (1, 1, "u", 1)]


def test_coalesced_leases_keep_their_order(spark):
    rows = [(k, "t", "g", k * 7 % 10, "ack") for k in range(10)]
    got = ack.coalesce_acks(spark.createDataFrame(rows, "cmd_seq long, topic string, grp string, lease_id long, kind string"), 4).orderBy("batch_id").collect()
    assert [list(r.lease_ids) for r in got] == [[0, 7, 4, 1], [8, 5, 2, 9], [6, 3]]


def test_append_replaces_by_index(spark, tmp_path):
    log = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "idx long, v string")
    entries = spark.createDataFrame([(1, 3, "a"), (2, 3, "b"), (3, 9, "c")], "at long, idx long, v string")
    path = str(tmp_path / "log")
    stored_log.write_log(stored_log.append(log, entries, "at"), path, 2)
    assert {r.idx: r.v for r in spark.read.parquet(path).collect()} == {0: "v0", 1: "v1", 2: "v2", 3: "b", 4: "v4", 9: "c"}


def test_a_snapshot_takes_the_place_of_the_log_before_it(spark):
    commands = catalogue.command_log(spark, SF)
    whole = replay.replay(commands).where("cmd_seq > 500").collect()
    first = replay.snapshot(commands, 200)
    second = replay.snapshot(commands.where("cmd_seq > 200"), 500, first)
    kept = replay.current_snapshot(first.unionByName(second))
    assert {r.last_seq for r in kept.collect()} <= set(range(501))
    assert sorted(map(str, replay.replay_after(commands.where("cmd_seq > 500"), kept).collect())) == sorted(map(str, whole))
    assert sorted(map(str, replay.replay_after(commands, kept).where("cmd_seq > 500").collect())) == sorted(map(str, whole))


@pytest.mark.parametrize("gaps", [False, True])
def test_who_has_something_to_get(spark, gaps):
    rnd = random.Random(gaps)
    messages, groups, states, want = [], [], [], {}
    for t in range(30):
        own = [o for o in range(rnd.randint(0, 5), rnd.randint(0, 12)) if not gaps or rnd.random() < 0.7]
        messages += [(f"t{t}", o) for o in own]
        for g in range(3):
            mark = rnd.choice([None, rnd.randint(0, 12)])
            groups.append((f"t{t}", f"g{g}", mark))
            mine = {o: rnd.choice([(True, None), (False, 10), (False, 5), (False, None)]) for o in range(14) if rnd.random() < 0.8}
            states += [(f"t{t}", f"g{g}", o, a, d) for o, (a, d) in mine.items()]
            held = lambda o, mine=mine: o in mine and (mine[o][0] or (mine[o][1] is not None and mine[o][1] > 5))
            want[f"t{t}", f"g{g}"] = bool(own) if mark is None else any(o >= mark and not held(o) for o in own)
    got = deliver.has_deliverable(
        spark.createDataFrame(messages, "topic string, msg_offset long"),
        spark.createDataFrame(groups, "topic string, grp string, ack_watermark long"),
        spark.createDataFrame(states, "topic string, grp string, msg_offset long, acked boolean, deadline_ms long"),
        F.lit(5),
    )
    assert {(r.topic, r.grp): r.deliverable for r in got.collect()} == want


def test_rates_and_purge_marks(spark):
    row = spark.range(1).select(metrics.rate(F.lit(10), F.lit(4.0)).alias("r"), metrics.rate(F.lit(10), F.lit(0.0)).alias("none"), stored_log.purge_mark(F.lit(5), F.lit(3)).alias("m")).first()
    assert (row.r, row.none, row.m) == (2.5, None, 5)


@pytest.mark.parametrize(("most", "age"), [(0, 50), (7, 50), (7, 0), (0, 0)])
def test_retention_whatever_the_times(spark, most, age):
    from topiclog.operators import retention
    from topiclog.operators.kernel import Topic

    rnd = random.Random(most + age)
    rows, want = [], set()
    for t in range(12):
        topic, now = Topic(), 0
        topic.limits = (most, age)
        for o in range(rnd.randint(1, 40)):
            now += rnd.randint(0, 15) if t % 3 else rnd.randint(-60, 70)
            topic.produce("", 0, 0, now)
            rows.append((f"t{t}", o, now))
        want |= {(f"t{t}", o) for o in topic.messages}
    got = retention.kept(spark.createDataFrame(rows, "topic string, msg_offset long, ts_ms long"), most, age)
    assert {(r.topic, r.msg_offset) for r in got.collect()} == want
    assert got.columns == ["topic", "msg_offset", "ts_ms"]


def test_chart_scale(spark):
    rows = spark.createDataFrame([("a", 50.0), ("b", 1000.0), ("c", 2_500_000.0), ("d", 999.5)], "name string, value double")
    got = {r.name: (r.axis_max, round(r.share, 6), r.label) for r in metrics.chart(rows).collect()}
    assert got == {"a": (1e7, 0.0, "50"), "b": (1e7, 0.2, "1,000"), "c": (1e7, 0.879588, "2.5M"), "d": (1e7, 0.199957, "1,000")}
    assert metrics.chart(rows.where("value < 60")).first().axis_max == 1000.0
