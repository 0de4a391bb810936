"""Operators beyond the catalogue: numbering over buckets, folds, stored logs, streaming."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from topiclog.functions import scalars
from topiclog.operators import ack, deliver, kernel, metrics, produce, replay, retention
from topiclog.operators.numbering import number
from topiclog.plans import catalogue
from topiclog.sources import stored_log
from topiclog.streaming import processor

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 100, 10_000])
def test_number_does_not_depend_on_its_buckets(spark, rows_per_bucket):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaaab"), k) for k in rnd.sample(range(-500, 5000), 300)]
    frame = spark.createDataFrame(rows, "g string, o long")
    got = {(r.g, r.o): r.n for r in number(frame, ["g"], "o", "n", rows_per_bucket).collect()}
    for g in "ab":
        own = sorted(o for x, o in rows if x == g)
        assert [got[g, o] for o in own] == list(range(len(own)))
    alone = sorted((r.o, r.n) for r in number(frame, [], "o", "n", rows_per_bucket).collect())
    assert [n for _, n in alone] == list(range(len(rows)))
    assert number(frame.limit(0), ["g"], "o", "n", rows_per_bucket).count() == 0


@pytest.mark.parametrize(("most", "polls"), [(0, 0), (1, 0), (1, 3), (3, 3), (4, 0), (16, 0), (50, 3), (1000, 0)])
def test_poll_selection_equals_the_kernel(spark, most, polls):
    rnd = random.Random(most)
    rows = [(t, o, rnd.randint(0, 7)) for t in "ab" for o in range(60)]
    got = deliver.select_poll(spark.createDataFrame(rows, "topic string, msg_offset long, priority int"), most, polls).collect()
    for t in "ab":
        topic = kernel.Topic()
        topic.exists = True
        for _, _, p in (r for r in rows if r[0] == t):
            topic.produce("", 0, p, 0)
        for _ in range(polls):
            topic.poll("g", 0, 1, 0)
        want = [o for o, _, _, _ in topic.poll("g", most, 10, 0)]
        assert [r.msg_offset for r in sorted((r for r in got if r.topic == t), key=lambda r: r.ord)] == want


def test_retention_closed_form_needs_rising_times(spark):
    """Equal to the fold where times rise, and, as a control, not where they do not."""
    rnd = random.Random(2)
    rising = sorted(rnd.randint(0, 5000) for _ in range(80))
    for times, same in ((rising, True), ([t - (k % 5) * 900 for k, t in enumerate(rising)], False)):
        frame = spark.createDataFrame([("t", k, t) for k, t in enumerate(times)], "topic string, msg_offset long, ts_ms long")
        last = replay.purge_fold(frame, 30, 1000).orderBy(F.desc("msg_offset")).first()
        closed = retention.retained(frame, 30, 1000).agg(F.min("msg_offset"), F.count("*")).first()
        assert (tuple(closed) == (last.first_retained, last.n_retained)) is same


def test_replay_in_parts_equals_replay_at_once(spark):
    commands = catalogue.command_log(spark, SF)
    whole = sorted(map(str, replay.replay(commands).collect()))
    topics = {}
    events = []
    for row in sorted(commands.collect(), key=lambda r: r.cmd_seq):
        if row.cmd_seq == 500:  # a snapshot and a restart in between
            import pickle

            topics = pickle.loads(pickle.dumps(topics))
        events += topics.setdefault(row.topic, kernel.Topic()).apply(row.asDict())
    schema = kernel.EVENT
    assert sorted(map(str, spark.createDataFrame(events, schema).collect())) == whole


def test_global_leases_count_over_all_topics(spark):
    rows = replay.with_global_leases(replay.replay(catalogue.command_log(spark, SF))).orderBy("cmd_seq", "ord").collect()
    assert [r.global_lease_id for r in rows] == list(range(len(rows)))


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    commands = catalogue.command_log(spark, SF).where("cmd_seq < 400").select(*(x.split()[0] for x in kernel.COMMAND.split(", ")))
    commands = commands.select(*(F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], kernel.COMMAND).schema))
    for a, b in ((0, 150), (150, 300)):
        commands.where(f"cmd_seq >= {a} and cmd_seq < {b}").coalesce(1).write.mode("append").parquet(folder)
    processor.write_events(processor.events(processor.read_commands(spark, folder)), out, state).awaitTermination()
    commands.where("cmd_seq >= 300").coalesce(1).write.mode("append").parquet(folder)
    processor.write_events(processor.events(processor.read_commands(spark, folder)), out, state).awaitTermination()
    got = sorted(map(str, spark.read.parquet(out).collect()))
    assert got == sorted(map(str, replay.replay(commands).collect()))


def test_stored_log(spark, tmp_path):
    log = spark.createDataFrame([(k, f"v{k}") for k in (1, 2, 3, 4, 5)], "idx long, v string")
    assert [r.idx for r in stored_log.scan_range(log, 2, 4).orderBy("idx").collect()] == [2, 3]
    assert stored_log.scan_range(log).count() == 5
    assert tuple(stored_log.bounds(stored_log.purge_up_to(stored_log.truncate_from(log, 4), 1)).first()) == (2, 3)
    assert tuple(stored_log.bounds(log.limit(0)).first()) == (None, None)
    pending = spark.createDataFrame([(4, "new"), (9, "new")], "idx long, v string")
    assert {r.idx: r.v for r in stored_log.overlay(log, pending).collect()} == {1: "v1", 2: "v2", 3: "v3", 4: "new", 5: "v5", 9: "new"}
    state = [("whole", 1, 9, None, 9), ("no prefix", 64, 99, None, 50), ("after snapshot", 65, 99, 64, 99), ("lost tail", 1, 99, None, 120), ("empty", None, None, None, 3), ("snapshot alone", None, None, 8, 8)]
    frame = spark.createDataFrame(state, "store string, first_idx long, last_idx long, snapshot_idx long, committed long")
    got = {r.store: (r.drop_log, r.drop_commit, r.committed) for r in stored_log.recover(frame).collect()}
    assert got == {"whole": (False, False, 9), "no prefix": (True, True, None), "after snapshot": (False, False, 99), "lost tail": (False, True, None), "empty": (False, True, None), "snapshot alone": (False, False, 8)}


def test_frames(spark, tmp_path):
    bodies = [b"", b"a", b"x" * 70_000]
    data = stored_log.write_frames(bodies)
    (tmp_path / "whole").write_bytes(data)
    (tmp_path / "cut").write_bytes(data[:-1])
    (tmp_path / "large").write_bytes(data + (stored_log.FRAME_BYTES + 1).to_bytes(4, "big"))
    got = {}
    for r in stored_log.read_frames(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], {})[r.at] = bytes(r.body)
    assert got == {"whole": dict(enumerate(bodies)), "cut": dict(enumerate(bodies[:-1])), "large": dict(enumerate(bodies))}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.payload_error(F.expr("repeat('x', 1048576)")).alias("at"),
        scalars.payload_error(F.expr("repeat('x', 1048577)")).alias("above"),
        scalars.deadline(F.lit(2**63 - 5), F.lit(10)).alias("deadline"),
        F.array(*(scalars.poll_max(F.lit(k)).cast("long") for k in (0, 5, 5000))).alias("poll"),
        F.array(*(scalars.prefetch(F.lit(k)) for k in (0, 5, 5000))).alias("prefetch"),
        F.array(*(scalars.reserved(F.lit(m), F.lit(p)) for m, p in ((1, 0), (1, 3), (16, 0), (16, 3), (0, 3)))).alias("reserved"),
        F.array(*(scalars.content_code(scalars.content_type(F.lit(k))) for k in (0, 1, 2, 3, 9))).alias("codes"),
    ).first()
    assert row.at is None and row.above == "payload_too_large" and row.deadline == 2**63 - 1
    assert row.poll == [16, 5, 1024] and row.prefetch == [1, 5, 1024] and row.reserved == [0, 1, 4, 5, 0] and row.codes == [0, 1, 2, 3, 0]


def test_produce_without_and_with_producers(spark):
    rows = [("t", 0, "p", 1), ("t", 1, "", 1), ("t", 2, "p", 1), ("t", 3, "", 1), ("t", 4, None, 1), ("u", 5, "p", 1)]
    log = spark.createDataFrame(rows, "topic string, arrival long, producer_id string, seq long")
    got = {r.arrival: (r.msg_offset, r.duplicate) for r in produce.offsets(log).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (0, True), 3: (2, False), 4: (3, False), 5: (0, False)}
    assert {r.topic: r.first_arrival for r in produce.topics_in_order(log).collect()} == {"t": 0, "u": 5}


def test_nearest_rank(spark):
    values = [5, 1, 9, 9, 3, 7, 2]
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 4)], "k string, v long")
    got = {r.k: tuple(r)[1:] for r in metrics.nearest_rank(frame, "k", "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}).collect()}
    ordered = sorted(values)
    assert got == {"a": tuple(ordered[int((len(values) - 1) * p + 0.5)] for p in (0, 0.5, 0.99)), "b": (4, 4, 4)}


def test_reclaim_keeps_topics_without_groups(spark):
    messages = spark.createDataFrame([(t, k) for t in "ab" for k in range(4)], "topic string, msg_offset long")
    marks = spark.createDataFrame([("a", "g", 2), ("a", "h", 9)], "topic string, grp string, ack_watermark long")
    assert sorted((r.topic, r.msg_offset) for r in ack.reclaim(messages, marks).collect()) == [("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2), ("b", 3)]


def test_paced_replay(spark):
    """Without a limit the events are those of plain replay but for empty polls; with one, grants follow the bucket and auto groups hold no lease."""
    commands = catalogue.command_log(spark, SF)
    strip = lambda rows: sorted(str(r) for r in rows if r.status not in ("empty",))
    free = replay.replay_clients(commands).where("op = 'produce'").collect()
    assert strip(free) == strip(replay.replay(commands).where("op = 'produce'").collect())
    paced = replay.replay_clients(commands.withColumn("ts_ms", F.col("cmd_seq") * 1000), 20, 5, ("g1",)).collect()
    polled = [r for r in paced if r.op == "poll" and r.grp == "g1" and r.status == "delivered"]
    acked = [r for r in paced if r.op == "ack" and r.grp == "g1" and r.status == "ack"]
    assert polled and {(r.topic, r.lease_id) for r in polled} <= {(r.topic, r.lease_id) for r in acked}
    assert any(r.status == "rate_limited" and r.deadline_ms > 0 for r in paced)
