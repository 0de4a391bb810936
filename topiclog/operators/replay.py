"""Batch replay of command logs through the kernel, and the folds that have no closed form."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclog.functions.scalars import LONG_MAX, POLL_MAX, POLL_MAX_DEFAULT, VISIBILITY_MS_DEFAULT, WAIT_MS_MAX
from topiclog.operators.fold import fold
from topiclog.operators.kernel import EVENT, Leases, Subscription, Topic
from topiclog.operators.numbering import number
from topiclog.operators.pacing import Bucket

#: Most deliveries of a poll, so that a command's number and a delivery's place make one integer.
PER_COMMAND = 2048


def replay(commands: DataFrame) -> DataFrame:
    """Events of a command log, topic by topic in order of cmd_seq. Lease ids count inside a topic, in events and in the commands' lease_ids."""
    return fold(commands, "topic", "cmd_seq", Topic, lambda topic, row: topic.apply(row), EVENT)


def replay_recorded(commands: DataFrame) -> DataFrame:
    """Events of a log as it was recorded, whose acks name ids of the one counter that all topics share.

    Which id a delivery gets depends on every delivery of every topic before it, so this is one sequence, in one task, with the
    state of all topics in memory. Logs whose lease ids count inside topics replay topic by topic.
    """

    def start():
        return {}, Leases()

    def step(state, row):
        topics, leases = state
        if row["topic"] not in topics:
            topics[row["topic"]] = Topic(leases=leases)
        return topics[row["topic"]].apply(row)

    return fold(commands.withColumn("__all", F.lit(0)), "__all", "cmd_seq", start, step, EVENT)


SNAPSHOT = "topic string, last_seq long, state binary"


def snapshot(commands: DataFrame, upto: int, before: DataFrame | None = None) -> DataFrame:
    """The state of each topic after the commands up to cmd_seq `upto` (and those that the snapshot `before` contains), as rows of SNAPSHOT."""
    return _from(commands.where(F.col("cmd_seq") <= upto), before, SNAPSHOT, lambda held, row: [], lambda held: [(held["name"], held["last"], pickle.dumps(held["topic"]))])


def replay_after(commands: DataFrame, installed: DataFrame) -> DataFrame:
    """Events of the commands behind a snapshot: those that a topic's state contains are skipped, topics that it does not have begin anew."""
    return _from(commands, installed, EVENT, lambda held, row: held["topic"].apply(row), None)


def current_snapshot(snapshots: DataFrame) -> DataFrame:
    """Of several snapshots of a topic the newest."""
    return snapshots.groupBy("topic").agg(F.max_by(F.struct("last_seq", "state"), "last_seq").alias("s")).select("topic", "s.last_seq", "s.state")


def _from(commands: DataFrame, before: DataFrame | None, schema: str, step, finish) -> DataFrame:
    """A fold over commands in which a row with a state takes the place of all that came before it. States are pickled by this module and read back only from where it wrote them."""
    rows = commands.withColumn("__state", F.lit(None).cast("binary"))
    if before is not None:
        rows = rows.unionByName(before.select("topic", F.col("last_seq").alias("cmd_seq"), F.col("state").alias("__state")), allowMissingColumns=True)
    rows = rows.withColumn("__at", F.struct("cmd_seq", F.col("__state").isNotNull().cast("int")))
    start = lambda: {"name": None, "last": -1, "topic": Topic()}

    def each(held, row):
        held["name"] = row["topic"]
        if row["__state"] is not None:
            held.update(topic=pickle.loads(row["__state"]), last=row["cmd_seq"])
            return []
        out = step(held, row) if schema == EVENT else held["topic"].apply(row) and []
        held["last"] = row["cmd_seq"]
        return out

    newest = rows.join(before.select("topic", F.col("last_seq").alias("__done")), "topic", "left").where("__state is not null or __done is null or cmd_seq > __done").drop("__done") if before is not None else rows
    return fold(newest, "topic", "__at", start, each, schema, finish)


class Clients:
    """A topic and what its leader does around it for clients: poll defaults, pacing, long polls, automatic acks, subscriptions.

    Time moves with the commands. Before a command is applied, whatever a lease's end lets happen since the command before is done at that
    time; after it, waiting polls and subscriptions look again. So a log without commands for a while needs none of its own (an op "tick" does nothing
    but let time pass).
    """

    def __init__(self, rate: tuple[int, int] = (0, 0), auto_groups: tuple[str, ...] = (), topic: Topic | None = None):
        self.topic, self.first_rate, self.auto_groups = topic or Topic(), rate, auto_groups
        self.topic.rate = rate
        self.bucket: Bucket | None = None
        self.waiting: list[dict[str, Any]] = []  # polls, in their order
        self.subscribers: dict[str, dict[str, Any]] = {}

    def apply(self, c: dict[str, Any]) -> list[tuple]:
        """Events of one command, and of what came due before it."""
        out = self.pass_time(c["ts_ms"])
        op, client = c["op"], c.get("client")
        if op == "poll":
            wanted = {"max": min(c["max"] or POLL_MAX_DEFAULT, POLL_MAX), "visibility_timeout_ms": c["visibility_timeout_ms"] or VISIBILITY_MS_DEFAULT}
            poll = {**c, **wanted, "until": c["ts_ms"] + min(c.get("wait_ms") or 0, WAIT_MS_MAX)}
            done = self.poll(poll, c["ts_ms"])
            if not done and poll["until"] > c["ts_ms"]:
                self.waiting.append(poll)
                return out
            return out + (done or [self.event(c, "empty")])
        if op == "subscribe":
            own = {**c, "prefetch": max(1, min(c.get("prefetch") or 0, POLL_MAX)), "visibility_timeout_ms": c["visibility_timeout_ms"] or VISIBILITY_MS_DEFAULT, "sent": Subscription()}
            self.subscribers[client or ""] = own
            return out + [self.event(c, "ok"), *self.push(own, c["ts_ms"], 0)]
        if op in ("unsubscribe", "tick"):
            if op == "unsubscribe":
                self.subscribers.pop(client or "", None)
            return out + [self.event(c, "ok"), *self.look_again(c["ts_ms"])]
        own = self.subscribers.get(client or "") if op in ("ack", "nack") else None
        if own:  # an answer on a subscription: any lease of the message stands for its newest
            if not own_auto(own):
                for lease in c["lease_ids"] or []:
                    newest = own["sent"].resolve(lease, c["ts_ms"], op)
                    out += self.topic.apply({**c, "grp": own["grp"], "lease_ids": [lease if newest is None else newest]})
            out = out or [self.event(c, "ok")]
        else:
            out += self.topic.apply(c)
        if op == "delete_topic":
            self.bucket, self.topic.rate = None, self.first_rate
        return out + self.look_again(c["ts_ms"])

    def event(self, c: dict[str, Any], status: str, wait: int | None = None, ord: int = 0) -> tuple:  # noqa: A002
        return (c["cmd_seq"], c["topic"], c["op"], c["grp"], status, ord, None, None, None, wait)

    def grant(self, wanted: int, now: int) -> tuple[int, int | None]:
        """How many messages may go, and if none, the milliseconds until one may."""
        milli, burst = self.topic.rate
        if not milli:
            return wanted, None
        if self.bucket is None:
            self.bucket = Bucket(milli / 1000.0, burst)
        self.bucket.limit(milli / 1000.0, burst)
        return self.bucket.take(now, wanted)

    def take(self, c: dict[str, Any], wanted: int, now: int) -> tuple[list[tuple], int | None]:
        """Deliveries (offset, priority, lease, deadline) under the limit, acked at once where the request says so; or the wait."""
        granted, wait = self.grant(wanted, now)
        if not granted:
            return [], wait
        got = self.topic.poll(c["grp"], granted, c["visibility_timeout_ms"], now)
        if self.bucket is not None and self.topic.rate[0]:
            self.bucket.refund(granted - len(got))
        return got, None

    def acked_at_once(self, c: dict[str, Any], leases: list[int], now: int) -> list[tuple]:
        return self.topic.apply({**c, "op": "ack", "lease_ids": leases, "ts_ms": now}) if leases else []

    def poll(self, c: dict[str, Any], now: int) -> list[tuple] | None:
        """Events of a poll, or None while nothing is deliverable."""
        if not self.topic.exists or not self.topic.deliverable(c["grp"], now):
            return None
        got, wait = self.take(c, c["max"], now)
        if wait is not None:
            return [self.event(c, "rate_limited", wait)]
        if not got:
            return None
        out = [(*self.event(c, "delivered")[:5], k, *m) for k, m in enumerate(got)]
        if own_auto(c) or c["grp"] in self.auto_groups:
            out += self.acked_at_once(c, [m[2] for m in got], now)
        return out

    def push(self, own: dict[str, Any], now: int, ord: int) -> list[tuple]:  # noqa: A002
        """What a subscriber gets now: polls until its places are taken, nothing is deliverable or the limit refuses."""
        out, auto = [], own_auto(own)
        while self.topic.exists:
            room = own["prefetch"] - own["sent"].live(now, own["visibility_timeout_ms"])
            if room <= 0 or not self.topic.deliverable(own["grp"], now):
                break
            got, _ = self.take(own, room, now)
            if not got:
                break
            again = []
            for offset, priority, lease, deadline in got:
                status = "pushed" if auto else own["sent"].deliver(offset, lease, deadline, now)
                out.append((*self.event(own, status)[:4], status, ord + len(out), offset, priority, lease, deadline))
                again += [lease] if status == "already_acked" else []
            out += self.acked_at_once(own, [m[2] for m in got] if auto else again, now)
        return out

    def look_again(self, now: int) -> list[tuple]:
        out = []
        still = []
        for c in self.waiting:
            done = self.poll(c, now)
            out += done or []
            still += [] if done else [c]
        self.waiting = still
        for own in self.subscribers.values():
            out += self.push(own, now, len(out))
        return out

    def pass_time(self, now: int) -> list[tuple]:
        """What happens before `now`: leases that end let waiting polls and subscriptions go on, and polls stop waiting."""
        out = []
        while True:
            times = [c["until"] for c in self.waiting]
            for c in (*self.waiting, *self.subscribers.values()):
                due = self.topic.next_due(c["grp"])
                times += [due] if due is not None and due > c.get("looked", -1) else []
            at = min(times, default=now)
            if at >= now:
                return out
            for c in (*self.waiting, *self.subscribers.values()):
                c["looked"] = at
            out += self.look_again(at)
            out += [self.event(c, "empty") for c in self.waiting if c["until"] <= at]
            self.waiting = [c for c in self.waiting if c["until"] > at]

    def finish(self) -> list[tuple]:
        """What waiting polls get until the last of them stops waiting."""
        last = max((c["until"] for c in self.waiting), default=None)
        return [] if last is None else self.pass_time(min(last + 1, LONG_MAX))


def own_auto(c: dict[str, Any]) -> bool:
    return c.get("ack_mode") == "auto"


def replay_clients(commands: DataFrame, rate_milli: int = 0, burst: int = 1, auto_groups: tuple[str, ...] = ()) -> DataFrame:
    """Replay with what a leader does around the state machine (see Clients); rate_milli and burst hold until the log sets a limit.

    Defaults are filled in before anything else: max 0 is 16 and at most 1024, visibility 0 is 30 s, waits end after 300 s. A refused poll never
    reaches the topic (status rate_limited; deadline_ms is then the wait for a token), and what a poll does not use of its grant goes back. A poll
    with wait_ms is answered when a message is deliverable. ack_mode "auto" acks what a poll or a subscription gets; subscribe, unsubscribe and answers name
    their client. Pushed, refreshed and already_acked deliveries are events of the subscribe command.
    """
    fields = {f.split()[0]: f.split()[1] for f in ("wait_ms long", "ack_mode string", "prefetch long", "client string", "rate_milli_per_sec long", "burst long") if f.split()[0] not in commands.columns}
    full = commands.withColumns({name: F.lit(None).cast(kind) for name, kind in fields.items()}) if fields else commands
    return fold(full, "topic", "cmd_seq", lambda: Clients((rate_milli, burst), auto_groups), lambda clients, c: clients.apply(c), EVENT, lambda clients: clients.finish())


def with_global_leases(events: DataFrame) -> DataFrame:
    """Deliveries with the lease ids that one counter over all topics gives: in order of commands, then of delivery."""
    delivered = events.where("status = 'delivered'").withColumn("__order", F.col("cmd_seq") * PER_COMMAND + F.col("ord"))
    return number(delivered, [], "__order", "global_lease_id").drop("__order")


def purge_fold(messages: DataFrame, most: int, age_ms: int) -> DataFrame:
    """topic, msg_offset, first_retained, n_retained after each accepted produce, for any order of ts_ms."""

    def start():
        topic = Topic()
        topic.limits = (most, age_ms)
        return topic

    def step(topic, row):
        topic.produce("", 0, 0, row["ts_ms"])
        return [(row["topic"], row["msg_offset"], topic.first, len(topic.messages))]

    return fold(messages.select("topic", "msg_offset", "ts_ms"), "topic", "msg_offset", start, step, "topic string, msg_offset long, first_retained long, n_retained long")


def subscribe_trace(deliveries: DataFrame, visibility_ms: int = VISIBILITY_MS_DEFAULT) -> DataFrame:
    """Rows (topic, step, kind deliver|ack|nack, msg_offset, lease_id, deadline_ms, ts_ms) with outcome, resolved_lease and live.

    A message is forgotten visibility_ms after its last lease ended; until then any of its last leases answers for it.
    """

    def step(sub, row):
        live = sub.live(row["ts_ms"], visibility_ms)
        if row["kind"] == "deliver":
            return [(row["topic"], row["step"], row["kind"], sub.deliver(row["msg_offset"], row["lease_id"], row["deadline_ms"], row["ts_ms"]), None, live)]
        lease = sub.resolve(row["lease_id"], row["ts_ms"], row["kind"])
        return [(row["topic"], row["step"], row["kind"], "miss" if lease is None else row["kind"], lease, live)]

    schema = "topic string, step long, kind string, outcome string, resolved_lease long, live long"
    return fold(deliveries, "topic", "step", Subscription, step, schema)
