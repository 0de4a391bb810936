"""What a leader does for clients, as scenarios, and the state machine against a direct model with groups, commits, deletes and retention."""

from __future__ import annotations

import pickle

from hypothesis import given, settings
from hypothesis import strategies as st

from topiclog.operators.kernel import Leases, Subscription, Topic
from topiclog.operators.replay import Clients, replay_recorded, with_global_leases
from topiclog.plans import catalogue

SF = "/root/testdata/sf0.001"
FIELDS = "grp priority producer_id seq max visibility_timeout_ms lease_ids commit_offset max_messages max_age_ms rate_milli_per_sec burst wait_ms ack_mode prefetch client".split()


class Talk:
    """Short hand for commands to one topic's clients."""

    def __init__(self, **options):
        self.clients, self.n = Clients(**options), 0

    def do(self, op, now=0, **fields):
        self.n += 1
        return self.clients.apply({**dict.fromkeys(FIELDS), "cmd_seq": self.n, "op": op, "topic": "t", "ts_ms": now, "grp": "g", **fields})

    def produce(self, n=1, now=0):
        return [e for _ in range(n) for e in self.do("produce", now, producer_id="", seq=0, priority=0)]

    def poll(self, now=0, most=10, visibility=1000, **fields):
        return self.do("poll", now, max=most, visibility_timeout_ms=visibility, **fields)


def of(events, status):
    return [(e[6], e[8]) for e in events if e[4] == status]


def test_a_rate_of_one_refuses_the_second_poll():
    t = Talk()
    t.do("set_rate_limit", rate_milli_per_sec=1000, burst=1)
    t.produce(3)
    assert len(of(t.poll(), "delivered")) == 1
    (refused,) = t.poll(250)
    assert refused[4] == "rate_limited" and refused[9] == 750
    assert len(of(t.poll(1000), "delivered")) == 1
    t.do("set_rate_limit", 1000, rate_milli_per_sec=0, burst=1)
    assert len(of(t.poll(1000), "delivered")) == 2


def test_a_deleted_topic_has_a_full_bucket_again():
    t = Talk()
    for _ in range(2):
        t.do("set_rate_limit", rate_milli_per_sec=1, burst=2)
        t.produce(5)
        assert len(of(t.poll(), "delivered")) == 2 and t.poll()[0][4] == "rate_limited"
        t.do("delete_topic")


def test_defaults_come_before_the_limit():
    t = Talk(rate=(1, 20))
    t.produce(30)
    got = of(t.poll(most=0, visibility=0), "delivered")
    assert len(got) == 16 and t.clients.bucket.tokens == 4.0
    assert {e[9] for e in t.poll(29_999, most=0, visibility=0) if e[4] == "delivered"} == {59_999}
    t = Talk(rate=(1, 20))
    t.produce(1)
    t.poll(most=0, visibility=0)
    assert t.clients.bucket.tokens == 19.0 and t.poll(29_999)[0][4] == "empty"


def test_auto_ack_is_the_requests():
    t = Talk()
    t.produce(2)
    assert len(of(t.poll(most=1, visibility=100, ack_mode="auto"), "ack")) == 1
    assert of(t.poll(most=1, visibility=100), "delivered") == [(1, 1)]
    assert of(t.poll(300), "delivered") == [(1, 2)]


def test_a_long_poll_waits_for_a_message():
    t = Talk()
    assert t.poll(0, wait_ms=5000) == []
    assert of(t.produce(1, 3000), "delivered") == [(0, 0)]
    assert t.poll(3000, wait_ms=10_000, visibility=500) == []  # until the lease ends at 4000
    assert of(t.do("tick", 20_000), "delivered") == [(0, 1)]
    assert t.poll(20_000, grp="other", wait_ms=0) and t.poll(20_000, wait_ms=100, grp="third") is not None
    done = Talk()
    assert done.poll(0, wait_ms=400_000) == []
    assert [e[4] for e in done.do("tick", 299_999)] == ["ok"] and [e[4] for e in done.do("tick", 300_001)] == ["empty", "ok"]
    done.poll(300_001, wait_ms=10)
    assert [e[4] for e in done.clients.finish()] == ["empty"]


def test_prefetch_and_a_duplicate_ack():
    t = Talk()
    t.produce(2)
    assert of(t.do("subscribe", prefetch=1, visibility_timeout_ms=1000, client="c"), "pushed") == [(0, 0)]
    assert of(t.do("ack", 10, lease_ids=[0], client="c"), "pushed") == [(1, 1)]
    again = t.do("ack", 20, lease_ids=[0], client="c")
    assert [e[4] for e in again] == ["miss"]
    assert t.do("ack", 30, lease_ids=[1], client="c") and not t.clients.topic.messages


def test_a_message_that_nobody_acks_comes_again_with_another_lease():
    t = Talk()
    t.produce()
    t.do("subscribe", prefetch=4, visibility_timeout_ms=300, client="c")
    events = t.do("tick", 2000)
    leases = [(e[4], e[8]) for e in events if e[2] == "subscribe"]
    assert leases[:3] == [("refreshed", 1), ("refreshed", 2), ("pushed", 3)]


def test_a_late_ack_completes_the_message():
    t = Talk()
    t.produce()
    t.do("subscribe", prefetch=4, visibility_timeout_ms=300, client="c")
    events = t.do("ack", 800, lease_ids=[0], client="c")
    assert not of(events, "pushed") and of(events, "ack") == [(0, 2)]
    assert not t.clients.topic.messages


def test_an_acked_message_that_comes_again_is_acked_again():
    t = Talk()
    t.produce()
    t.do("subscribe", prefetch=4, visibility_timeout_ms=300, client="c")
    sent = t.clients.subscribers["c"]["sent"]
    assert sent.resolve(0, 100, "ack") == 0  # its ack is lost, so the lease ends and the message is polled again
    events = t.do("tick", 400)
    assert of(events, "already_acked") == [(0, 1)] and of(events, "ack") == [(0, 1)] and not t.clients.topic.messages


def test_nack_pushes_again_and_auto_never_tracks():
    t = Talk()
    t.produce()
    t.do("subscribe", prefetch=4, visibility_timeout_ms=300, client="c")
    assert of(t.do("nack", 10, lease_ids=[0], client="c"), "pushed") == [(0, 1)]
    t.do("unsubscribe", 10, client="c")
    assert not of(t.do("tick", 5000), "pushed")
    auto = Talk()
    auto.produce(30)
    events = auto.do("subscribe", prefetch=4, client="c", ack_mode="auto")
    assert len(of(events, "pushed")) == len(of(events, "ack")) == 30 and not auto.clients.topic.messages


def test_subscriptions_are_paced():
    t = Talk(rate=(1000, 2))
    t.produce(5)
    assert len(of(t.do("subscribe", prefetch=16, client="c"), "pushed")) == 2
    assert len(of(t.do("tick", 3000), "pushed")) == 2 and len(of(t.do("tick", 3500), "pushed")) == 0 and len(of(t.do("tick", 4000), "pushed")) == 1


def test_clients_can_be_stored_between_batches():
    whole, parts = Talk(), Talk()
    for k in range(60):
        if k == 30:
            parts.clients = pickle.loads(pickle.dumps(parts.clients))
        op = ("produce", "produce", "subscribe" if k == 2 else "ack", "poll")[k % 4]
        fields = {"producer_id": "", "seq": 0, "priority": k % 3, "max": 2, "visibility_timeout_ms": 70, "lease_ids": [k // 4], "prefetch": 3, "client": "c" if op != "poll" else None, "wait_ms": 30}
        assert whole.do(op, k * 20, **fields) == parts.do(op, k * 20, **fields)


def test_no_wait_is_negative(spark):
    rows = catalogue.QUERIES["replay_paced"](spark, SF).where("status = 'rate_limited'").collect()
    assert rows and all(r.deadline_ms > 0 for r in rows)


def test_recorded_logs_name_leases_of_one_counter(spark):
    commands = catalogue.command_log(spark, SF)
    topics, leases, events = {}, Leases(), []
    for row in sorted(commands.collect(), key=lambda r: r.cmd_seq):
        events += topics.setdefault(row.topic, Topic(leases=leases)).apply(row.asDict())
    got = replay_recorded(commands).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, events))
    silent = commands.where("op not in ('ack', 'nack')")
    one = {(r.cmd_seq, r.ord): r.lease_id for r in replay_recorded(silent).where("status = 'delivered'").collect()}
    from topiclog.operators.replay import replay

    assert one == {(r.cmd_seq, r.ord): r.global_lease_id for r in with_global_leases(replay(silent)).collect()}


class Plain:
    """The rules said directly over lists: every poll looks at every message, every answer at every lease."""

    def __init__(self, dedup):
        self.dedup, self.lease, self.there = dedup, 0, False
        self.reset()

    def reset(self):
        self.messages, self.next, self.keys, self.groups, self.limits = {}, 0, [], {}, (0, 0)

    def first(self):
        return min(self.messages, default=self.next)

    def group(self, name):
        return self.groups.setdefault(name, {"mark": self.first(), "acked": set(), "held": {}, "polls": 0})

    def advance(self, g, to):
        if to > g["mark"]:
            g["mark"] = to
            g["acked"] = {o for o in g["acked"] if o >= to}
            g["held"] = {x: h for x, h in g["held"].items() if h[0] >= to}
            while g["mark"] in g["acked"]:
                g["acked"].discard(g["mark"])
                g["mark"] += 1

    def reclaim(self):
        if self.groups:
            low = min(g["mark"] for g in self.groups.values())
            self.messages = {o: m for o, m in self.messages.items() if o >= low}

    def produce(self, priority, producer, seq, now):
        self.there = True
        for p, s, o in self.keys:
            if producer and (p, s) == (producer, seq):
                return o
        offset, self.next = self.next, self.next + 1
        self.messages[offset] = (priority, now)
        if producer:
            self.keys = [*self.keys, (producer, seq, offset)][-self.dedup :]
        most, age = self.limits if any(self.limits) else (1_000_000, 0)
        gone = []
        for o in sorted(self.messages) if age else []:
            if max(now - self.messages[o][1], 0) <= age:
                break
            gone.append(o)
        if most:
            left = [o for o in sorted(self.messages) if o not in gone]
            gone += left[: max(0, len(left) - most)]
        if gone:
            self.messages = {o: m for o, m in self.messages.items() if o not in gone}
            for g in self.groups.values():
                self.advance(g, self.first())
        return offset

    def poll(self, name, most, visibility, now):
        if not self.there:
            return []
        g = self.group(name)
        g["held"] = {x: (o, d) for x, (o, d) in g["held"].items() if d > now}
        out = {o for o, _ in g["held"].values()}
        free = [o for o in sorted(self.messages) if o >= g["mark"] and o not in out and o not in g["acked"]]
        g["polls"] += 1
        back = min(most, most // 4 + (g["polls"] % 4 == 0))
        urgent = sorted(free, key=lambda o: (-self.messages[o][0], o))
        chosen = urgent[: most - back]
        chosen += [o for o in free if o not in chosen][: most - len(chosen)]
        polled = []
        for o in sorted(chosen, key=lambda o: (-self.messages[o][0], o)):
            g["held"][self.lease] = (o, now + visibility)
            polled.append((o, self.lease))
            self.lease += 1
        return polled

    def deliverable(self, name, now):
        g = self.groups.get(name)
        if g is None:
            return bool(self.messages)
        held = {o for o, d in g["held"].values() if d > now}
        return any(o >= g["mark"] and o not in g["acked"] and o not in held for o in self.messages)

    def settle(self, name, leases, ack):
        g = self.groups.get(name)
        for x in leases:
            held = g and g["held"].pop(x, None)
            if held and ack and held[0] >= g["mark"]:
                g["acked"].add(held[0])
                while g["mark"] in g["acked"]:
                    g["acked"].discard(g["mark"])
                    g["mark"] += 1
        if ack:
            self.reclaim()


@settings(max_examples=250, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("pppppooooaaancrd"), st.integers(0, 7), st.integers(0, 9), st.integers(0, 250), st.integers(0, 30)), max_size=150))
def test_random_logs_equal_a_direct_model(steps):
    """Two groups, priorities, a small memory of keys, answers, commits, retention by count and age with times that also fall, deletes."""
    topic, plain, now, n = Topic(dedup=5), Plain(5), 0, 0
    for kind, a, b, c, d in steps:
        now, n = max(0, now + c - 60), n + 1
        grp = f"g{a % 2}"
        base = {**dict.fromkeys(FIELDS), "cmd_seq": n, "topic": "t", "ts_ms": now, "grp": grp}
        if kind == "p":
            producer = f"p{a % 3}" if a % 3 else ""
            ((*_, offset, _, _, _),) = topic.apply({**base, "op": "produce", "producer_id": producer, "seq": b, "priority": a})
            assert offset == plain.produce(a, producer, b, now)
        elif kind == "o":
            got = topic.apply({**base, "op": "poll", "max": b, "visibility_timeout_ms": 200})
            assert [(e[6], e[8]) for e in got if e[4] == "delivered"] == plain.poll(grp, b, 200, now)
        elif kind in "an":
            leases = [max(0, plain.lease - 1 - d), max(0, plain.lease - 1 - b)]
            topic.apply({**base, "op": "ack" if kind == "a" else "nack", "lease_ids": leases})
            if plain.there:
                plain.settle(grp, leases, kind == "a")
        elif kind == "c" and plain.there:
            topic.apply({**base, "op": "commit", "commit_offset": d})
            plain.advance(plain.group(grp), d)
            plain.reclaim()
        elif kind == "r":
            topic.apply({**base, "op": "set_retention", "max_messages": b, "max_age_ms": c * (a % 2)})
            plain.limits, plain.there = (b, c * (a % 2)), True
        elif kind == "d" and a == 0:
            topic.apply({**base, "op": "delete_topic"})
            plain.reset()
            plain.there = False
        assert list(topic.messages) == sorted(plain.messages)
        for g in ("g0", "g1", "g2"):
            assert topic.deliverable(g, now) == plain.deliverable(g, now)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("dddan"), st.integers(0, 3), st.integers(1, 25), st.integers(0, 2500)), max_size=120))
def test_random_subscriptions_equal_a_list(steps):
    """Against one list of all deliveries, searched anew each time."""
    sub, sent, acked, now = Subscription(), [], {}, 0  # sent: [offset, lease, end], of messages that are out
    for lease, (kind, offset, back, pause) in enumerate(steps):
        now += pause
        acked = {o: t for o, t in acked.items() if t > now}
        last = {o: e for o, _, e in sent}
        sent = [s for s in sent if last[s[0]] + 1000 > now]
        assert sub.live(now, 1000) == sum(last[o] > now for o in {s[0] for s in sent})
        own = [s for s in sent if s[0] == offset]
        if kind == "d":
            want = "already_acked" if offset in acked else ("refreshed", "pushed")[len(own) % 3 == 0]
            assert sub.deliver(offset, lease, now + 1000, now) == want
            if want != "already_acked":
                sent.append([offset, lease, now + 1000])
        else:
            named = next((s[0] for s in sent if s[1] == lease - back and s in [x for x in sent if x[0] == s[0]][-8:]), None)
            got = sub.resolve(lease - back, now, "ack" if kind == "a" else "nack")
            assert got == (None if named is None else [s[1] for s in sent if s[0] == named][-1])
            if named is not None:
                sent = [s for s in sent if s[0] != named]
                if kind == "a":
                    acked[named] = now + 5000
