"""Scalar rules of the log as column expressions: caps, clamps, defaults and saturating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the wire protocol and the state machine.
MAX_PAYLOAD_BYTES = 1_048_576
MAX_PRIORITY = 7
POLL_MAX_DEFAULT = 16
POLL_MAX = 1024
VISIBILITY_MS_DEFAULT = 30_000
WAIT_MS_MAX = 300_000
BATCH_ITEMS = 256
BATCH_BYTES = 524_288
ACK_BATCH = 1024
DEDUP_CAPACITY = 100_000
RETAIN_MESSAGES_DEFAULT = 1_000_000
GROUP_GC_THRESHOLD = 1024
LEASE_REFRESHES = 2
LEASE_ALIASES = 8
ACK_GRACE_MS = 5_000
CONTENT_TYPES = {0: "Raw", 1: "Text", 2: "Json", 3: "MsgPack"}
LONG_MAX = 2**63 - 1


def clamp_priority(priority: Column) -> Column:
    return F.least(priority, F.lit(MAX_PRIORITY)).cast("int")


def content_type(code: Column) -> Column:
    """The tag of a wire code; unknown and null codes are Raw."""
    out = F.lit("Raw")
    for number, name in CONTENT_TYPES.items():
        out = F.when(code == number, name).otherwise(out)
    return out


def content_code(tag: Column) -> Column:
    out = F.lit(0)
    for number, name in CONTENT_TYPES.items():
        out = F.when(tag == name, number).otherwise(out)
    return out


def payload_error(payload: Column, cap: int = MAX_PAYLOAD_BYTES) -> Column:
    """payload_too_large above the cap (not at it), else null."""
    return F.when(F.octet_length(payload) > cap, F.lit("payload_too_large"))


def poll_max(wanted: Column) -> Column:
    """0 means the default; the rest is capped."""
    return F.when(wanted == 0, POLL_MAX_DEFAULT).otherwise(F.least(wanted, F.lit(POLL_MAX)))


def visibility(ms: Column) -> Column:
    return F.when(ms == 0, VISIBILITY_MS_DEFAULT).otherwise(ms)


def wait(ms: Column) -> Column:
    return F.least(ms, F.lit(WAIT_MS_MAX))


def prefetch(wanted: Column) -> Column:
    """From 1 to POLL_MAX: here 0 means 1, not a default."""
    return F.greatest(F.lit(1), F.least(wanted, F.lit(POLL_MAX)))


def deadline(now: Column, ms: Column) -> Column:
    """now + ms, at most the largest long."""
    return F.coalesce(F.try_add(now, ms), F.lit(LONG_MAX))


def expired(deadline_ms: Column, now: Column) -> Column:
    """A lease is expired at its deadline, not only behind it."""
    return deadline_ms <= now


def too_old(ts: Column, now: Column, age: Column) -> Column:
    return F.greatest(now - ts, F.lit(0)) > age


def reserved(most: Column, polls_before: Column) -> Column:
    """How many of a poll's messages are the oldest ones: a quarter, and one more in every fourth poll."""
    return F.least(most, F.floor(most / 4) + F.when((polls_before + 1) % 4 == 0, 1).otherwise(0)).cast("int")


def effective_retention(messages: Column, age: Column) -> Column:
    """A struct (messages, age): both 0 means the default cap, otherwise 0 switches that limit off."""
    unset = (messages == 0) & (age == 0)
    return F.struct(F.when(unset, RETAIN_MESSAGES_DEFAULT).otherwise(messages).alias("messages"), F.when(unset, 0).otherwise(age).alias("age"))


def response_kind(op: Column, status: Column) -> Column:
    """What kind of reply a command's event is sent as: error, produced, polled or ok."""
    failed = status.isin("payload_too_large", "rate_limited", "not_leader", "bad_request", "bootstrap_failed", "internal")
    return F.when(failed, "error").when(op == "produce", "produced").when(op.isin("poll", "subscribe"), "polled").otherwise("ok")
