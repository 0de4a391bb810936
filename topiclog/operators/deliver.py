"""Delivery: poll selection, leases, visibility, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topiclog.functions.scalars import deadline, expired, reserved
from topiclog.operators.numbering import number


def select_poll(candidates: DataFrame, most: int, polls_before: int = 0, key: list[str] | None = None) -> DataFrame:
    """The messages that a poll of at most `most` gets in each topic, with ord (0, 1, ...) in their order of delivery.

    Some places go by priority, the reserved ones to the oldest messages that priority left. Only the `most` first
    by priority and the `most` oldest can be chosen, as priority takes no more of the oldest than there are unreserved
    places. Both lists are cut by rank before they are shuffled, so a topic that holds most messages
    sends `most` rows of each task.
    """
    key = key or ["topic"]
    kept_back = min(most, most // 4 + (1 if (polls_before + 1) % 4 == 0 else 0))
    if most <= 0:
        return candidates.withColumn("ord", F.lit(0)).limit(0)
    by_priority = Window.partitionBy(*key).orderBy(F.desc("priority"), "msg_offset")
    by_age = Window.partitionBy(*key).orderBy("msg_offset")
    first = candidates.withColumn("__p", F.row_number().over(by_priority)).where(F.col("__p") <= most - kept_back).drop("__p")
    chosen = first
    if kept_back:
        old = candidates.withColumn("__o", F.row_number().over(by_age)).where(F.col("__o") <= most).drop("__o")
        both = first.withColumn("__first", F.lit(True)).unionByName(old.join(first.select(*key, "msg_offset"), [*key, "msg_offset"], "left_anti").withColumn("__first", F.lit(False)))
        rank = F.row_number().over(Window.partitionBy(*key, "__first").orderBy("msg_offset"))
        chosen = both.withColumn("__r", rank).where(F.col("__first") | (F.col("__r") <= kept_back)).drop("__first", "__r")
    return chosen.withColumn("ord", (F.row_number().over(by_priority) - 1).cast("int"))


def candidates(messages: DataFrame, groups: DataFrame, acked: DataFrame, leased: DataFrame) -> DataFrame:
    """Messages that a group can get: at or above its watermark, not acked, not leased.

    groups: topic, grp, ack_watermark. acked and leased: topic, grp, msg_offset (leases that are not expired).
    """
    open_rows = messages.join(groups, "topic").where("msg_offset >= ack_watermark")
    for gone in (acked, leased):
        open_rows = open_rows.join(gone.select("topic", "grp", "msg_offset"), ["topic", "grp", "msg_offset"], "left_anti")
    return open_rows


def lease(deliveries: DataFrame, order: Column, now: Column, visibility_ms: int, first_lease: int = 0) -> DataFrame:
    """Deliveries with lease_id, counted over all topics in `order` (an integer, unique), and deadline_ms."""
    numbered = number(deliveries.withColumn("__order", order), [], "__order", "lease_id").drop("__order")
    return numbered.withColumn("lease_id", F.col("lease_id") + first_lease).withColumn("deadline_ms", deadline(now, F.lit(visibility_ms).cast("long")))


def fetch(deliveries: DataFrame, messages: DataFrame) -> DataFrame:
    """Deliveries with what their messages (topic, msg_offset, ...) have besides: payload, content type, time. Deliveries of messages that are gone are left out."""
    more = [c for c in messages.columns if c not in deliveries.columns]
    return deliveries.join(messages.select("topic", "msg_offset", *more), ["topic", "msg_offset"])


def lease_status(leases: DataFrame, now: Column) -> DataFrame:
    """Rows with acked, deadline_ms -> status: acked, expired, in_flight, or ready (no lease)."""
    status = F.when(F.col("acked"), "acked").when(F.col("deadline_ms").isNull(), "ready").when(expired(F.col("deadline_ms"), now), "expired").otherwise("in_flight")
    return leases.withColumn("status", status)


def has_deliverable(messages: DataFrame, groups: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """topic, grp, deliverable for each wanted (topic, grp, ack_watermark; null: the group is unknown, any message will do).

    states: topic, grp, msg_offset, acked, deadline_ms of messages that the group has acked or leased, each once. A topic
    without messages, or an unknown one, has nothing deliverable. Where a topic's offsets have no gaps, a group's messages are counted by the ends of
    their range and those it holds by its states, so no message meets a group; only groups of topics with gaps are held against every message.
    """
    ends = messages.groupBy("topic").agg(F.min("msg_offset").alias("__lo"), F.max("msg_offset").alias("__hi"), F.count("*").alias("__n"))
    wanted = groups.select("topic", "grp", "ack_watermark").join(ends, "topic", "left").withColumn("__from", F.greatest("__lo", "ack_watermark"))
    wanted = wanted.withColumn("__whole", F.col("ack_watermark").isNull() | F.col("__n").isNull() | (F.col("__n") == F.col("__hi") - F.col("__lo") + 1))
    taken = F.coalesce("acked", F.lit(False)) | ~F.coalesce(expired(F.col("deadline_ms"), now), F.lit(True))
    inside = states.where(taken).join(wanted.select("topic", "grp", "__from", "__hi"), ["topic", "grp"]).where("msg_offset between __from and __hi")
    held = inside.groupBy("topic", "grp").agg(F.count("*").alias("__held"))
    by_count = F.when(F.col("ack_watermark").isNull(), F.col("__n") > 0).otherwise(F.col("__hi") - F.col("__from") + 1 > F.coalesce("__held", F.lit(0)))
    counted = wanted.where("__whole").join(held, ["topic", "grp"], "left").select("topic", "grp", F.coalesce(by_count, F.lit(False)).alias("deliverable"))
    doubtful = wanted.where("not __whole")
    every = messages.select("topic", "msg_offset").join(doubtful, "topic").where("msg_offset >= ack_watermark")
    free = every.join(states.where(taken).select("topic", "grp", "msg_offset"), ["topic", "grp", "msg_offset"], "left_anti").select("topic", "grp").distinct().withColumn("__free", F.lit(True))
    searched = doubtful.join(free, ["topic", "grp"], "left").select("topic", "grp", F.coalesce("__free", F.lit(False)).alias("deliverable"))
    return counted.unionByName(searched)


def fan_out(messages: DataFrame, groups: DataFrame) -> DataFrame:
    """Every group of a topic sees every message of it."""
    return messages.join(groups, "topic")


def fifo_polls(messages: DataFrame, most: int) -> DataFrame:
    """With one priority, polls take messages in order: poll_no and ord follow from the offset."""
    return messages.withColumn("poll_no", F.floor(F.col("msg_offset") / most).cast("long")).withColumn("ord", (F.col("msg_offset") % most).cast("int"))


def pushes(deliveries: DataFrame, refreshes: int = 2) -> DataFrame:
    """Deliveries of one message to a subscriber by delivery_no (0, 1, ...): pushed, or silently refreshed."""
    return deliveries.withColumn("pushed", F.col("delivery_no") % (refreshes + 1) == 0)


__all__ = ["candidates", "fan_out", "fetch", "fifo_polls", "has_deliverable", "lease", "lease_status", "pushes", "reserved", "select_poll"]
