"""Idempotent produce: deduplication by producer and sequence number, offsets, batches."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclog.functions.scalars import BATCH_ITEMS, DEDUP_CAPACITY
from topiclog.operators.fold import fold
from topiclog.operators.numbering import number

KEY = ["topic", "producer_id", "seq"]


def _keyed(log: DataFrame) -> DataFrame:
    return log.where("producer_id <> ''")


class _Known:
    """The last `cap` accepted keys of a topic, oldest first, each with the arrival that was accepted."""

    def __init__(self, cap: int):
        self.cap, self.arrivals = cap, OrderedDict()

    def first(self, key: tuple, arrival: int) -> int:
        if key not in self.arrivals:
            self.arrivals[key] = arrival
            if len(self.arrivals) > self.cap:
                self.arrivals.popitem(last=False)
        return self.arrivals.get(key, arrival)


def _crowded(log: DataFrame, cap: int | None, size: int | None = None) -> DataFrame | None:
    """The topics with more than `cap` distinct keys, or None. Topics with no more rows than that are not looked into, nor a log of `size` rows, if that is known."""
    if cap is None or (size is not None and size <= cap):
        return None
    keyed = _keyed(log)
    large = keyed.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("topic")
    if large.isEmpty():
        return None
    found = keyed.join(large, "topic", "left_semi").select(*KEY).distinct().groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("topic")
    return None if found.isEmpty() else found


def _firsts(log: DataFrame, cap: int) -> DataFrame:
    """topic, arrival and first_arrival (the accepted one that the command repeats, or its own) of each command with a producer, in topics that forget keys."""
    step = lambda known, row: [(row["topic"], row["arrival"], known.first((row["producer_id"], row["seq"]), row["arrival"]))]
    return fold(_keyed(log).select(*KEY, "arrival"), "topic", "arrival", lambda: _Known(cap), step, "topic string, arrival long, first_arrival long")


def accepted(log: DataFrame, rows_per_bucket: int = 1_000_000, cap: int | None = DEDUP_CAPACITY) -> DataFrame:
    """The produce commands that append a message, with msg_offset: the first of each (topic, producer_id, seq), and all without a producer.

    A topic remembers its last `cap` accepted keys (None: all). While it has no more distinct ones, that is a minimum, combined before the shuffle; topics
    with more, found by counting, go through their commands in order, one task each. A log of no more than `cap` rows has none.
    """
    size = log.count()
    crowded = _crowded(log, cap, size)
    calm = log if crowded is None else log.join(crowded, "topic", "left_anti")
    first = _keyed(calm).groupBy(*KEY).agg(F.min("arrival").alias("arrival"))
    kept = calm.join(first, [*KEY, "arrival"], "left_semi")
    if crowded is not None:
        own = log.join(crowded, "topic", "left_semi")
        fresh = _firsts(own, cap).where("arrival = first_arrival").select("topic", "arrival")
        kept = kept.unionByName(_keyed(own).join(fresh, ["topic", "arrival"], "left_semi").select(*kept.columns))
    kept = kept.select(*log.columns).unionByName(log.where("producer_id = '' or producer_id is null"))
    return number(kept, ["topic"], "arrival", "msg_offset", rows_per_bucket, size)


def offsets(log: DataFrame, cap: int | None = DEDUP_CAPACITY, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Every command with the offset that it is answered with; a duplicate gets the original's."""
    size = log.count()
    crowded = _crowded(log, cap, size)
    if crowded is None:  # the first arrivals alone are numbered; no command is dealt out for that
        first = log.groupBy(*KEY, F.when(F.coalesce("producer_id", F.lit("")) == "", F.col("arrival")).alias("__own")).agg(F.min("arrival").alias("first_arrival"))
        known = number(first, ["topic"], "first_arrival", "msg_offset", rows_per_bucket, size).select("topic", "msg_offset", "first_arrival", *(F.col(c).alias(f"__{c}") for c in KEY[1:]), "__own")
        free = F.when(F.coalesce("producer_id", F.lit("")) == "", F.col("arrival"))
        same = (log["topic"] == known["topic"]) & log["producer_id"].eqNullSafe(known["__producer_id"]) & log["seq"].eqNullSafe(known["__seq"]) & free.eqNullSafe(known["__own"])
        joined = log.join(known, same).drop(known["topic"], "__producer_id", "__seq", "__own")
        return joined.withColumn("duplicate", F.col("arrival") != F.col("first_arrival")).drop("first_arrival")
    kept = accepted(log, rows_per_bucket, cap).select(*KEY, F.col("arrival").alias("first_arrival"), "msg_offset")
    calm = log.join(crowded, "topic", "left_anti").select(*log.columns)
    keyed = _keyed(calm).join(kept.where("producer_id <> ''").join(crowded, "topic", "left_anti"), KEY)
    again = _firsts(log.join(crowded, "topic", "left_semi"), cap)
    named = _keyed(log).join(again, ["topic", "arrival"]).join(kept.select("topic", "first_arrival", "msg_offset"), ["topic", "first_arrival"])
    keyed = keyed.unionByName(named.select(*keyed.columns))
    free = log.where("producer_id = '' or producer_id is null").join(kept.select("topic", "first_arrival", "msg_offset"), (log["arrival"] == kept["first_arrival"]) & (log["topic"] == kept["topic"])).drop(kept["topic"])
    return keyed.unionByName(free.select(*keyed.columns)).withColumn("duplicate", F.col("arrival") != F.col("first_arrival")).drop("first_arrival")


def attempts(log: DataFrame, cap: int | None = DEDUP_CAPACITY) -> DataFrame:
    """topic, attempts, accepted, duplicates."""
    per_key = log.groupBy(*KEY).agg(F.count("*").alias("n"))
    new = F.when(F.coalesce("producer_id", F.lit("")) == "", F.col("n")).otherwise(1)
    found = per_key.groupBy("topic").agg(F.sum("n").alias("attempts"), F.sum(new).alias("accepted"))
    crowded = _crowded(log, cap)
    if crowded is not None:
        more = _firsts(log.join(crowded, "topic", "left_semi"), cap).groupBy("topic").agg(F.count_if(F.col("arrival") == F.col("first_arrival")).alias("a"))
        free = log.where("producer_id = '' or producer_id is null").groupBy("topic").agg(F.count("*").alias("f"))
        exact = more.join(free, "topic", "left").select("topic", (F.col("a") + F.coalesce("f", F.lit(0))).alias("exact"))
        found = found.join(exact, "topic", "left").select("topic", "attempts", F.coalesce("exact", "accepted").alias("accepted"))
    return found.withColumn("duplicates", F.col("attempts") - F.col("accepted"))


def batch_replies(log: DataFrame, items: int = BATCH_ITEMS, cap: int | None = DEDUP_CAPACITY) -> DataFrame:
    """batch_id, item, topic, arrival, msg_offset: batches of `items` commands over all topics, written as one, and the reply to each command by its place."""
    placed = number(log.select("topic", "arrival"), [], "arrival", "__n")
    answered = offsets(log, cap).select("topic", "arrival", "msg_offset")
    return placed.join(answered, ["topic", "arrival"]).select(F.floor(F.col("__n") / items).cast("long").alias("batch_id"), (F.col("__n") % items).cast("int").alias("item"), "topic", "arrival", "msg_offset")


def count_batches(log: DataFrame, items: int = BATCH_ITEMS) -> DataFrame:
    """batch_id, n, bytes, first_arrival, last_arrival of batches of `items` commands in order of arrival."""
    numbered = number(log, [], "arrival", "place")
    return numbered.groupBy(F.floor(F.col("place") / items).cast("long").alias("batch_id")).agg(
        F.count("*").alias("n"),
        F.sum(F.octet_length("payload")).cast("long").alias("bytes"),
        F.min("arrival").alias("first_arrival"),
        F.max("arrival").alias("last_arrival"),
    )


def topics_in_order(log: DataFrame) -> DataFrame:
    """The distinct topics with the arrival that names them first."""
    return log.groupBy("topic").agg(F.min("arrival").alias("first_arrival"))


def delete_epochs(log: DataFrame, deletes: DataFrame) -> DataFrame:
    """Commands with the number of deletes (topic, deleted_at) of their topic before them: offsets and keys begin anew in each epoch."""
    marks = deletes.groupBy("topic").agg(F.array_sort(F.collect_list("deleted_at")).alias("marks"))
    joined = log.join(marks, "topic", "left")
    epoch = F.coalesce(F.size(F.filter("marks", lambda x: x < F.col("arrival"))), F.lit(0))
    return joined.withColumn("epoch", F.when(F.col("marks").isNull(), 0).otherwise(epoch).cast("int")).drop("marks")
