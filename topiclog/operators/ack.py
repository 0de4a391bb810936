"""Acknowledgement: watermarks, commits, reclaim, coalescing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclog.functions.scalars import ACK_BATCH, GROUP_GC_THRESHOLD
from topiclog.operators.numbering import number


def watermark(messages: DataFrame, acked: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The lowest offset that is not acked, or the next one to come: one row for each key of messages (key, msg_offset)."""
    key = key or ["topic"]
    marked = messages.select(*key, "msg_offset").join(acked.select(*key, "msg_offset", F.lit(True).alias("__a")), [*key, "msg_offset"], "left")
    return marked.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("__a").isNull(), F.col("msg_offset"))), F.max("msg_offset") + 1).alias("ack_watermark"))


def islands(acked: DataFrame, marks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Runs of acked offsets above the watermark: key, island_start, island_end, n.

    Offsets of a run and their numbers among the acked rise together, so their difference names the run.
    """
    key = key or ["topic"]
    above = acked.select(*key, "msg_offset").distinct().join(marks, key).where("msg_offset > ack_watermark")
    numbered = number(above, key, "msg_offset", "__n")
    runs = numbered.groupBy(*key, (F.col("msg_offset") - F.col("__n")).alias("__run"))
    return runs.agg(F.min("msg_offset").alias("island_start"), F.max("msg_offset").alias("island_end"), F.count("*").alias("n")).drop("__run")


def settle(acks: DataFrame, leases: DataFrame) -> DataFrame:
    """Each ack or nack with its outcome: the lease's offset, or a silent miss. The first answer to a lease counts."""
    key = ["topic", "grp", "lease_id"]
    first = acks.groupBy(*key).agg(F.min("cmd_seq").alias("__first"))
    joined = acks.join(leases.select(*key, "msg_offset"), key, "left").join(first, key)
    hit = F.col("msg_offset").isNotNull() & (F.col("cmd_seq") == F.col("__first"))
    return joined.select("cmd_seq", *key, "kind", F.when(hit, F.col("msg_offset")).alias("msg_offset"), F.when(hit, F.col("kind")).otherwise("miss").alias("outcome"))


def commit(marks: DataFrame, commits: DataFrame) -> DataFrame:
    """Watermarks after commits (topic, grp, commit_offset): never back, and beyond the log's end if a commit says so."""
    highest = commits.groupBy("topic", "grp").agg(F.max("commit_offset").alias("__to"))
    return marks.join(highest, ["topic", "grp"], "left").withColumn("ack_watermark", F.greatest("ack_watermark", "__to")).drop("__to")


def coalesce_acks(acks: DataFrame, most: int = ACK_BATCH) -> DataFrame:
    """One write for each topic, group and kind of every `most` acks in their order: batch_id, n, first_lease, last_lease, and lease_ids in the order of the acks."""
    numbered = number(acks, [], "cmd_seq", "__n").withColumn("batch_id", F.floor(F.col("__n") / most).cast("long"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__n", "lease_id"))), lambda x: x["lease_id"])  # `most` at most
    return numbered.groupBy("batch_id", "topic", "grp", "kind").agg(F.count("*").alias("n"), F.min("lease_id").alias("first_lease"), F.max("lease_id").alias("last_lease"), ids.alias("lease_ids"))


def reclaim(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages that the slowest group of their topic still needs; all of a topic without groups."""
    slowest = marks.groupBy("topic").agg(F.min("ack_watermark").alias("__low"))
    return messages.join(slowest, "topic", "left").where("__low is null or msg_offset >= __low").drop("__low")


def collect_idle_groups(groups: DataFrame, topics: DataFrame, threshold: int = GROUP_GC_THRESHOLD) -> DataFrame:
    """Groups that stay: in an empty topic with more than `threshold` of them, those that are caught up and hold nothing go.

    groups: topic, grp, ack_watermark, in_flight, acked_above. topics: topic, n_messages, next_offset.
    """
    many = groups.groupBy("topic").agg(F.count("*").alias("__n"))
    joined = groups.join(many, "topic").join(topics, "topic")
    idle = (F.col("__n") > threshold) & (F.col("n_messages") == 0) & (F.col("ack_watermark") >= F.col("next_offset")) & (F.col("in_flight") == 0) & (F.col("acked_above") == 0)
    return joined.where(~idle).select(*groups.columns)
