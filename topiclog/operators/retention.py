"""Retention by count and age, and the configuration in force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclog.operators.numbering import carried
from topiclog.operators.replay import purge_fold


def retained(messages: DataFrame, most: int = 0, age_ms: int = 0) -> DataFrame:
    """What is left after the last accepted produce, where ts_ms never falls with the offset (else use kept); 0 switches a limit off."""
    last = messages.groupBy("topic").agg(F.max(F.struct("msg_offset", "ts_ms")).alias("__last"))
    joined = messages.join(last, "topic")
    keep = F.lit(True)
    if most:
        keep = keep & (F.col("msg_offset") > F.col("__last.msg_offset") - most)
    if age_ms:
        keep = keep & (F.greatest(F.col("__last.ts_ms") - F.col("ts_ms"), F.lit(0)) <= age_ms)
    return joined.where(keep).drop("__last")


def kept(messages: DataFrame, most: int = 0, age_ms: int = 0) -> DataFrame:
    """What is left after the last accepted produce, whatever the times.

    Age stops at the first young message, so topics whose times fall somewhere (found by the gaps between neighbours, a job of its own where there
    is a limit of age) go through their messages in order; for the others it is a comparison with the last message.
    """
    if age_ms:
        falling = inter_arrival(messages).where("gap_ms < 0").select("topic").distinct()
        if not falling.isEmpty():
            ends = purge_fold(messages.join(falling, "topic", "left_semi"), most, age_ms).groupBy("topic").agg(F.max_by("first_retained", "msg_offset").alias("__first"))
            odd = messages.join(ends, "topic").where("msg_offset >= __first").drop("__first")
            return retained(messages.join(falling, "topic", "left_anti"), most, age_ms).select(*messages.columns).unionByName(odd.select(*messages.columns))
    return retained(messages, most, age_ms).select(*messages.columns)


def config_in_force(produces: DataFrame, configs: DataFrame, values: list[str], rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Produces (topic, cmd_seq) with the last configuration (topic, cmd_seq, values) before them; null where there is none.

    Both are one stream in order of cmd_seq, along which the configuration is carried; configurations of one number come after its produce.
    """
    row, held = F.struct(*(F.col(f"`{c}`") for c in produces.columns)), F.struct(*values)
    kind = configs.select(held.alias("c")).schema["c"].dataType
    whole = produces.select("topic", (2 * F.col("cmd_seq")).alias("__at"), F.lit(None).cast(kind).alias("__c"), row.alias("__row"))
    marks = configs.select("topic", (2 * F.col("cmd_seq") + 1).alias("__at"), held.alias("__c"), F.lit(None).cast(whole.schema["__row"].dataType).alias("__row"))
    known = carried(whole.unionByName(marks), ["topic"], "__at", "__c", "__held", rows_per_bucket).where("__row is not null")
    return known.select("__row.*", *(F.col(f"__held.{v}").alias(v) for v in values))


def rate_limits(configs: DataFrame) -> DataFrame:
    """The last rate limit of each topic (topic, cmd_seq, rate_milli_per_sec, burst): active above a rate of 0, with a burst of at least 1."""
    last = configs.groupBy("topic").agg(F.max_by(F.struct("rate_milli_per_sec", "burst"), "cmd_seq").alias("c"))
    return last.select("topic", "c.rate_milli_per_sec", F.greatest("c.burst", F.lit(1)).alias("burst"), (F.col("c.rate_milli_per_sec") > 0).alias("active"))


def inter_arrival(messages: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """topic, gap_ms between neighbouring messages (ts_ms is not null)."""
    before = carried(messages.select("topic", "msg_offset", "ts_ms"), ["topic"], "msg_offset", "ts_ms", "__before", rows_per_bucket)
    return before.select("topic", (F.col("ts_ms") - F.col("__before")).alias("gap_ms")).where("gap_ms is not null")
