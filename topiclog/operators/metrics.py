"""Gauges, exposition text, percentiles and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of the exposition.
GAUGES = {"topics": "Number of topics", "messages": "Number of retained messages across topics", "in_flight": "Number of leased (in-flight) messages"}
NODE_GAUGES = {
    "term": "Term of the writing node: how often the log got a new writer",
    "is_leader": "Whether this node writes the log (1 or 0)",
    "current_leader": "Number of the node that writes the log, 0 without one",
    "last_log_index": "Highest index in the log",
    "last_applied": "Highest index that the state contains",
    "millis_since_quorum_ack": "Milliseconds since the log was last stored",
}


def node_gauges(log: DataFrame, applied: DataFrame, node: int, leader: int | None, term: int, now_ms: int) -> DataFrame:
    """One row of NODE_GAUGES: log has cmd_seq and ts_ms, applied has cmd_seq; who writes, and in which term, is what the caller's cluster manager says."""
    last = log.agg(F.coalesce(F.max("cmd_seq"), F.lit(0)).cast("long").alias("last_log_index"), (F.lit(now_ms) - F.coalesce(F.max("ts_ms"), F.lit(now_ms))).cast("long").alias("millis_since_quorum_ack"))
    done = applied.agg(F.coalesce(F.max("cmd_seq"), F.lit(0)).cast("long").alias("last_applied"))
    facts = {"term": term, "is_leader": int(leader == node), "current_leader": leader or 0}
    return last.withColumn("__k", F.lit(0)).join(done.withColumn("__k", F.lit(0)), "__k").select(*(F.lit(v).cast("long").alias(k) for k, v in facts.items()), "last_log_index", "last_applied", "millis_since_quorum_ack")


def gauges(topics: DataFrame, messages: DataFrame, leases: DataFrame) -> DataFrame:
    """topics, messages, in_flight; leases count until they are swept, expired or not."""
    parts = [(topics.select("topic").distinct(), "topics"), (messages, "messages"), (leases, "in_flight")]
    rows = None
    for frame, name in parts:
        own = frame.agg(F.count("*").alias("value")).select(F.lit(name).alias("gauge"), "value")
        rows = own if rows is None else rows.unionAll(own)
    return rows.agg(*(F.max(F.when(F.col("gauge") == name, F.col("value"))).alias(name) for _, name in parts))


def exposition(values: DataFrame, node: int, prefix: str = "topiclog") -> DataFrame:
    """line_no and line of the text form of one row of gauges, of the node, the queue or both."""
    lines = []
    for name, help_text in {k: v for k, v in (NODE_GAUGES | GAUGES).items() if k in values.columns}.items():
        metric = f"{prefix}_{name}"
        lines += [F.lit(f"# HELP {metric} {help_text}"), F.lit(f"# TYPE {metric} gauge"), F.concat(F.lit(f'{metric}{{node="{node}"}} '), F.col(name).cast("string"))]
    return values.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def as_json(values: DataFrame, note: str = "") -> DataFrame:
    """One row of gauges as a JSON object from each name to its value and a note."""
    entries = [x for name in values.columns for x in (F.lit(name), F.struct(F.col(name).alias("value"), F.lit(note).alias("note")))]
    return values.select(F.to_json(F.create_map(*entries)).alias("json"))


def merge_json(stored: DataFrame, values: DataFrame, note: str = "") -> DataFrame:
    """A stored JSON object of metrics (one row, json; or none) with the gauges of one row put in: new names are added, known ones replaced, others stay."""
    kind = "map<string,struct<value:bigint,note:string>>"
    both = as_json(values, note).select(F.from_json("json", kind).alias("m"), F.lit(1).alias("__new")).unionByName(stored.select(F.from_json("json", kind).alias("m"), F.lit(0).alias("__new")))
    rows = both.select("__new", F.explode("m").alias("name", "entry"))
    last = rows.groupBy("name").agg(F.max_by("entry", "__new").alias("entry"))
    return last.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "entry"))))).alias("json"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the values at rank round((n - 1) * p), by counts of distinct values: no group is sorted in one task before it is reduced."""
    from pyspark.sql import Window

    counts = rows.groupBy(key, value).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(key, value, F.sum("__n").over(upto).alias("__to"), F.sum("__n").over(Window.partitionBy(key)).alias("__all"))
    rank = lambda p: F.floor((F.col("__all") - 1) * F.lit(p) + 0.5)
    return ranked.groupBy(key).agg(*(F.min(F.when(F.col("__to") > rank(p), F.col(value))).alias(name) for name, p in shares.items()))


def rate(n: Column, elapsed_s: Column) -> Column:
    return F.when(elapsed_s > 0, n / elapsed_s)


#: Where a chart's scale begins, and the least at which it ends.
AXIS_MIN, AXIS_END = 100.0, 1000.0


def chart(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with axis_max (the power of ten that no value exceeds), share (how far along a logarithmic axis the value's bar goes, 0 to 1) and label (the value as text)."""
    of = F.col(value).cast("double")
    top = rows.agg(F.greatest(F.lit(AXIS_END), F.pow(F.lit(10.0), F.ceil(F.log10(F.greatest(F.max(of), F.lit(AXIS_MIN)))))).alias("axis_max"))
    at = lambda x: F.log10(x) - F.log10(F.lit(AXIS_MIN))
    share = F.least(F.lit(1.0), at(F.greatest(of, F.lit(AXIS_MIN))) / at(F.col("axis_max")))
    label = F.when(of >= 1e6, F.format_string("%.1fM", of / 1e6)).otherwise(F.format_number(F.round(of), 0))
    return rows.withColumn("axis_max", top.scalar()).withColumns({"share": share, "label": label})
