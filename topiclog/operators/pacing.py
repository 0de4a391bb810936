"""Token-bucket pacing and batch cuts: recurrences over the requests of a topic in order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclog.functions.scalars import BATCH_BYTES, BATCH_ITEMS
from topiclog.operators.fold import fold
from topiclog.operators.numbering import number

GRANTS = "topic string, request long, wanted int, granted int, retry_ms long, tokens double"


class Bucket:
    """Tokens of one topic; full when it is first used. Times come from the requests, never from a clock."""

    def __init__(self, rate: float, burst: int):
        self.limit(rate, burst)
        self.tokens, self.last = self.burst, None

    def limit(self, rate: float, burst: int) -> None:
        """From now on this rate and burst; the tokens stay."""
        self.rate, self.burst = rate, float(max(burst, 1))

    def take(self, now_ms: int, wanted: int) -> tuple[int, int | None]:
        """What is granted, and after a refusal the milliseconds until one token is there."""
        if self.last is not None:
            self.tokens = min(self.tokens + max(now_ms - self.last, 0) / 1000.0 * self.rate, self.burst)
        self.last = now_ms
        granted = min(math.floor(self.tokens), wanted)
        if not granted:
            return 0, math.ceil((1.0 - self.tokens) / self.rate * 1000.0) if self.rate > 0 else 1000
        self.tokens -= granted
        return granted, None

    def refund(self, unused: int) -> None:
        self.tokens = min(self.tokens + unused, self.burst)


def milli_rate(rate: float) -> int:
    """The stored rate; below 0.0005 a second it is 0, which means no limit."""
    return math.floor(rate * 1000 + 0.5)


def pace(requests: DataFrame, rate_milli: int, burst: int) -> DataFrame:
    """Requests (topic, request, ts_ms, wanted) with what a bucket for each topic grants. A rate of 0 grants everything."""

    def start():
        return Bucket(rate_milli / 1000.0, burst)

    def step(bucket, row):
        if not rate_milli:
            return [(row["topic"], row["request"], row["wanted"], row["wanted"], None, bucket.tokens)]
        granted, retry = bucket.take(row["ts_ms"], row["wanted"])
        return [(row["topic"], row["request"], row["wanted"], granted, retry, bucket.tokens)]

    return fold(requests.select("topic", "request", "ts_ms", "wanted"), "topic", "request", start, step, GRANTS)


#: Commands of a block that a task cuts at once.
BLOCK = 1 << 18


def _next(sizes: np.ndarray, items: int, cap: int) -> np.ndarray:
    """For each command the place behind a batch that begins with it, as far as these sizes tell."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    start = np.arange(len(sizes))
    return np.minimum(np.minimum(start + items, np.searchsorted(upto, upto[:-1] + cap, side="left")), len(sizes))


def byte_batches(log: DataFrame, items: int = BATCH_ITEMS, cap: int = BATCH_BYTES, block: int = BLOCK) -> DataFrame:
    """batch_id, n, bytes, first_arrival, last_arrival of batches over all topics: they end at `items` commands or once their bytes reach `cap` (above 0); the command that reaches it is still in.

    Where a batch ends depends on where it begins, so commands are cut into blocks, each with the `items` - 1 commands behind it, and each block says for every
    place where a batch that comes in from the left may begin (there are `items` of them) where the next block is entered and how many batches that makes. These small
    tables are chained in order, and the blocks then make their batches. A null payload has no bytes; arrival is unique.
    """
    block = max(block, items)
    sized = log.select("arrival", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("size"))
    placed = number(sized, [], "arrival", "place").withColumn("block", F.floor(F.col("place") / block).cast("long"))
    behind = placed.where((F.col("place") % block < items - 1) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    parts = placed.unionByName(behind)

    def ways(frame):
        """exits and batches of a block for each entry"""
        frame = frame.sort_values("place")
        own = int((frame["place"] // block == frame["block"].iloc[0]).sum())
        to = _next(frame["size"].to_numpy(), items, cap)[:own]
        # jump twice as far each time, until the block is left
        at, n = to.copy(), np.ones(own, np.int64)
        while (inside := at < own).any():
            at, n = np.where(inside, at[np.minimum(at, own - 1)], at), np.where(inside, n + n[np.minimum(at, own - 1)], n)
        entries = min(items, own)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "exits": [(at[:entries] - own).tolist()], "batches": [n[:entries].tolist()]})

    def chain(state, row):
        entry, batch = state["entry"], state["batch"]
        whole = entry < len(row["exits"])  # else a batch of the block before reaches beyond this one
        state["entry"] = row["exits"][entry] if whole else entry - len(row["exits"])
        state["batch"] += row["batches"][entry] if whole else 0
        return [(row["block"], entry, batch)]

    tables = parts.groupBy("block").applyInPandas(ways, "block long, exits array<long>, batches array<long>")
    entered = fold(tables.withColumn("__all", F.lit(0)), "__all", "block", lambda: {"entry": 0, "batch": 0}, chain, "block long, entry long, batch long")

    def cut(frame):
        frame = frame.sort_values("place")
        own = int((frame["place"] // block == frame["block"].iloc[0]).sum())
        sizes, arrivals = frame["size"].to_numpy(), frame["arrival"].to_numpy()
        to, at, starts = _next(sizes, items, cap), int(frame["entry"].iloc[0]), []
        while at < own:
            starts.append(at)
            at = int(to[at])
        ends = to[starts] if starts else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        starts = np.array(starts, np.int64)
        return pd.DataFrame({"batch_id": frame["batch"].iloc[0] + np.arange(len(starts)), "n": ends - starts, "bytes": upto[ends] - upto[starts], "first_arrival": arrivals[starts], "last_arrival": arrivals[ends - 1]})

    return parts.join(entered, "block").groupBy("block").applyInPandas(cut, "batch_id long, n long, bytes long, first_arrival long, last_arrival long")
