"""Connected components of a link table: few links in one task, more by alternating large-star and small-star steps."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most distinct links that one task connects by itself (16 bytes each); more of them take star steps.
FEW = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir).

    Only a local master without one gets a temporary folder; a cluster without one is an error, as its
    executors would not share it.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder and read from there: its lineage ends here."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread_join(rows: DataFrame, named: DataFrame, key: str, hot: int = 100_000) -> DataFrame:
    """rows with the columns of named, which has each key once and n, the number of rows with it (dropped from the result).

    Keys of more than `hot` rows, of which there can be one in `hot` rows at most, are broadcast, so none of them comes together in one task.
    """
    often = named.where(F.col("n") > hot).drop("n")
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(named.where(F.col("n") <= hot).drop("n"), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


class Forest:
    """Union by smallest index over arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.root[i], self.root[j]
            apart = i != j
            i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
            np.minimum.at(self.root, j, i)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of whole components -> (node, root) of every node that is not its component's smallest."""
    whole = pa.Table.from_batches([*batches, pa.RecordBatch.from_pydict({"u": [], "v": []}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))])
    nodes, places = np.unique(np.concatenate([whole.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    forest, n = Forest(len(nodes)), whole.num_rows
    forest.link(places[:n], places[n:])
    others = np.flatnonzero(forest.root != np.arange(len(nodes)))
    for k in range(0, len(others), 1 << 16):
        own = others[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[forest.root[own]])], names=["node", "root"])


def connected(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node that is not its component's root; links has the columns a and b, of one integer type.

    The root is the component's smallest node. Null ends and self links are ignored, repeated
    links count once, no links give no rows. Each step holds as many rows as there are links and ends in a
    checkpoint, so a lost executor costs one step at most; the number of steps grows with the
    logarithm of a component's diameter. Up to `few` links are connected by one task instead, without any shuffle of theirs.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= few:
        kind = edges.schema["u"].dataType.simpleString()
        found = edges.select(*(F.col(c).cast("long").alias(c) for c in "uv")).coalesce(1).mapInArrow(_at_once, "node long, root long")
        return cut(found.select(*(F.col(c).cast(kind).alias(c) for c in ("node", "root"))))
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        rest = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut(rest.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
