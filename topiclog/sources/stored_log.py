"""Scans and edits of a stored log: rows (idx, ...) ordered by idx, and key-value rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest frame body that is read.
FRAME_BYTES = 64 << 20


def scan_range(log: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows with start <= idx < end; None leaves that side open. Parquet skips row groups by the pushed bounds."""
    out = log if start is None else log.where(F.col("idx") >= start)
    return out if end is None else out.where(F.col("idx") < end)


def scan_prefix(rows: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return rows.where(F.col(key).startswith(prefix))


def bounds(log: DataFrame) -> DataFrame:
    """first_idx and last_idx, both null for an empty log."""
    return log.agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def log_state(log: DataFrame, purged: int | None) -> DataFrame:
    """purged_idx, and last_idx, which is the purge mark's while the log is empty."""
    mark = F.lit(purged).cast("long")
    return log.agg(F.coalesce(F.max("idx"), mark).alias("last_idx")).select(mark.alias("purged_idx"), "last_idx")


def get(rows: DataFrame, wanted, key: str = "key") -> DataFrame:
    """The row of one key, if there is one."""
    return rows.where(F.col(key) == wanted)


def overlay(stored: DataFrame, pending: DataFrame) -> DataFrame:
    """Every idx once: the pending row where there is one, else the stored one. Both have idx once at most."""
    return pending.unionByName(stored.join(pending.select("idx"), "idx", "left_anti"))


def append(log: DataFrame, entries: DataFrame, order: str | None = None) -> DataFrame:
    """The log after entries are written by their idx: an idx that is there is replaced. Where entries repeat an idx the last by `order` counts."""
    if order:
        others = [c for c in log.columns if c != "idx"]
        entries = entries.groupBy("idx").agg(F.max_by(F.struct(*others), order).alias("e")).select("idx", "e.*")
    return overlay(log, entries.select(*log.columns))


def write_log(log: DataFrame, path: str, files: int | None = None) -> None:
    """The log as Parquet, sorted and dealt out by ranges of idx, so that scan_range reads few row groups. Written beside and moved by the committer, so a reader sees all of it or nothing."""
    dealt = log.repartitionByRange(files, "idx") if files else log.repartitionByRange("idx")
    dealt.sortWithinPartitions("idx").write.mode("errorifexists").parquet(path)


def truncate_from(log: DataFrame, idx: int) -> DataFrame:
    return log.where(F.col("idx") < idx)


def purge_up_to(log: DataFrame, idx: int) -> DataFrame:
    return log.where(F.col("idx") > idx)


def purge_mark(old: Column, new: Column) -> Column:
    """The mark only moves forward."""
    return F.greatest(old, new)


def last_write_wins(writes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest write of each key; deletes are rows whose value is null, and take the key away."""
    others = [c for c in writes.columns if c != key]
    last = writes.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("w"))
    return last.select(key, "w.*").where(F.col("value").isNotNull())


def recover(state: DataFrame) -> DataFrame:
    """Rows (store, first_idx, last_idx, snapshot_idx, committed) with what a restart does to them.

    A log whose first entry does not follow the snapshot is dropped; a commit mark beyond what is left is dropped.
    """
    snapshot = F.coalesce("snapshot_idx", F.lit(0))
    drop_log = F.coalesce(F.col("first_idx") > snapshot + 1, F.lit(False))
    reach = F.when(drop_log, snapshot).otherwise(F.greatest(F.coalesce("last_idx", F.lit(0)), snapshot))
    drop_commit = F.coalesce(F.col("committed") > reach, F.lit(False))
    return state.select("store", drop_log.alias("drop_log"), drop_commit.alias("drop_commit"), F.when(~drop_commit, F.col("committed")).alias("committed"))


def write_frames(bodies: list[bytes]) -> bytes:
    """Bodies with their length in front, as unsigned 32-bit big-endian."""
    return b"".join(struct.pack(">I", len(b)) + b for b in bodies)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, at (number in the file) and body of each frame of the files; a frame that is cut off or too large ends its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                bodies, at = [], 0
                while at + 4 <= len(data):
                    (n,) = struct.unpack_from(">I", data, at)
                    if n > FRAME_BYTES or at + 4 + n > len(data):
                        break
                    bodies.append(data[at + 4 : at + 4 + n])
                    at += 4 + n
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(bodies), pa.string()), pa.array(range(len(bodies)), pa.int64()), pa.array(bodies, pa.binary())], names=["path", "at", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, at long, body binary")
