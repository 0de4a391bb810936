"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word rules name it.
SPACE = r"[\x20\x09-\x0D]+"
#: Prefix of working columns; columns of the input with this prefix are not supported.
TMP = "__tl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order, split at ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Memo(dict):
    """Remembers what fn gave for short keys; forgets all but `fixed` when it is full, so memory stays bounded."""

    def __init__(self, fn: Callable, entries: int = 400_000, longest: int = 48, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.fn, self.fixed, self.entries, self.longest = fn, fixed or {}, entries + len(fixed or {}), longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
                self.update(self.fixed)
            self[key] = value
        return value


#: Bytes of text that the operators take at a time (a longer text is a slice of its own).
SLICE = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that no slice holds more than `most` bytes of text, unless one text alone does."""
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        if size.sum() <= most:
            yield batch
            continue
        start = total = 0
        for i, n in enumerate(size):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
