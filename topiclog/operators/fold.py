"""Ordered folds: one state for each key, rows in order, memory for the states of one key and one batch of rows only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(rows: DataFrame, key: str, order: str, start: Callable[[], Any], step: Callable[[Any, dict], Iterable[tuple]], schema: str, finish: Callable[[Any], Iterable[tuple]] | None = None) -> DataFrame:
    """What step(state, row) and finish(state) give for the rows of each key, by rising `order`.

    Rows are dealt out by key and sorted in their partitions, so a key is read as a stream: its rows never lie in memory
    together. A key's rows stay in one task, as each step needs the state that the step before left.
    """
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(StructType(_parse_datatype_string(schema).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []

        def flush(least: int):
            nonlocal out
            if len(out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
                out = []

        for batch in batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if state is None or row[key] != current:
                    if state is not None and finish:
                        out += finish(state)
                    current, state = row[key], start()
                out += step(state, row)
            yield from flush(10_000)
        if state is not None and finish:
            out += finish(state)
        yield from flush(1)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)
