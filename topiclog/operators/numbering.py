"""Gapless numbers inside groups, and values carried along an order, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comparisons of a level: a value's range is found among FAN ** levels of them.
FAN = 16


def _range(value: Column, cuts: list[int], levels: int) -> Column:
    """How many of the sorted cuts (FAN ** levels - 1 of them) are at or below the value, by FAN - 1 comparisons a level."""
    found, n = F.lit(0), FAN**levels
    for level in range(levels):
        step = n // FAN ** (level + 1)
        # the cuts that part each range of the level before, one range after the other
        own = [cuts[start + (j + 1) * step - 1] for start in range(0, n, step * FAN) for j in range(FAN - 1)]
        table = F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>")
        at = found * (FAN - 1)
        steps = [(value >= (F.get(table, at + j) if level else F.lit(own[j]))).cast("int") for j in range(FAN - 1)]
        found = found * FAN + sum(steps[1:], steps[0])
    return found


def bucketed(rows: DataFrame, order: str, rows_per_bucket: int = 1_000_000) -> DataFrame | None:
    """rows with __bucket, which rises with `order` (an integer column, not null); None if one bucket is enough.

    Ranges come from quantiles of a sketch of all values, so gaps and outliers make no large bucket; beyond FAN ** 3 ranges each is cut
    into equal widths. The sketch and the count are one job each while the plan is built.
    """
    size = rows.agg(F.count("*"), F.min(order), F.max(order)).first()
    buckets = -(-size[0] // rows_per_bucket)
    if buckets <= 1:
        return None
    levels = next((k for k in (1, 2) if FAN**k >= buckets), 3)
    n = FAN**levels
    cuts = sorted(int(x) for x in rows.approxQuantile(order, [k / n for k in range(1, n)], 1 / (4 * n)))
    place = _range(F.col(order), cuts, levels)
    parts = -(-buckets // n)
    if parts > 1:
        ends = F.split(F.lit(",".join(map(str, [size[1], *cuts, size[2] + 1]))), ",").cast("array<bigint>")
        low, high = F.get(ends, place), F.get(ends, place + 1)
        inside = F.floor((F.col(order) - low).cast("double") * parts / F.greatest(high - low, F.lit(1)).cast("double"))
        place = place.cast("long") * parts + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))
    return rows.withColumn("__bucket", place.cast("long"))


def number(rows: DataFrame, group: list[str], order: str, name: str, rows_per_bucket: int = 1_000_000, at_most: int | None = None) -> DataFrame:
    """rows with `name`: 0, 1, 2 ... inside each group by the integer column `order` (unique in its group, not null).

    at_most is how many rows there can be, if the caller knows: where that is one bucket's worth, nothing needs counting.

    The range of `order` is cut into buckets of about rows_per_bucket rows. A row's number is
    the rows of its group in earlier buckets (sums of a small table of counts) plus its place in its own bucket. So a
    group that holds most of the rows is spread over all its buckets. The window over the table of counts has one row
    for each group and bucket.
    """
    cut = None if at_most is not None and at_most <= rows_per_bucket else bucketed(rows, order, rows_per_bucket)
    if cut is None:
        place = Window.partitionBy(*group).orderBy(order) if group else Window.orderBy(order)
        return rows.withColumn(name, (F.row_number().over(place) - 1).cast("long"))
    keys = [*group, "__bucket"]
    counts = cut.groupBy(*keys).count()
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return cut.withColumn("__place", local).join(base, keys).withColumn(name, F.col("__base") + F.col("__place")).drop("__bucket", "__base", "__place")


def carried(rows: DataFrame, group: list[str], order: str, value: str, name: str, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """rows with `name`: the last `value` that is not null of an earlier row of its group (by `order`, unique in its group), else null.

    Inside a bucket it is a window; what earlier buckets leave is the last value of each group and bucket, a small table.
    """
    cut = bucketed(rows, order, rows_per_bucket)
    behind = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if cut is None:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(behind.partitionBy(*group)))
    keys = [*group, "__bucket"]
    left = cut.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__left"))
    earlier = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = left.select(*keys, F.last("__left", ignorenulls=True).over(earlier).alias("__base"))
    local = cut.withColumn("__own", F.last(value, ignorenulls=True).over(behind.partitionBy(*keys)))
    return local.join(base, keys).withColumn(name, F.coalesce("__own", "__base")).drop("__bucket", "__own", "__base")
