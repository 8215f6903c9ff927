"""Places and running sums over many rows, without a task that holds all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range at least, on average, and ranges at most.
RANGE_ROWS, RANGES = 1_000_000, 1024
#: Ranges of values that aren't numbers.
HASHED = 128


def _tree(value: Column, bounds: list, lo: int, hi: int) -> Column:
    """The number of the first of bounds[lo:hi] that isn't below the value, by halving."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value <= F.lit(bounds[mid]), _tree(value, bounds, lo, mid)).otherwise(_tree(value, bounds, mid + 1, hi))


def range_bounds(df: DataFrame, value: str, ranges: int | None = None) -> list:
    """Values that cut df into ranges, ascending; without `ranges` as many as its rows fill, so none for few rows.

    Numbers are cut where a quantile sketch sees equal shares of the rows; it is merged from tasks,
    and only the bounds reach the driver. Other values are cut at some that come first by hash.
    """
    kind = dict(df.dtypes)[value]
    v = F.col(value)
    known = v.isNotNull()
    if kind in ("double", "float"):
        known = known & ~F.isnan(v)
    rows = df.where(known).select(v.alias("v"))
    if kind in ("double", "float", "tinyint", "smallint", "int", "bigint"):
        suffix = "double" if kind in ("double", "float") else "bigint"
        n, sketch = rows.agg(F.count("*"), F.expr(f"kll_sketch_agg_{suffix}(v)")).first()
        ranges = ranges or min(RANGES, n // RANGE_ROWS + 1)
        if ranges < 2 or not n:
            return []
        cuts = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
        found = df.sparkSession.range(1).select(F.lit(bytes(sketch)).alias("s")).select(F.call_function(f"kll_sketch_get_quantile_{suffix}", "s", cuts)).first()[0]
        return sorted(set(found))
    some = rows.distinct().orderBy(F.xxhash64("v"), "v").limit((ranges or HASHED) - 1).collect()
    return sorted(r.v for r in some)


def range_number(df: DataFrame, value: str, ranges: int | None = None) -> Column:
    """The range, from 0 on, that a value falls into; ranges ascend with the values (range_bounds)."""
    bounds = range_bounds(df, value, ranges)
    return _tree(F.col(value), bounds, 0, len(bounds))


def running(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), weight: str | None = None, ranges: Column | None = None, seen: DataFrame | None = None) -> DataFrame:
    """df with _upto, the sum of weight (or the number of rows) in `order` up to the row, within `by`, and _total, that of all.

    Rows are cut into ranges of the first column of order (or by `ranges`, which must ascend with
    the order); a task sorts one range of one key, and only the sums of the ranges are added up one
    after the other. Rows that are equal in `order` come in any order. Keys may be null.
    seen: rows with the same first column, from which bounds are taken if they are cheaper to read.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    if ranges is None:
        bounds = range_bounds(df if seen is None else seen, order[0])
        if not bounds:  # a key's rows fit a task
            own = Window.partitionBy(*by)
            return df.withColumn("_upto", F.sum(w).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum(w).over(own))
        ranges = _tree(F.col(order[0]), bounds, 0, len(bounds))
    keys = [*by, "_range"]
    cut = df.withColumn("_range", ranges)
    sums = cut.groupBy(*keys).agg(F.sum(w).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*by)).alias("_total"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("_in", F.sum(w).over(inside))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    out = placed.join(offsets, same)
    return out.select(*df.columns, (F.col("_in") + F.col("_before")).alias("_upto"), "_total")
