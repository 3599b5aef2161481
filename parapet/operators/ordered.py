"""Ordered computations without one task seeing all rows.

Rows are put into buckets of consecutive order values; each bucket is ordered
on its own and gets the total of the buckets before it as an offset.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from parapet.config import DEFAULT

BUCKET = "_bucket"
MIN_BUCKETS = 8  # small tables run the plan of large ones
QUANTILES = 1024  # measured bounds; more buckets divide the gaps between them evenly


def bucket_bounds(
    df: DataFrame, order: str, rows_per_bucket: int = DEFAULT.scale.rows_per_bucket
) -> list[float]:
    """Order values that split the rows into buckets of about equal size.

    Empty only for an empty table.  Only counts and quantiles reach the driver.
    """
    count = df.count()
    if not count:
        return []
    buckets = max(-(-count // rows_per_bucket), MIN_BUCKETS)
    measured = min(buckets, QUANTILES)
    shares = [i / measured for i in range(measured + 1)]
    found = df.agg(
        F.percentile_approx(F.col(order).cast("double"), shares, 10 * measured + 1000).alias("q")
    ).first()["q"]
    inner = sorted({float(q) for q in found or []})
    parts = -(-buckets // measured)
    return sorted({
        low + (high - low) * i / parts
        for low, high in zip(inner, inner[1:]) for i in range(parts)
    } | set(inner[-1:]))


def with_bucket(df: DataFrame, order: str, bounds: list[float]) -> DataFrame:
    """Add the bucket number, which grows with the order value."""
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0))
    cut = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")],
        inputCol="_order_value", outputCol="_bucket_value", handleInvalid="keep",
    )
    placed = cut.transform(df.withColumn("_order_value", F.col(order).cast("double")))
    return placed.withColumn(BUCKET, F.col("_bucket_value").cast("int")).drop(
        "_order_value", "_bucket_value"
    )


def match_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names; a null key matches a null key."""
    if not keys:
        return left.crossJoin(right)
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def sums_before(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: list[str],
    rows_per_bucket: int = DEFAULT.scale.rows_per_bucket,
    bounds: list[float] | None = None,
) -> DataFrame:
    """Per key, the sum of each value over all rows with a smaller order value.

    ``(keys, order)`` is unique; a null key is a key like others.  Adds ``<value>_before``.  The input is
    read more than once when it needs several buckets: hand in stored rows.
    """
    if bounds is None:
        bounds = bucket_bounds(df, order, rows_per_bucket)
    placed = with_bucket(df, order, bounds)
    inside = (
        Window.partitionBy(*keys, BUCKET).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.select(
        "*",
        *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{v}_before") for v in values],
    )
    if not bounds:
        return local.drop(BUCKET)
    # one row per key and bucket
    totals = placed.groupBy(*keys, BUCKET).agg(*[F.sum(v).alias(v) for v in values])
    earlier = (
        Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, BUCKET,
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}_offset") for v in values],
    )
    joined = match_nulls(local, offsets, [*keys, BUCKET])
    return joined.select(
        *df.columns,
        *[(F.col(f"{v}_before") + F.col(f"_{v}_offset")).alias(f"{v}_before") for v in values],
    )


def running_count(
    df: DataFrame, order: str, events: DataFrame, at: str, name: str, bounds: list[float]
) -> DataFrame:
    """Add how many ``events`` lie at or before each row's order value.

    Events become marker rows between the rows; a bucket counts its own and adds
    the count of the buckets before it, of which the driver sees one number each.
    """
    own = df.withColumn("_own", F.lit(True))
    marks = events.select(F.col(at).alias(order), F.lit(False).alias("_own"))
    placed = with_bucket(own.unionByName(marks, allowMissingColumns=True), order, bounds)
    totals = {
        r[BUCKET]: r["count"] for r in with_bucket(marks, order, bounds).groupBy(BUCKET).count().collect()
    }
    before, values = 0, []
    for number in range(len(bounds) + 1):
        values.append(before)
        before += totals.get(number, 0)
    inside = (
        Window.partitionBy(BUCKET).orderBy(order, "_own")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = placed.withColumn(name, F.count(F.when(~F.col("_own"), 1)).over(inside))
    offset = F.element_at(F.lit(values), F.col(BUCKET) + 1)
    return counted.where("_own").select(*df.columns, (F.col(name) + offset).cast("bigint").alias(name))
