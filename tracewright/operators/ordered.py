"""Ordered (window) operators that do not put a whole stream into one task.

One stream may hold a third of all rows. Rows are therefore ordered inside
buckets of (stream, bucket); what crosses a bucket border - a count, a running
maximum, the last record - is carried by a table with one row per bucket,
which is itself put in order per stream.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.config import BUCKET_ROWS

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, 0)


def sequence_bucket(order: Column, bucket_rows: int = BUCKET_ROWS) -> Column:
    """Bucket of a (nearly) dense ordinal such as the sequence or a line number."""
    return F.floor(order / F.lit(bucket_rows)).cast("long")


def spread_bucket(df: DataFrame, order: Column, bucket_rows: int = BUCKET_ROWS) -> Column:
    """Bucket of any integer order column: equal slices of its bulk.

    One pass gives the count and the range that holds 99.8 % of the values; the
    few outliers (a clock set to 1970) share a bucket at either end instead of
    stretching the slices. The borders are literals, so every branch that uses
    them agrees; results never depend on them, only balance does.
    """
    total, ends = df.agg(F.count(order), F.percentile_approx(order, [0.001, 0.999], 10_000)).first()
    if not total or total <= bucket_rows:
        return F.lit(0).cast("long")
    slices, (low, high) = math.ceil(total / bucket_rows), ends
    width = max(1, math.ceil((high - low + 1) / slices))
    slot = F.floor((order - F.lit(low)) / F.lit(width)).cast("long")
    return F.least(F.greatest(slot, F.lit(-1).cast("long")), F.lit(slices).cast("long"))


def _with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    # Both sides are partitioned like the window that follows, so the rows are
    # shuffled once and the carry is never broadcast.
    return df.join(carry.hint("shuffle_hash"), [*keys, "_bucket"], "left")


def number_rows(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "sequence",
                heads: DataFrame | None = None) -> DataFrame:
    """Consecutive numbers per key in the given order, continuing from the heads.

    ``heads``: keys + head_sequence, unique per key; a missing head counts as 0.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(*keys).orderBy("_bucket")
    carry = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(by_key.rowsBetween(*_BEFORE)), F.lit(0)))
    if heads is not None:
        carry = carry.join(heads.select(*keys, F.col("head_sequence").alias("_head")), keys, "left") \
            .withColumn("_offset", F.col("_offset") + F.coalesce("_head", F.lit(0)))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return _with_carry(rows, carry.select(*keys, "_bucket", "_offset"), keys) \
        .withColumn(name, F.row_number().over(local) + F.col("_offset")).drop("_bucket", "_offset")


def running_max(df: DataFrame, keys: list[str], order: str, value: str, name: str, *,
                heads: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Largest value up to each row, never below the head's value.

    ``heads``: keys + head_value, unique per key.
    """
    rows = df.withColumn("_bucket", sequence_bucket(F.col(order), bucket_rows))
    tops = rows.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    by_key = Window.partitionBy(*keys).orderBy("_bucket")
    carry = tops.withColumn("_floor", F.max("_top").over(by_key.rowsBetween(*_BEFORE)))
    if heads is not None:
        carry = carry.join(heads.select(*keys, "head_value"), keys, "left") \
            .withColumn("_floor", F.greatest("_floor", "head_value"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(*_UP_TO)
    return _with_carry(rows, carry.select(*keys, "_bucket", "_floor"), keys) \
        .withColumn(name, F.greatest(F.max(value).over(local), F.col("_floor"))).drop("_bucket", "_floor")


def with_previous(df: DataFrame, base: DataFrame, keys: list[str], order: list[str], values: list[str],
                  last_known: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add prev_<value> of the preceding present row, and the last non-null
    ``last_known`` before the row as prev_<last_known>.

    ``base`` holds the same rows with cheap columns only (keys, order, values):
    bucket ends are read from it, so work already done on ``df`` is not repeated.
    ``order[0]`` is an ordinal that gives the bucket; the rest breaks ties.
    """
    place = F.struct(*order)
    bucket = sequence_bucket(F.col(order[0]), bucket_rows)
    ends = [F.max_by(F.struct(*values), place).alias("_end")]
    if last_known:
        ends.append(F.max_by(last_known, F.when(F.col(last_known).isNotNull(), place)).alias("_known"))
    tails = base.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(*ends)
    by_key = Window.partitionBy(*keys).orderBy("_bucket")
    carry = tails.select(*keys, "_bucket", F.lag("_end").over(by_key).alias("_carried"), *(
        [F.last("_known", ignorenulls=True).over(by_key.rowsBetween(*_BEFORE)).alias("_carried_known")]
        if last_known else []))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = _with_carry(df.withColumn("_bucket", bucket), carry, keys)
    # A struct tells "no previous row" from "previous value is null".
    out = out.withColumn("_previous", F.coalesce(F.lag(F.struct(*values)).over(local), F.col("_carried")))
    if last_known:
        known = F.last(last_known, ignorenulls=True).over(local.rowsBetween(*_BEFORE))
        out = out.withColumn(f"prev_{last_known}", F.coalesce(known, F.col("_carried_known")))
    for value in values:
        out = out.withColumn(f"prev_{value}", F.col(f"_previous.{value}"))
    return out.withColumn("is_first", F.col("_previous").isNull()) \
        .drop("_bucket", "_carried", "_carried_known", "_previous")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """First n rows per key. Spark cuts each partition to n rows before the shuffle."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(place)).where(F.col(name) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, n: int, name: str = "position") -> DataFrame:
    """First n rows per key, for any n, without a task that holds a key or its first n rows.

    ``bucket`` must not decrease in the order given. Counts per bucket tell where each bucket starts; rows of buckets
    that start behind the n-th row are dropped before anything is ordered, the others are numbered bucket by bucket.
    ``df`` is read twice. Rows with a null key are one key.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(*keys).orderBy("_bucket")
    starts = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(by_key.rowsBetween(*_BEFORE)), F.lit(0))) \
        .where(F.col("_offset") < n).select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)],
                                            F.col("_bucket").alias("_at"), "_offset")
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{i}"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return rows.join(starts.hint("shuffle_hash"), same) \
        .withColumn(name, F.row_number().over(local) + F.col("_offset")).where(F.col(name) <= n).select(*df.columns, name)


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order values per key, by a partial aggregate."""
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")) \
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
