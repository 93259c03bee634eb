"""Ordered logic over groups that may be too large for one task.

A plain window sorts a whole group in one task. The operators here split each
group into ordered buckets: rows are worked within (group, bucket), one summary
row per bucket is carried across the group, and the carry is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraflow.session import shuffled


def _with_carry(rows: DataFrame, carry: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with the carry of their bucket; a null key is a group like any other."""
    renamed = carry.withColumnsRenamed({c: f"_k_{c}" for c in names})
    same = F.lit(True)
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(renamed, same).drop(*[f"_k_{c}" for c in names])


def number_rows(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], name: str
) -> DataFrame:
    """1-based position of each row in its group.

    ``bucket`` must not decrease along ``order``. There may be nearly as many
    buckets as rows, so their carry is joined by a shuffle.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carry = sizes.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    return (
        _with_carry(df.withColumn("_rn", F.row_number().over(inside)), shuffled(carry), [*keys, bucket])
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("long"))
        .drop("_rn", "_before")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    name: str,
    bucket_rows: int = 65536,
) -> DataFrame:
    """Largest non-null ``value`` from the first row of the group to this one.

    ``position`` is a dense number within the group, so a bucket holds at most
    ``bucket_rows`` rows.
    """
    keys = list(keys)
    rows = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(position) / bucket_rows))
    top = rows.groupBy(*keys, "_b").agg(F.max("_v").alias("_top"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = top.select(*keys, "_b", F.max("_top").over(before).alias("_carry"))
    inside = W.partitionBy(*keys, "_b").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return (
        _with_carry(rows.withColumn("_in", F.max("_v").over(inside)), carry, [*keys, "_b"])
        .withColumn(name, F.greatest("_in", "_carry"))
        .drop("_v", "_b", "_in", "_carry")
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    name: str,
    bucket_rows: int = 65536,
) -> DataFrame:
    """``value`` of the row before this one in its group, null for the first."""
    keys = list(keys)
    rows = df.withColumn("_b", F.floor(F.col(position) / bucket_rows))
    tail = rows.groupBy(*keys, "_b").agg(F.max_by(value, position).alias("_tail"))
    group = W.partitionBy(*keys).orderBy("_b")
    carry = tail.select(*keys, "_b", F.lag("_tail").over(group).alias("_carry"))
    inside = W.partitionBy(*keys, "_b").orderBy(position)
    numbered = rows.withColumn("_prev", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    return (
        _with_carry(numbered, carry, [*keys, "_b"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_b", "_prev", "_first", "_carry")
    )


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    n: int,
    bucket_rows: int = 65536,
    descending: bool = False,
) -> DataFrame:
    """The ``n`` rows of each group with the smallest (largest) ``position``.

    Each bucket keeps its own ``n`` first, so the final ranking sees at most
    ``n`` rows per bucket.
    """
    keys = list(keys)
    order = F.col(position).desc() if descending else F.col(position).asc()
    rows = df.withColumn("_b", F.floor(F.col(position) / bucket_rows))
    return (
        rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)))
        .filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
        .filter(F.col("_r") <= n)
        .drop("_b", "_r")
    )
