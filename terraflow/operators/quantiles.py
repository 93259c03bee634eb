"""Exact quantiles of very large groups by radix selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraflow.session import materialize, materialize_some

#: Four digits of 16 bits stand for a double: exponent and four bits of the mantissa, then 16 bits of it at a time.
DIGITS = 4
INFINITE, NOT_A_NUMBER = 40_000, 50_000


def with_digits(df: DataFrame, value: str, count: int) -> DataFrame:
    """The first ``count`` digits ``_d0`` ... of a double; they sort like the values, and all four tell two values apart.

    All steps are exact: powers of two, differences of neighbours and whole parts.
    """
    v = F.col(value)
    size = F.abs(v)
    plain = v.isNotNull() & ~F.isnan(v) & (size > 0) & (size < float("inf"))
    guess = F.floor(F.log2(F.when(plain, size)))
    rows = df.withColumn("_g", guess)
    fits = F.when(size >= F.pow(F.lit(2.0), F.col("_g") + 1), 1).when(size < F.pow(F.lit(2.0), F.col("_g")), -1).otherwise(0)
    rows = rows.withColumn("_e", F.col("_g") + fits)
    rows = rows.withColumn("_f", (size / F.pow(F.lit(2.0), F.col("_e")) - 1) * 16)
    way = F.when(v < 0, -1).otherwise(1)
    first = (F.col("_e") + 1100) * 16 + F.floor("_f")
    odd = F.when(F.isnan(v), NOT_A_NUMBER).when(size == float("inf"), INFINITE * way).when(size == 0, 0)
    rows = rows.withColumn("_d0", F.coalesce(odd, first * way).cast("int"))
    for k in range(1, count):
        rows = rows.withColumn("_f", (F.col("_f") - F.floor("_f")) * 65536)
        rows = rows.withColumn(f"_d{k}", F.coalesce(F.floor("_f") * way, F.lit(0)).cast("int"))
    return rows.drop("_g", "_e", "_f")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], summary: Mapping[str, str] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group.

    ``summary`` names further columns taken from the same counts: count, min,
    max, mean.

    The wanted ranks are narrowed down digit by digit. Each round counts, in the
    tasks that read the values, how many have which next digit among those that
    share the digits found so far; only these counts are shuffled, at most 65,536 rows for a
    group and rank, however its values are spread and however many equal one another. A
    rank is settled once its bucket has one value only, so values that
    differ in their first 20 bits of mantissa take two rounds. NaN is the largest value.
    Nulls don't count; a null key is a group like any other.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    hist = materialize(with_digits(rows, "_v", 1).groupBy(*keys, "_d0").agg(*counted, F.sum("_v").alias("_sum")), "digits")
    whole = [F.sum("_n").alias("_total"), F.min("_lo").alias("_least"), F.max("_hi").alias("_most"), F.sum("_sum").alias("_all")]
    totals = materialize(hist.groupBy(*keys).agg(*whole), "groups")

    place = {f"{name}_{side}": fn(F.lit(p) * (F.col("_total") - 1)).cast("long") for name, p in probs.items() for side, fn in (("lo", F.floor), ("hi", F.ceil))}
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), rank.alias("rank")) for name, rank in place.items()])
    wanted = totals.select(*keys, F.explode(ranks).alias("_w")).select(*keys, F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"), F.lit(0).cast("long").alias("_start"))
    settled = []
    for k in range(DIGITS):
        known = [*keys, *(f"_d{i}" for i in range(k))]
        if k:
            open_ = wanted.select(*[F.col(c).alias(f"_o_{c}") for c in known]).distinct()
            inside = with_digits(rows, "_v", k + 1).join(open_, _same(known, [f"_o_{c}" for c in known]), "left_semi")
            hist = inside.groupBy(*known, f"_d{k}").agg(*counted)
        before = W.partitionBy(*known).orderBy(f"_d{k}").rowsBetween(W.unboundedPreceding, -1)
        steps = hist.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        steps = steps.withColumnsRenamed({c: f"_h_{c}" for c in known})
        rest = F.col("_rank") - F.col("_start") - F.col("_before")
        hit = wanted.join(steps, _same(known, [f"_h_{c}" for c in known])).filter((rest >= 0) & (rest < F.col("_n")))
        one = F.col("_lo").eqNullSafe(F.col("_hi"))
        found = hit.select(*known, f"_d{k}", "_name", "_rank", (F.col("_start") + F.col("_before")).alias("_start"), "_lo", one.alias("_one"))
        found, more = materialize_some(found, "ranks", ~F.col("_one"))
        settled.append(found.filter("_one").select(*keys, "_name", "_lo"))
        wanted = found.filter("NOT _one").drop("_lo", "_one")
        if not more:
            break
    values = settled[0]
    for part in settled[1:]:
        values = values.unionByName(part)
    values = values.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(f"_{name}") for name in place])

    values = values.withColumnsRenamed({c: f"_q_{c}" for c in keys})
    out = totals.join(values, _same(keys, [f"_q_{c}" for c in keys]))
    figures = {"count": F.col("_total"), "min": F.col("_least"), "max": F.col("_most"), "mean": F.col("_all") / F.col("_total")}

    def between(name: str, p: float) -> Column:
        lo, hi, rank = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.lit(p) * (F.col("_total") - 1)
        return F.when(lo.eqNullSafe(hi), lo).otherwise(lo + (hi - lo) * (rank - F.floor(rank)))

    return out.select(
        *keys,
        *[figures[what].alias(name) for what, name in (summary or {}).items()],
        *[between(name, p).alias(name) for name, p in probs.items()],
    )
