"""Exact quantiles (linear interpolation) without one task holding a group's values.

Spark's ``percentile`` keeps a counter per distinct value of the group in one
aggregation buffer — for a global quantile over 100 TB that is every distinct
value in a single task.  Here:

1. rows are counted per (group, distinct value) with map-side partial
   aggregation;
2. distinct values are spread over buckets per group, cut at approximate
   quantiles of the distinct values, so neither outliers nor frequent values
   fill one bucket; bucket totals give running offsets (a window over
   ≤ groups × buckets rows, broadcast back);
3. a window partitioned by (group, bucket) gives, for every distinct value,
   the number of rows below it;
4. the two ranks around p·(n − 1) are picked by a per-row predicate in one
   final aggregate per group, and interpolated.

Same definition as ``percentile`` / SQL ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_bounds(value: str | Column, buckets: int) -> Column:
    """Aggregate: at most ``buckets`` - 1 ascending cut points with about as many of the group's rows between any two."""
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return F.percentile_approx(value, points, F.lit(20 * buckets))


def bucket_of(value: Column, bounds: Column, buckets: int) -> Column:
    """Number of cut points below ``value``, by bisection; a null ``bounds`` is one bucket."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(buckets.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(bounds, i + s - 1) < value, i + s).otherwise(i))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, buckets: int = 1024) -> DataFrame:
    """One row per group: ``by`` columns + one double column per probability."""
    by = list(by)
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]
    x = F.col(col).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*by, x.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    stats = [F.sum("_c").alias("_n"), bucket_bounds("_v", buckets).alias("_bounds")]
    if by:
        c = counts.join(F.broadcast(counts.groupBy(*by).agg(*stats)), by)  # one row per group
    else:  # one global group: a single struct scalar subquery
        g0 = counts.agg(F.struct(*stats)).scalar()
        c = counts.select("*", g0["_n"].alias("_n"), g0["_bounds"].alias("_bounds"))
    c = c.withColumn("_b", bucket_of(F.col("_v"), F.col("_bounds"), buckets)).drop("_bounds")
    tot = c.groupBy(*by, "_b").agg(F.sum("_c").alias("_nb"))
    prior = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "_b", F.coalesce(F.sum("_nb").over(prior), F.lit(0)).alias("_off"))  # ≤ groups × buckets rows
    c = c.join(F.broadcast(off), [*by, "_b"])
    w = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_before", F.col("_off") + F.coalesce(F.sum("_c").over(w), F.lit(0)))

    def hit(k):
        return (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))

    aggs = []
    for p, name in zip(probs, names):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [
            F.max(F.when(hit(F.floor(h)), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(hit(F.ceil(h)), F.col("_v"))).alias(f"_hi_{name}"),
            F.first(h - F.floor(h)).alias(f"_fr_{name}"),
        ]
    g = c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)  # a global aggregate: one row even when empty
    return g.select(*by, *[
        (F.col(f"_lo_{n}") + F.col(f"_fr_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in names
    ])
