"""Grid sweeps without crossing rows with the grid.

A decision rule swept over a sorted parameter grid is monotone: a row is
positive for a prefix of the grid (all t_i < p for ``p > t``; all m_i below
the row's break-even for the malus rule).  :func:`prefix_count` finds, per
row, the exact length of that prefix — arithmetically plus an exact
correction for uniform grids, by binary search over the grid literals
otherwise.  Rows
are then pre-aggregated into at most ``n + 1`` buckets, and
:func:`suffix_totals` turns bucket totals into per-grid-point totals with a
window over that tiny table.  Work is O(rows · log n) with map-side partial
aggregation; nothing of size rows × grid is ever produced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid_array(grid: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(g)) for g in grid])


def _uniform(grid: Sequence[float]) -> tuple[float, float] | None:
    if len(grid) < 2:
        return None
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    if step <= 0:
        return None
    ok = all(abs((grid[i] - grid[0]) - i * step) <= 1e-9 * max(1.0, abs(grid[i])) for i in range(len(grid)))
    return (grid[0], step) if ok else None


def prefix_count(grid: Sequence[float], positive_at: Callable[[Column], Column],
                 crossing: Column | None = None, inclusive: bool = False) -> Column:
    """Number of leading grid points where ``positive_at(t)`` holds (exact).

    ``positive_at`` must be true on a prefix of the (sorted) grid and false
    afterwards; null counts as false.  With ``crossing`` (the value x at
    which the rule flips: positive for t < x, or t <= x when ``inclusive``)
    and a uniform grid, the index is estimated arithmetically and then
    corrected with the exact predicate at the neighbouring grid points — pure
    codegen'd arithmetic.  Otherwise a binary search over the grid literals
    runs inside ``aggregate`` (log2(n) steps).
    """
    n = len(grid)
    arr = grid_array(grid)
    uni = _uniform(grid)
    if crossing is not None and uni is not None:
        a, step = uni
        pos = (crossing - F.lit(a)) / F.lit(step)
        est = (F.floor(pos) + 1) if inclusive else F.ceil(pos)
        k = F.least(F.greatest(est, F.lit(0)), F.lit(n)).cast("int")

        def at(i: Column) -> Column:
            return F.coalesce(positive_at(F.try_element_at(arr, i + 1)), F.lit(False))

        for _ in range(2):  # the estimate is off by at most one step; two exact corrections
            k = F.when((k < n) & at(k), k + 1).when((k > 0) & ~at(k - 1), k - 1).otherwise(k)
        return F.coalesce(k, F.lit(0))
    steps = max(1, math.ceil(math.log2(n + 1)))
    init = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step_fn(acc: Column, _: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = ((lo + hi) / 2).cast("int")
        open_ = lo < hi
        ok = F.coalesce(positive_at(F.element_at(arr, mid + 1)), F.lit(False))
        return F.struct(
            F.when(open_ & ok, mid + 1).otherwise(lo).alias("lo"),
            F.when(open_ & ~ok, mid).otherwise(hi).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step_fn, lambda acc: acc["lo"])


def suffix_totals(buckets: DataFrame, n: int, key: str, sums: Sequence[str]) -> DataFrame:
    """From totals per bucket k (0..n) to S(i) = Σ_{k > i} and P(i) = Σ_{k <= i} for i in 0..n-1.

    ``buckets`` has at most n + 1 rows; the windows run over that table only.
    """
    spark = buckets.sparkSession
    idx = spark.range(0, n + 1).select(F.col("id").cast("int").alias(key))
    full = idx.join(buckets, key, "left").fillna(0, subset=list(sums))
    w_suffix = Window.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    w_prefix = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = full
    for s in sums:
        out = out.withColumn(f"above_{s}", F.coalesce(F.sum(s).over(w_suffix), F.lit(0))).withColumn(
            f"upto_{s}", F.sum(s).over(w_prefix)
        )
    return out.where(F.col(key) < n)
