"""Deterministic sorting, sampling, splits and folds.

Every random choice is an order by ``md5(concat(key, seed))``, so Spark and
any SQL engine agree and re-runs (or recomputed partitions after an executor
loss) give the same rows.  ``rand()``, ``randomSplit`` and ``sampleBy`` are
neither comparable nor exact.

Exact per-stratum ranks (needed for exact stratified split sizes) would
normally be a window partitioned by the stratum — one task per label, the
majority class holding ~97 % of the rows.  :func:`stratified_rank` instead
splits every stratum into 16^k hash-prefix buckets: bucket sizes are one small
aggregate, their running offsets a window over ≤ strata × 16^k rows
(broadcast), and row numbers are taken per (stratum, bucket).  The rank is
exact and no task sees more than one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str | Column, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(str(seed))))


def stratified_rank(df: DataFrame, strata: Sequence[str], key: str, seed: int, prefix_chars: int = 3,
                    rank_col: str = "rank", size_col: str = "n_stratum") -> DataFrame:
    """Exact 1-based rank of each row within its stratum by md5(key || seed)."""
    d = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, prefix_chars))
    sizes = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *strata, "_b",
        F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"),
        F.sum("_nb").over(Window.partitionBy(*strata)).alias(size_col),
    )
    # offsets: ≤ (#strata × 16^prefix_chars) rows — bounded, broadcast
    j = d.join(F.broadcast(offsets), [*strata, "_b"], "inner")
    w = Window.partitionBy(*strata, "_b").orderBy("_h", key)
    return j.withColumn(rank_col, F.col("_off") + F.row_number().over(w)).drop("_h", "_b", "_off")


# ---------------------------------------------------------------- O1 / O2
def sort(df: DataFrame, keys: Sequence[str], ascending: Sequence[bool]) -> DataFrame:
    """O1: multi-key sort."""
    return df.orderBy(*[F.col(k).asc() if a else F.col(k).desc() for k, a in zip(keys, ascending)])


def top_k(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    """O2: the k largest values (TakeOrderedAndProject; ties broken by ``tie``)."""
    return df.orderBy(F.desc(col), F.asc(tie)).limit(k)


# ---------------------------------------------------------------- O4 / O10
def sample_one(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One reproducible random row."""
    return df.orderBy(hash_order(key, seed), F.col(key)).limit(1)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Reproducible permutation (range-partitioned global sort)."""
    return df.withColumn("shuffle_pos", hash_order(key, seed)).orderBy("shuffle_pos", key)


# ---------------------------------------------------------------- O5 / O6 / O7
def balanced(df: DataFrame, cls: Column | str, key: str, seed: int) -> DataFrame:
    """Down-sample every class to the size of the smallest one."""
    c = F.col(cls) if isinstance(cls, str) else cls
    d = df.withColumn("_cls", c)
    r = stratified_rank(d, ["_cls"], key, seed)
    smallest = d.groupBy("_cls").count().agg(F.min("count")).scalar()
    return r.where(F.col("rank") <= smallest).drop("_cls", "rank", "n_stratum")


def normals_plus_frauds(df: DataFrame, n_normal: int, key: str, seed: int, label: str = "label") -> DataFrame:
    """A fixed-size sample of NORMAL baskets united with all FRAUD baskets."""
    normals = df.where(F.col(label) == "NORMAL")
    picked = stratified_rank(normals, [label], key, seed).where(F.col("rank") <= n_normal).drop("rank", "n_stratum")
    return picked.unionByName(df.where(F.col(label) == "FRAUD"))


def damage_only(df: DataFrame) -> DataFrame:
    """Rows with positive damage."""
    return df.where(F.col("damage") > 0)


# ---------------------------------------------------------------- O8 / O9
def split(df: DataFrame, strata: Sequence[str], key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact stratified train/test split; test = first round(n_stratum · test) rows by hash."""
    r = stratified_rank(df, strata, key, seed) if strata else _plain_rank(df, key, seed)
    n_test = F.round(F.col("n_stratum") * F.lit(test)).cast("bigint")
    return r.withColumn("split", F.when(F.col("rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))).drop("rank", "n_stratum")


def _plain_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    d = df.withColumn("_all", F.lit(0))
    return stratified_rank(d, ["_all"], key, seed).drop("_all")


def folds(df: DataFrame, strata: Sequence[str], key: str, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Repeated stratified k-fold assignment (key, repeat, fold); fold = (rank - 1) mod k."""
    out = None
    base = df.select(key, *strata)
    for r in range(repeats):
        ranked = stratified_rank(base, strata, key, seed + r)
        one = ranked.select(key, F.lit(r).alias("repeat"), ((F.col("rank") - 1) % k).cast("int").alias("fold"))
        out = one if out is None else out.unionByName(one)
    return out
