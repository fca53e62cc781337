"""Null-semantics helpers.

The reference's dataframe library treats some all-null aggregates differently
from SQL; these wrappers encode those rules once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum0(x: str | Column) -> Column:
    """Sum of an all-null (or empty) group is 0."""
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def count_true(x: str | Column) -> Column:
    """Booleans summed as integers; null ignored; empty group -> 0."""
    return F.coalesce(F.sum(_c(x).cast("bigint")), F.lit(0).cast("bigint"))


def any_true(x: str | Column) -> Column:
    """any() of an all-null group is false."""
    return F.coalesce(F.bool_or(_c(x)), F.lit(False))


def left_join_spread(left: DataFrame, right: DataFrame, key: str, salts: int = 1024) -> DataFrame:
    """left ⟕ right on ``key``, with the null keys of ``left`` dealt out.

    A null key matches nothing, but a shuffle sends all of them to one task; here
    each goes under one of ``salts`` keys of its own, by a hash of its row, and
    keeps its row with nulls.
    """
    salt = F.when(F.col(key).isNull(), 1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    # always 0, but no constant: with one the optimizer would take the salt out of the join keys
    none = F.pmod(F.xxhash64(key), F.lit(1).cast("long"))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", none), [key, "_salt"], "left").drop("_salt")
