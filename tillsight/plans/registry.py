"""Query registry: name -> Spark builder, name -> SQL twin.

A registered builder takes ``(spark, sf_dir)`` and returns a DataFrame; its
twin is a DuckDB statement over the driver's tables.  ``finish`` rounds
doubles to 4 decimals and renders timestamps as text, and the SQL twins do
the same, so both sides can be hashed value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.plans.basket_sql import BASKET_CTES, LINE_AGG_CTES

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def finish(df: DataFrame, digits: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in keep:
            pass
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def basket_sql(body: str, extra_ctes: str = "", line_aggs: bool = False) -> str:
    ctes = BASKET_CTES
    if line_aggs:
        ctes += "," + LINE_AGG_CTES
    if extra_ctes:
        ctes += "," + extra_ctes
    return "WITH " + ctes + "\n" + body
