"""Shared builders for registered queries: basket tables and the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillsight.operators.features import discover_categories, feature_matrix
from tillsight.sources.basket import Basket, basket

# Fixture config for the excluded-discount rule: even store ids exclude two categories.
FIXTURE_EXCLUDED = {str(s): ["PROMO", "STANDARD"] for s in range(0, 25, 2)}


def tables(spark: SparkSession, sf_dir: str) -> Basket:
    return basket(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str, impute: bool = True, b: Basket | None = None) -> DataFrame:
    b = b or basket(spark, sf_dir, by_basket=True)
    categories = discover_categories(b.products)
    return feature_matrix(b.transactions, b.lines, b.products, b.stores, categories=categories, impute=impute)
