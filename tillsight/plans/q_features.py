"""Registered queries: feature matrix and the minimum slice (certain frauds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import rules
from tillsight.plans.basket_sql import feature_sql
from tillsight.plans.common import features
from tillsight.plans.registry import finish, register

_FM_DOUBLES = [
    "total_amount", "damage", "price_unscanned_articles", "popularity_max", "popularity_min", "max_product_price",
    "calculated_price_difference", "mean_time_between_scans", "max_time_between_scans",
    "time_to_first_scan", "time_from_last_scan_to_end",
]


def fm_select_sql(src: str = "fm") -> str:
    rounded = ", ".join(f"ROUND({c}, 4) AS {c}" for c in _FM_DOUBLES)
    return f"SELECT * REPLACE ({rounded}) FROM {src}"


@register("feature_matrix", feature_sql(fm_select_sql("fm")))
def q_feature_matrix(spark, sf_dir):
    """Imputed basket feature matrix."""
    return finish(features(spark, sf_dir))


@register("feature_matrix_raw", feature_sql(fm_select_sql("fm0")))
def q_feature_matrix_raw(spark, sf_dir):
    """Same matrix before the label-wise imputation (nulls kept)."""
    return finish(features(spark, sf_dir, impute=False))


@register(
    "certain_frauds",
    feature_sql(
        "SELECT transaction_id, TRUE AS is_fraud, ROUND(CAST(CAST(1.0 AS FLOAT) AS DOUBLE), 4) AS fraud_proba, "
        "ROUND(CAST(CAST(price_unscanned_articles AS FLOAT) AS DOUBLE), 4) AS estimated_damage "
        "FROM fm WHERE has_missing OR has_unscanned"
    ),
)
def q_certain_frauds(spark, sf_dir):
    """R6 (minimum slice): baskets that are fraud for sure, with the unpaid amount."""
    return finish(rules.certain_frauds(features(spark, sf_dir, impute=False)))
