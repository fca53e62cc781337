"""Registered queries: static rules, cascade, responses, batch prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.functions import scalar as S
from tillsight.operators import rules
from tillsight.plans.basket_sql import feature_sql
from tillsight.plans.common import FIXTURE_EXCLUDED, features, tables
from tillsight.plans.registry import finish, register

_EXCL_VALUES = ", ".join(f"('{s}', '{c}')" for s, cats in FIXTURE_EXCLUDED.items() for c in cats)
SCORE_SQL = (
    "ROUND(1.0 / (1.0 + exp(-(-2.0 + 1.5 * CAST(payment_medium = 'CASH' AS DOUBLE) + 0.02 * CAST(n_lines AS DOUBLE)"
    " + 0.8 * CAST(COALESCE(has_positive_price_difference, FALSE) AS DOUBLE)))), 6)"
)
SCORED_CTE = f"""
scored AS (
  SELECT fm.*, {SCORE_SQL} AS p, ROUND(0.0001 * total_amount, 4) AS damage_pred FROM fm
)"""

RULE_CTES = f"""
r1 AS (SELECT t.id AS transaction_id FROM transactions t
       WHERE NOT EXISTS (SELECT 1 FROM transaction_lines l WHERE l.transaction_id = t.id)),
ul AS (SELECT transaction_id, product_id FROM transaction_lines
       WHERE was_voided AND sales_price = 0 AND NOT COALESCE(camera_product_similar, FALSE)),
r3 AS (
  SELECT f.transaction_id,
         COALESCE((SELECT SUM(p.price) FROM products p
                   WHERE p.id IN (SELECT u.product_id FROM ul u WHERE u.transaction_id = f.transaction_id)), 0.0) AS damage,
         (SELECT string_agg(COALESCE(CAST(u.product_id AS VARCHAR), 'None'), ', '
                            ORDER BY COALESCE(CAST(u.product_id AS VARCHAR), 'None'))
          FROM ul u WHERE u.transaction_id = f.transaction_id) AS products
  FROM fm f WHERE f.has_unscanned
),
excl AS (SELECT * FROM (VALUES {_EXCL_VALUES}) AS e(store_id, category)),
dl AS (
  SELECT l.transaction_id, l.product_id, p.category, p.price * l.pieces_or_weight - l.sales_price AS diff
  FROM transaction_lines l
  JOIN products p ON l.product_id = p.id
  JOIN transactions t ON t.id = l.transaction_id
  JOIN excl e ON e.store_id = CAST(t.store_id AS VARCHAR) AND e.category = p.category
  WHERE p.price * l.pieces_or_weight - l.sales_price > 0.05
    AND l.transaction_id IN (SELECT transaction_id FROM fm WHERE has_positive_price_difference)
),
r4 AS (
  SELECT transaction_id, SUM(diff) AS damage,
         string_agg(CAST(product_id AS VARCHAR) || ' (' || category || ')', ', '
                    ORDER BY CAST(product_id AS VARCHAR) || ' (' || category || ')') AS products
  FROM dl GROUP BY transaction_id
),
{SCORED_CTE.strip()},
screened AS (
  SELECT s.transaction_id,
    CASE WHEN r1.transaction_id IS NOT NULL THEN 'no_lines' WHEN s.has_missing THEN 'missing_product'
         WHEN r3.transaction_id IS NOT NULL THEN 'unscanned' WHEN r4.transaction_id IS NOT NULL THEN 'excluded_discount'
         ELSE 'model' END AS rule,
    s.p, s.damage_pred, r3.damage AS d3, r3.products AS p3, r4.damage AS d4, r4.products AS p4,
    s.p > 10.0 / (5.0 + 10.0 + s.damage_pred) AS model_fraud,
    [{{'f': 'payment_cash', 'v': CAST(s.payment_medium = 'CASH' AS DOUBLE), 'w': 1.5}},
     {{'f': 'n_lines', 'v': CAST(s.n_lines AS DOUBLE), 'w': 0.02}},
     {{'f': 'has_positive_price_difference', 'v': CAST(COALESCE(s.has_positive_price_difference, FALSE) AS DOUBLE), 'w': 0.8}}] AS parts
  FROM scored s
  LEFT JOIN r1 ON r1.transaction_id = s.transaction_id
  LEFT JOIN r3 ON r3.transaction_id = s.transaction_id
  LEFT JOIN r4 ON r4.transaction_id = s.transaction_id
),
screen_out AS (
  SELECT transaction_id, rule,
    CASE WHEN rule = 'model' THEN model_fraud ELSE TRUE END AS is_fraud,
    CASE rule WHEN 'no_lines' THEN NULL WHEN 'model' THEN p ELSE 1.0 END AS fraud_proba,
    CASE rule WHEN 'no_lines' THEN NULL WHEN 'missing_product' THEN NULL WHEN 'unscanned' THEN d3
              WHEN 'excluded_discount' THEN d4 ELSE damage_pred END AS estimated_damage,
    CASE rule WHEN 'no_lines' THEN '{rules.REASON_NO_LINES}' WHEN 'missing_product' THEN '{rules.REASON_CAMERA}'
              WHEN 'unscanned' THEN '{rules.REASON_CAMERA}' WHEN 'excluded_discount' THEN '{rules.REASON_DISCOUNT}'
              ELSE CASE WHEN model_fraud THEN 'Das Modell hat einen möglichen Betrugsfall erkannt: ' || array_to_string(list_transform(
                list_sort(list_transform(parts, lambda x: {{'k': -(x.v * x.w), 'f': x.f, 'v': x.v, 'w': x.w}})),
                lambda x: printf('Merkmal %s hat den Wert %.2f (%.2f Einfluss)', x.f, x.v, CAST(x.v * x.w AS DOUBLE))), chr(10) || ' - ') END END AS reason,
    CASE rule WHEN 'missing_product' THEN '{rules.UNKNOWN_PRODUCT}' WHEN 'unscanned' THEN p3
              WHEN 'excluded_discount' THEN p4 END AS offending_products
  FROM screened
)"""


def _screen(spark, sf_dir):
    b = tables(spark, sf_dir)
    fm = features(spark, sf_dir, b=b, impute=False)  # the cascade and the stand-in scorer use no imputed column
    excl = rules.excluded_categories(spark, FIXTURE_EXCLUDED)
    return rules.screen(b.transactions, b.lines, b.products, fm, excl)


def _arrays_as_text(df, col="offending_products"):
    return df.withColumn(col, F.array_join(F.col(col), ", "))


@register(
    "screen",
    feature_sql(
        "SELECT transaction_id, rule, is_fraud, ROUND(fraud_proba, 4) AS fraud_proba, "
        "ROUND(estimated_damage, 4) AS estimated_damage, reason, offending_products FROM screen_out",
        RULE_CTES,
    ),
)
def q_screen(spark, sf_dir):
    """R1-R5 (+S6, J9, J14, M5): the whole rule cascade with the fixed scorer as model."""
    return finish(_arrays_as_text(_screen(spark, sf_dir)))


@register(
    "screen_rule_counts",
    feature_sql(
        "SELECT rule, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE is_fraud) AS BIGINT) AS n_fraud, "
        "ROUND(COALESCE(SUM(estimated_damage), 0), 4) AS damage FROM screen_out GROUP BY rule",
        RULE_CTES,
    ),
)
def q_screen_rule_counts(spark, sf_dir):
    """R5 summary: baskets, frauds and damage per deciding rule."""
    s = _screen(spark, sf_dir)
    return finish(
        s.groupBy("rule").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("is_fraud").alias("n_fraud"),
            F.coalesce(F.sum("estimated_damage"), F.lit(0.0)).alias("damage"),
        )
    )


@register(
    "responses",
    feature_sql(
        "SELECT transaction_id, '0.1.0' AS version, is_fraud, ROUND(fraud_proba, 4) AS fraud_proba, "
        "ROUND(estimated_damage, 4) AS estimated_damage, reason AS human_readable_reason, offending_products, "
        "reason IS NOT NULL AS has_explanation FROM screen_out",
        RULE_CTES,
    ),
)
def q_responses(spark, sf_dir):
    """R12 (+F25): nested response struct per basket, flattened for comparison."""
    r = rules.to_response(_screen(spark, sf_dir), version="0.1.0")
    e = F.col("response.explanation")
    return finish(
        r.select(
            "transaction_id",
            F.col("response.version").alias("version"),
            F.col("response.is_fraud").alias("is_fraud"),
            F.col("response.fraud_proba").alias("fraud_proba"),
            F.col("response.estimated_damage").alias("estimated_damage"),
            e["human_readable_reason"].alias("human_readable_reason"),
            F.array_join(e["offending_products"], ", ").alias("offending_products"),
            e.isNotNull().alias("has_explanation"),
        )
    )


@register("response_validity", feature_sql(
    "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE regexp_full_match('0.1.0', '[0-9]+\\.[0-9]+\\.[0-9]+')) AS n_valid_version, "
    "COUNT(*) FILTER (WHERE fraud_proba IS NULL OR fraud_proba BETWEEN 0 AND 1) AS n_valid_proba FROM screen_out", RULE_CTES))
def q_response_validity(spark, sf_dir):
    """responses with a semantic version and a probability that is missing or a share."""
    r = rules.to_response(_screen(spark, sf_dir), version="0.1.0").select("response.version", "response.fraud_proba")
    return r.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(S.valid_version("version")).alias("n_valid_version"),
        F.count_if(S.valid_probability("fraud_proba")).alias("n_valid_proba"),
    )


@register(
    "predict_batch",
    feature_sql(
        "SELECT transaction_id, TRUE AS is_fraud, ROUND(CAST(CAST(1.0 AS FLOAT) AS DOUBLE), 4) AS fraud_proba, "
        "ROUND(CAST(CAST(price_unscanned_articles AS FLOAT) AS DOUBLE), 4) AS estimated_damage "
        "FROM fm WHERE has_missing OR has_unscanned "
        "UNION ALL "
        "SELECT transaction_id, p > 10.0 / (5.0 + 10.0 + damage_pred) AS is_fraud, "
        "ROUND(CAST(CAST(p AS FLOAT) AS DOUBLE), 4) AS fraud_proba, ROUND(CAST(CAST(damage_pred AS FLOAT) AS DOUBLE), 4) AS estimated_damage "
        "FROM scored WHERE transaction_id NOT IN (SELECT transaction_id FROM fm WHERE has_missing OR has_unscanned)",
        SCORED_CTE.strip(),
    ),
)
def q_predict_batch(spark, sf_dir):
    """R7 (+R6, M5): rule table for certain frauds, scorer for the rest (one pass)."""
    return finish(rules.predict_batch(features(spark, sf_dir, impute=False)))


@register(
    "wrong_discount_baskets",
    feature_sql(
        """SELECT t.label, CAST(COUNT(*) AS BIGINT) AS n_baskets, ROUND(COALESCE(SUM(t.damage), 0), 4) AS damage
           FROM transactions t
           WHERE t.id IN (SELECT l.transaction_id FROM transaction_lines l JOIN products p ON l.product_id = p.id
                          WHERE p.category IN ('PROMO', 'SMALL') AND abs(p.price * l.pieces_or_weight - l.sales_price) > 0.01)
           GROUP BY t.label"""
    ),
)
def q_wrong_discount(spark, sf_dir):
    """R8 (+J8, P8, P9): baskets with a wrong discount in given categories, by label with damage."""
    b = tables(spark, sf_dir)
    ids = rules.wrong_discount_baskets(b.lines, b.products, ["PROMO", "SMALL"], eps=0.01)
    tx = b.transactions.join(ids.withColumnRenamed("transaction_id", "id"), "id", "left_semi")
    return finish(
        tx.groupBy("label").agg(F.count(F.lit(1)).alias("n_baskets"), F.coalesce(F.sum("damage"), F.lit(0.0)).alias("damage"))
    )


@register(
    "remaining_after_rules",
    feature_sql(
        "SELECT label, COUNT(*) AS n FROM fm0 WHERE transaction_id NOT IN "
        "(SELECT transaction_id FROM fm0 WHERE has_missing OR has_unscanned) GROUP BY label"
    ),
)
def q_remaining(spark, sf_dir):
    """J7 (+R6): baskets left for the model after removing rule hits (left anti join), by label."""
    fm = features(spark, sf_dir, impute=False)
    rest = rules.remaining(fm, rules.certain_frauds(fm))
    return rest.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
