"""Static fraud rules and the screening cascade.

The cascade runs on whole tables: the basket feature matrix is read once, the
rule details that need line-level data (offending products, damages) are
small aggregates of filtered lines, and the precedence (no lines -> missing
product -> unscanned -> excluded discount -> model) is one ``CASE`` over
co-partitioned rows, so nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import scalar as S

# Fixed texts of the responses (German, as produced by the reference service).
REASON_NO_LINES = "Keine Transaktionszeilen vorhanden"
REASON_CAMERA = "Kamera hat nicht gescannte Produkte erkannt"
REASON_DISCOUNT = "Rabatt auf von Rabatt ausgenommene Produkte angewendet"
REASON_MODEL = "Das Modell hat einen möglichen Betrugsfall erkannt."
UNKNOWN_PRODUCT = "unbekannt"
DISCOUNT_LINE_THRESHOLD = 0.05
# Categories whose discount was judged wrong in the segment analysis.
WRONG_DISCOUNT_CATEGORIES = [
    "PERSONAL_CARE", "LONG_SHELF_LIFE", "FROZEN_GOODS", "BEVERAGES",
    "ALCOHOL", "SNACKS", "HOUSEHOLD", "TOBACCO",
]

RESULT = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("fraud_proba", T.DoubleType()),
    T.StructField("estimated_damage", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("offending_products", T.ArrayType(T.StringType())),
])


def _result(rule: str, is_fraud: Column, proba: Column, damage: Column, reason: Column, products: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        is_fraud.cast("boolean").alias("is_fraud"),
        proba.cast("double").alias("fraud_proba"),
        damage.cast("double").alias("estimated_damage"),
        reason.cast("string").alias("reason"),
        products.cast("array<string>").alias("offending_products"),
    )


# ---------------------------------------------------------------- S6 / J14
def excluded_categories(spark: SparkSession, config: Mapping[str, Sequence[str]], enabled: bool = True) -> DataFrame:
    """(store_id, category) rows from a per-store config; empty when disabled.

    The config is a handful of stores × categories, so the frame is bounded
    and safe to broadcast.
    """
    rows = [(str(s), c) for s, cats in config.items() for c in cats] if enabled else []
    return spark.createDataFrame(rows, "store_id string, category string")


# ---------------------------------------------------------------- R6 / J7
def certain_frauds(features: DataFrame) -> DataFrame:
    """Baskets with a missing product or an unscanned article are fraud for sure."""
    return features.where(F.col("has_missing") | F.col("has_unscanned")).select(
        "transaction_id",
        F.lit(True).alias("is_fraud"),
        F.lit(1.0).cast("float").alias("fraud_proba"),
        F.col("price_unscanned_articles").cast("float").alias("estimated_damage"),
    )


def remaining(features: DataFrame, decided: DataFrame) -> DataFrame:
    """Baskets not decided by a rule (left anti join on the key)."""
    return features.join(decided.select("transaction_id"), "transaction_id", "left_anti")


# ---------------------------------------------------------------- R1
# ---------------------------------------------------------------- R3 / J9
def unscanned_lines(lines: DataFrame) -> DataFrame:
    """Lines the camera saw but nobody paid: voided, free, camera not 'similar'.

    A null camera flag counts as 'not similar' here (the service helper uses
    Python truthiness), unlike the three-valued ``has_unscanned`` feature.
    """
    return lines.where(
        F.col("was_voided") & (F.col("sales_price") == 0) & ~F.coalesce(F.col("camera_product_similar"), F.lit(False))
    )


# ---------------------------------------------------------------- R4
def discount_lines(lines: DataFrame, products: DataFrame, tx: DataFrame, excluded: DataFrame,
                   threshold: float = DISCOUNT_LINE_THRESHOLD) -> DataFrame:
    """Lines in a store-excluded category sold more than ``threshold`` below nominal price.

    Lines are narrowed to discounted lines of any excluded category before
    the join with the receipts (for the store id), so only candidates travel.
    """
    p = products.select(F.col("id").alias("product_id"), "category", "price")
    cats = excluded.select("category").distinct()  # bounded by the config
    cand = (
        lines.join(p, "product_id", "inner")
        .withColumn("price_difference", S.price_difference("price", "pieces_or_weight", "sales_price"))
        .where(F.col("price_difference") > F.lit(threshold))
        .join(F.broadcast(cats), "category", "left_semi")
    )
    stores = tx.select(F.col("id").alias("transaction_id"), F.col("store_id").cast("string").alias("store_id"))
    j = cand.join(stores, "transaction_id", "inner").join(F.broadcast(excluded), ["store_id", "category"], "inner")
    return j.select("transaction_id", "product_id", "category", "price_difference")


# ---------------------------------------------------------------- model stand-in
def fixed_linear_score(features: DataFrame) -> DataFrame:
    """Deterministic scorer (FIXTURES §4) used where a trained model would sit.

    raw = -2 + 1.5·cash + 0.02·n_lines + 0.8·positive_price_difference
    p = round(sigmoid(raw), 6); damage_pred = round(0.0001·total_amount, 4)
    """
    flag = F.coalesce(F.col("has_positive_price_difference"), F.lit(False)).cast("double")
    cash, n_lines = (F.col("payment_medium") == "CASH").cast("double"), F.col("n_lines").cast("double")
    raw = F.lit(-2.0) + F.lit(1.5) * cash + F.lit(0.02) * n_lines + F.lit(0.8) * flag
    parts = {"payment_cash": (cash, 1.5), "n_lines": (n_lines, 0.02), "has_positive_price_difference": (flag, 0.8)}
    contributions = F.array(*[
        F.struct(F.lit(name).alias("feature"), value.alias("value"), (F.lit(weight) * value).alias("contribution"))
        for name, (value, weight) in parts.items()
    ])
    features = features.withColumn("contributions", top_features(contributions))
    return features.withColumn("p", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-raw)), 6)).withColumn(
        "damage_pred", F.round(F.lit(0.0001) * F.col("total_amount"), 4)
    )


def top_features(contributions: Column, n: int = 5) -> Column:
    """W6 within a row: the ``n`` entries of array<struct<feature, value, contribution>> of the largest |contribution|."""
    ranked = F.sort_array(F.transform(contributions, lambda s: F.struct(-F.abs(s["contribution"]), s["feature"], s.alias("s"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: r["s"])


def decide(p: str | Column, damage: str | Column, cost_fp: float = 10.0, gain_tp: float = 5.0) -> Column:
    """M5: control when p > cost_fp / (gain_tp + cost_fp + damage)."""
    pc = F.col(p) if isinstance(p, str) else p
    dc = F.col(damage) if isinstance(damage, str) else damage
    return pc > F.lit(cost_fp) / (F.lit(gain_tp) + F.lit(cost_fp) + dc)


# ---------------------------------------------------------------- R5
def unscanned_details(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per basket with unscanned candidates: whether the 3-valued rule can fire, offending ids, damage.

    Computed from the lines alone (voided free lines only), so the cascade
    does not need a second pass over the feature matrix.
    """
    cand = lines.where(F.col("was_voided") & (F.col("sales_price") == 0)).select("transaction_id", "product_id", "camera_product_similar")
    ul = cand.where(~F.coalesce(F.col("camera_product_similar"), F.lit(False)))
    listed = ul.groupBy("transaction_id").agg(
        F.sort_array(F.collect_list(F.coalesce(F.col("product_id").cast("string"), F.lit("None")))).alias("u_products"),
        F.bool_or(F.col("camera_product_similar") == F.lit(False)).alias("u_fires"),
    )
    ids = ul.select("transaction_id", "product_id").where(F.col("product_id").isNotNull()).distinct()
    damage = (
        ids.join(products.select(F.col("id").alias("product_id"), "price"), "product_id", "inner")
        .groupBy("transaction_id").agg(F.sum("price").alias("u_damage"))
    )
    return listed.join(damage, "transaction_id", "left")


def discount_details(lines: DataFrame, products: DataFrame, tx: DataFrame, excluded: DataFrame,
                     threshold: float = DISCOUNT_LINE_THRESHOLD) -> DataFrame:
    """Per basket: Σ price difference and offending products of discounted lines in store-excluded categories."""
    dl = discount_lines(lines, products, tx, excluded, threshold)
    return dl.groupBy("transaction_id").agg(
        F.sum("price_difference").alias("d_damage"),
        F.sort_array(F.collect_list(S.offending_text("product_id", "category"))).alias("d_products"),
    )


def screen(tx: DataFrame, lines: DataFrame, products: DataFrame, features: DataFrame,
           excluded: DataFrame, scored: DataFrame | None = None,
           cost_fp: float = 10.0, gain_tp: float = 5.0) -> DataFrame:
    """Cascade no lines -> missing -> unscanned -> excluded discount -> model.

    The feature matrix is read once: 'no lines' is a basket without a line
    aggregate (``n_voided`` is null only then), the missing / unscanned /
    price-difference flags and the score come from the same rows.  Only the
    details of the unscanned and discount rules (product lists, damages) are
    computed from the lines; all three inputs are partitioned by the basket
    key, so the final joins need no further shuffle of the matrix.
    """
    scored = fixed_linear_score(features) if scored is None else scored
    base = scored.select(
        "transaction_id", "has_missing", "has_unscanned", "has_positive_price_difference", "n_voided", "p", "damage_pred",
        (S.reason_text("contributions") if "contributions" in scored.columns else F.lit(REASON_MODEL)).alias("model_reason"),
    )
    j = (
        base.join(unscanned_details(lines, products), "transaction_id", "left")
        .join(discount_details(lines, products, tx, excluded), "transaction_id", "left")
    )
    fraud = decide("p", "damage_pred", cost_fp, gain_tp)
    result = (
        F.when(F.col("n_voided").isNull(),
               _result("no_lines", F.lit(True), F.lit(None), F.lit(None), F.lit(REASON_NO_LINES), F.lit(None)))
        .when(F.col("has_missing"),
              _result("missing_product", F.lit(True), F.lit(1.0), F.lit(None), F.lit(REASON_CAMERA), F.array(F.lit(UNKNOWN_PRODUCT))))
        .when(F.col("has_unscanned"),
              _result("unscanned", F.lit(True), F.lit(1.0), F.coalesce(F.col("u_damage"), F.lit(0.0)), F.lit(REASON_CAMERA),
                      F.coalesce(F.col("u_products"), F.array().cast("array<string>"))))
        .when(F.col("has_positive_price_difference") & F.col("d_damage").isNotNull(),
              _result("excluded_discount", F.lit(True), F.lit(1.0), F.col("d_damage"), F.lit(REASON_DISCOUNT), F.col("d_products")))
        .otherwise(_result("model", fraud, F.col("p"), F.col("damage_pred"), F.when(fraud, F.col("model_reason")), F.lit(None)))
    )
    return j.select("transaction_id", result.alias("r")).select("transaction_id", "r.*")


# ---------------------------------------------------------------- R12
def to_response(screened: DataFrame, version: str = "0.1.0") -> DataFrame:
    """Nested response struct + its JSON text; explanation null for a non-fraud model answer."""
    explanation = F.when(
        F.col("reason").isNotNull(),
        F.struct(F.col("reason").alias("human_readable_reason"), F.col("offending_products").alias("offending_products")),
    )
    resp = F.struct(
        F.lit(version).alias("version"),
        F.col("is_fraud").alias("is_fraud"),
        F.col("fraud_proba").alias("fraud_proba"),
        F.col("estimated_damage").alias("estimated_damage"),
        explanation.alias("explanation"),
    )
    return screened.select("transaction_id", resp.alias("response")).withColumn("response_json", F.to_json("response"))


# ---------------------------------------------------------------- R7
def predict_batch(features: DataFrame, cost_fp: float = 10.0, gain_tp: float = 5.0, scored: DataFrame | None = None) -> DataFrame:
    """Rule table for certain frauds, the scorer for every other basket — one row per basket.

    Same rows as 'rule table ∪ scorer(anti-join rest)', written as one
    projection: every basket falls in exactly one branch, so the feature
    matrix is read once instead of once per branch.
    """
    s = fixed_linear_score(features) if scored is None else scored
    certain = F.coalesce(F.col("has_missing") | F.col("has_unscanned"), F.lit(False))
    return s.select(
        "transaction_id",
        F.when(certain, F.lit(True)).otherwise(decide("p", "damage_pred", cost_fp, gain_tp)).alias("is_fraud"),
        F.when(certain, F.lit(1.0)).otherwise(F.col("p")).cast("float").alias("fraud_proba"),
        F.when(certain, F.col("price_unscanned_articles")).otherwise(F.col("damage_pred")).cast("float").alias("estimated_damage"),
    )


# ---------------------------------------------------------------- R8
def wrong_discount_baskets(lines: DataFrame, products: DataFrame, categories: Sequence[str] = WRONG_DISCOUNT_CATEGORIES, eps: float = 0.01) -> DataFrame:
    """Distinct baskets with a line |nominal - paid| > eps in the given categories."""
    p = products.select(F.col("id").alias("product_id"), "category", "price").where(F.col("category").isin(list(categories)))
    j = lines.join(p, "product_id", "inner")
    hit = S.far(F.col("price") * F.col("pieces_or_weight"), F.col("sales_price"), eps)
    return j.where(hit).select("transaction_id").distinct()
