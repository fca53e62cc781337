"""Basket feature matrix (F-, J1-J3, A5-A12, W1-W3 rows).

Plan shape (see ``explain``):

    lines ⟕ products            (AQE picks broadcast or shuffle by measured size; null ids dealt out)
      → partial HashAggregate per basket → Exchange hash(transaction_id) → HashAggregate
    lines (basket, time only)
      → Window lag per (basket, hour, second) → (basket, hour) → basket     (scan gaps)
    transactions ⟕ broadcast(stores) ⟕ basket aggregate ⟕ gaps   (co-partitioned on id)

Every aggregate but the gaps is decomposable (sum, min, max, bool_or, count), so
it is summed in the task before the exchange: a basket holding a third of all
lines is one row a task there.  The mean scan gap is (last - first) / (n - 1);
only the largest gap needs consecutive timestamps, and only those are sorted,
cut by second and hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import scalar as S
from tillsight.functions.nulls import any_true, count_true, left_join_spread, sum0

LINE_PRODUCT_COLUMNS = [
    "transaction_id", "product_id", "was_voided", "pieces_or_weight", "sales_price",
    "camera_product_similar", "camera_certainty", "price", "category", "popularity",
    "sold_by_weight", "age_restricted", "timestamp",
]


MAX_CATEGORIES = 2_000


def discover_categories(products: DataFrame) -> list[str]:
    """Distinct product categories (sorted) + MISSING; they fix the one-hot columns.

    More than ``MAX_CATEGORIES`` (one column each) are an error, not a cut:
    at most one row above that bound reaches the driver.
    """
    rows = products.select("category").where(F.col("category").isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} product categories: one column for each is not what they are for")
    return sorted({r[0] for r in rows} - {S.MISSING}) + [S.MISSING]


#: The matrix' flags that name no product category.
OTHER_FLAGS = ("has_feedback", "has_voided", "has_unscanned", "has_age_restricted", "has_sold_by_weight", "has_camera_detected_wrong_product",
               "has_camera_detected_wrong_product_high_certainty", "has_positive_price_difference")


def category_flags(matrix: DataFrame) -> list[str]:
    """The columns of a feature matrix that say whether a basket has a product of a category."""
    return [c for c, t in matrix.dtypes if t == "boolean" and c.startswith("has_") and c not in OTHER_FLAGS]


def lines_with_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Every line keeps its row; unknown products give null attributes."""
    p = products.select(
        F.col("id").alias("product_id"), "price", "category", "popularity", "sold_by_weight", "age_restricted",
    )
    return left_join_spread(lines, p, "product_id").select(*LINE_PRODUCT_COLUMNS)


def unscanned_flag(df: DataFrame | None = None) -> Column:
    """Voided, free, and the camera says 'not similar' (3-valued)."""
    return F.col("was_voided") & (F.col("sales_price") == 0) & ~F.col("camera_product_similar")


def basket_aggregates(
    lines: DataFrame,
    products: DataFrame,
    categories: list[str],
    certainty: float = S.CAMERA_CERTAINTY_THRESHOLD,
    diff_threshold: float = 0.1,
) -> DataFrame:
    """A5-A12 + W1: one row per basket with line, camera, price, category and scan-gap features.

    Every aggregate but the gaps is decomposable and summed in the task before
    its rows are dealt out, so a hot basket is one row a task there.
    """
    lp = lines_with_products(lines, products).withColumn("category", F.coalesce(F.col("category"), F.lit(S.MISSING)))
    diff = S.price_difference("price", "pieces_or_weight", "sales_price")
    unscanned = unscanned_flag()
    cam_wrong_hi = ~F.col("camera_product_similar") & (F.col("camera_certainty") >= F.lit(certainty))
    agg = lp.groupBy("transaction_id").agg(
        F.max("was_voided").alias("has_voided"),
        sum0(F.col("was_voided").cast("bigint")).cast("bigint").alias("n_voided"),
        any_true(unscanned).alias("has_unscanned"),
        sum0(F.when(unscanned, F.col("price"))).cast("double").alias("price_unscanned_articles"),
        sum0(F.col("age_restricted").cast("bigint")).cast("bigint").alias("n_age_restricted"),
        F.max("age_restricted").alias("has_age_restricted"),
        F.max("popularity").alias("popularity_max"),
        F.min("popularity").alias("popularity_min"),
        F.max("price").alias("max_product_price"),
        sum0(F.col("sold_by_weight").cast("bigint")).cast("bigint").alias("n_sold_by_weight"),
        F.max("sold_by_weight").alias("has_sold_by_weight"),
        (~F.min("camera_product_similar")).alias("has_camera_detected_wrong_product"),
        F.max(cam_wrong_hi).alias("has_camera_detected_wrong_product_high_certainty"),
        sum0(diff).cast("double").alias("calculated_price_difference"),
        *[F.max(F.col("category") == F.lit(c)).alias(S.category_column(c)) for c in categories],
    )
    return agg.join(scan_gaps(lines), "transaction_id", "left").withColumn(
        "has_positive_price_difference", F.col("calculated_price_difference") > F.lit(diff_threshold)
    )


def scan_gaps(lines: DataFrame) -> DataFrame:
    """W1 + A12: first and last scan of each basket, mean and largest seconds between its scans.

    Only (basket, time) is sorted, in three steps: the scans of one second, the
    seconds of one hour, the hours of a basket.  So a basket with a third of all
    lines is cut by time wherever it is dense, and a step hands on one row each.
    """
    scans = lines.where(F.col("timestamp").isNotNull()).select(
        "transaction_id", F.date_trunc("hour", "timestamp").alias("_hour"), F.date_trunc("second", "timestamp").alias("_second"),
        F.col("timestamp").alias("first_timestamp"), F.col("timestamp").alias("last_timestamp"), F.lit(None).cast("bigint").alias("_gap"),
        F.lit(1).cast("bigint").alias("_n"),
    )
    keys = ["transaction_id", "_hour", "_second"]
    for depth in (3, 2, 1):
        own = keys[:depth]
        before = F.lag("last_timestamp").over(Window.partitionBy(*own).orderBy("first_timestamp"))
        scans = scans.withColumn("_gap", F.greatest("_gap", S.micros_between(before, F.col("first_timestamp")))).groupBy(*own).agg(
            F.min("first_timestamp").alias("first_timestamp"), F.max("last_timestamp").alias("last_timestamp"),
            F.max("_gap").alias("_gap"), F.sum("_n").alias("_n"),
        )
    mean = F.try_divide(S.micros_between("first_timestamp", "last_timestamp").cast("double"), F.when(F.col("_n") > 1, (F.col("_n") - 1).cast("double")))
    return scans.select(
        "transaction_id", "first_timestamp", "last_timestamp", (mean / F.lit(1e6)).alias("mean_time_between_scans"),
        (F.col("_gap") / F.lit(1e6)).alias("max_time_between_scans"),
    )


def transaction_features(tx: DataFrame) -> DataFrame:
    """F1-F6, F14-F16 on the receipt header."""
    start = F.col("transaction_start")
    fb = F.col("customer_feedback")
    return tx.select(
        "id",
        F.col("cash_desk").cast("string").alias("cash_desk"),
        "total_amount",
        "n_lines",
        "payment_medium",
        S.has_value(fb).alias("has_feedback"),
        S.feedback_category(fb).alias("feedback_categorical"),
        S.feedback_flag(fb, "LOW").alias("feedback_low"),
        S.feedback_flag(fb, "MIDDLE").alias("feedback_middle"),
        S.feedback_flag(fb, "HIGH").alias("feedback_high"),
        S.feedback_flag(fb, "TOP").alias("feedback_top"),
        S.daytime(F.hour(start)).alias("daytime"),
        F.hour(start).alias("hour"),
        F.hour(start).cast("string").alias("hour_categorical"),
        S.weekday_name(start).alias("day_of_week"),
        S.month_name(start).alias("month"),
        S.whole_seconds(start, "transaction_end").alias("transaction_duration_seconds"),
        "damage",
        "label",
        F.col("store_id").cast("string").alias("store_id"),
        "transaction_start",
        "transaction_end",
    )


def store_features(stores: DataFrame, location_codes: dict[str, str] | None = None) -> DataFrame:
    """Store dimension: location recoded to plate codes (unmapped -> null), SCO date parsed."""
    codes = S.CITY_CODES if location_codes is None else location_codes
    return stores.select(
        F.col("id").cast("string").alias("store_id"),
        S.recode("location", codes).alias("location"),
        "urbanization",
        S.parse_date("sco_introduction").alias("sco_introduction"),
    )


def impute_by_label(df: DataFrame, mode_cols: list[str], mean_cols: list[str], key: str = "label") -> DataFrame:
    """Fill nulls with the per-label mode (ties -> lowest value) / mean.

    Not a window over ``label`` (three giant partitions): one aggregate of a
    handful of rows — bounded by the number of labels — broadcast back.
    """
    stats = df.groupBy(key).agg(
        *[F.mode(c, True).alias(f"_mode_{c}") for c in mode_cols],
        *[F.avg(c).alias(f"_mean_{c}") for c in mean_cols],
    )
    stats = stats.withColumnRenamed(key, "_k")
    out = df.join(F.broadcast(stats), df[key].eqNullSafe(stats["_k"]), "left")
    for c in mode_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_mode_{c}")))
    for c in mean_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_mean_{c}")))
    return out.drop("_k", *[f"_mode_{c}" for c in mode_cols], *[f"_mean_{c}" for c in mean_cols])


IMPUTE_MODE = ["has_camera_detected_wrong_product", "has_camera_detected_wrong_product_high_certainty"]
IMPUTE_MEAN = ["mean_time_between_scans", "max_time_between_scans"]


def feature_matrix(
    tx: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    categories: list[str] | None = None,
    impute: bool = True,
    diff_threshold: float = 0.1,
    location_codes: dict[str, str] | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """J3 + post-join features: one row per receipt, ~55 columns.

    With imputation, the raw matrix feeds both the per-label statistics and
    the fill-in join.  The two branches are column-pruned differently, so
    Spark cannot reuse the exchange and would run the line pipeline twice;
    ``checkpoint`` writes the raw matrix once as a Parquet table below the
    cluster's checkpoint folder (one row per basket, a fraction of the lines)
    and both branches read it.
    """
    cats = discover_categories(products) if categories is None else categories
    t = transaction_features(tx)
    s = store_features(stores, location_codes)
    b = basket_aggregates(lines, products, cats, diff_threshold=diff_threshold)
    j = (
        t.join(F.broadcast(s), "store_id", "left")
        .join(b, t["id"] == b["transaction_id"], "left")
        .drop("transaction_id")
    )
    j = j.select(
        F.col("id").alias("transaction_id"),
        *[c for c in j.columns if c not in ("id",)],
        S.seconds_between("transaction_start", "first_timestamp").alias("time_to_first_scan"),
        S.seconds_between("last_timestamp", "transaction_end").alias("time_from_last_scan_to_end"),
        S.whole_days("sco_introduction", "transaction_start").alias("days_since_sco_introduction"),
    ).drop("transaction_start", "transaction_end", "first_timestamp", "last_timestamp", "sco_introduction")
    if impute:
        if checkpoint:
            from tillsight.session import materialize

            j = materialize(j, "feature-matrix")
        j = impute_by_label(j, IMPUTE_MODE, IMPUTE_MEAN)
    return j


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
