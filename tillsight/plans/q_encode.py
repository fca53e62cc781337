"""Registered queries: projections, filters, sinks' shapes, encoders and scaling (P-, E-, F-, S7 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.functions import scalar as S
from tillsight.operators import encode as E
from tillsight.operators import sampling as O
from tillsight.plans.basket_sql import feature_sql
from tillsight.plans.common import features, tables
from tillsight.plans.q_features import _FM_DOUBLES
from tillsight.plans.registry import basket_sql, finish, register

# Features the reference drops before modelling (fixed list, natural order).
USELESS_FEATURES = [
    "max_product_price", "has_positive_price_difference", "has_bakery", "time_to_first_scan", "popularity_max",
    "has_age_restricted", "cash_desk", "transaction_duration_seconds", "feedback_low", "feedback_middle",
    "feedback_high", "feedback_top", "store_id", "location", "urbanization", "has_voided", "has_sold_by_weight",
    "has_limited_time_offers", "has_fruits_vegetables", "has_missing", "has_camera_detected_wrong_product",
    "day_of_week", "hour_categorical",
]
DUMMY_COLS = ["payment_medium", "daytime", "feedback_categorical", "month"]
_CATS = {
    "payment_medium": ["CASH", "CREDIT_CARD"],
    "daytime": ["afternoon", "evening", "morning", "noon"],
    "feedback_categorical": ["HIGH", "LOW", "MIDDLE", "MISSING", "TOP"],
    "month": sorted(S.MONTHS),
}


def _round_all(cols) -> str:
    return ", ".join(f"ROUND({c}, 4) AS {c}" for c in cols)


@register("label_first_table", feature_sql(
    f"SELECT * EXCLUDE (damage) REPLACE ({_round_all([c for c in _FM_DOUBLES if c != 'damage'])}) FROM fm WHERE label <> 'UNKNOWN'"))
def q_label_first(spark, sf_dir):
    """Labelled rows, label first, damage dropped."""
    fm = features(spark, sf_dir).where(F.col("label") != "UNKNOWN")
    return finish(E.with_columns_first(fm, ["label"]).drop("damage"))


@register("damage_first_table", feature_sql(
    f"SELECT * EXCLUDE (label) REPLACE ({_round_all(_FM_DOUBLES)}) FROM fm WHERE label <> 'UNKNOWN'"))
def q_damage_first(spark, sf_dir):
    """Labelled rows, damage first, label dropped."""
    fm = features(spark, sf_dir).where(F.col("label") != "UNKNOWN")
    return finish(E.with_columns_first(fm, ["damage"]).drop("label"))


def _model_dataset(fm):
    d = fm.where(F.col("label") != "UNKNOWN").drop("transaction_id")
    d = E.drop_existing(d, USELESS_FEATURES)
    d = d.where(~F.col("has_unscanned")).drop("has_unscanned")  # P5
    d = E.targets(d)  # E3
    d = E.bools_as_tinyint(d)  # P14
    return E.to_dummies(d, DUMMY_COLS, drop_first=True)  # E1


def _model_dataset_sql() -> str:
    from tillsight.plans.basket_sql import CATEGORIES

    flags = ["has_" + c.lower() for c in CATEGORIES]
    bools = [f for f in flags + ["has_feedback", "has_unscanned", "has_camera_detected_wrong_product_high_certainty"] if f not in USELESS_FEATURES]
    dummies = ", ".join(
        f"CAST({c} = '{v}' AS INTEGER) AS {c}_{v}" for c in DUMMY_COLS for v in _CATS[c][1:]
    )
    numeric = ["total_amount", "n_lines", "hour", "n_voided", "price_unscanned_articles", "n_age_restricted", "popularity_min",
               "n_sold_by_weight", "calculated_price_difference", "mean_time_between_scans", "max_time_between_scans",
               "time_from_last_scan_to_end", "days_since_sco_introduction"]
    dbl = set(_FM_DOUBLES)
    num_sql = ", ".join(f"ROUND({c}, 4) AS {c}" if c in dbl else c for c in numeric)
    bool_sql = ", ".join(f"CAST({b} AS TINYINT) AS {b}" for b in bools if b != "has_unscanned")
    return feature_sql(
        f"SELECT {num_sql}, {bool_sql}, CAST(label = 'FRAUD' AS INTEGER) AS label_FRAUD, ROUND(COALESCE(damage, 0.0), 4) AS damage, {dummies} "
        "FROM fm WHERE label <> 'UNKNOWN' AND NOT has_unscanned"
    )


@register("model_dataset", _model_dataset_sql())
def q_model_dataset(spark, sf_dir):
    """P2 + P3 + P5 + P14 + E1 + E3: model-ready matrix with drop-first dummies and 0/1 targets."""
    return finish(_model_dataset(features(spark, sf_dir)))


_ENC_COLS = ["transaction_id", "total_amount", "n_lines", "payment_medium", "daytime", "has_feedback"]


@register("encoder_transform", feature_sql(
    "SELECT transaction_id, ROUND(CAST(total_amount AS DOUBLE), 4) AS total_amount, CAST(n_lines AS DOUBLE) AS n_lines, "
    "CAST(has_feedback AS INTEGER) AS has_feedback, "
    + ", ".join(f"CAST(CAST({c} AS VARCHAR) = '{v}' AS INTEGER) AS {c}_{v}" for c in ("payment_medium", "daytime") for v in _CATS[c])
    + " FROM fm"))
def q_encoder(spark, sf_dir):
    """E2 (+S11): encoder fitted on the labelled rows, applied to all rows; null category -> null dummies."""
    fm = features(spark, sf_dir, impute=False).select(*_ENC_COLS)
    enc = E.BasketEncoder().fit(fm, exclude=["transaction_id"])
    enc = E.BasketEncoder.from_json(enc.to_json())
    return finish(enc.transform(fm, keep=["transaction_id"]))


@register("regression_set", feature_sql(
    "SELECT transaction_id, ROUND(damage, 4) AS damage, ROUND(total_amount, 4) AS total_amount, "
    + ", ".join(f"CAST(payment_medium = '{v}' AS INTEGER) AS payment_medium_{v}" for v in _CATS["payment_medium"])
    + " FROM fm WHERE label = 'FRAUD'"))
def q_regression_set(spark, sf_dir):
    """FRAUD rows only, encoded, damage as target."""
    fm = features(spark, sf_dir, impute=False).select("transaction_id", "damage", "total_amount", "payment_medium", "label")
    return finish(E.regression_set(fm, ["payment_medium"]))


@register("standardised", feature_sql(
    "SELECT transaction_id, ROUND((total_amount - AVG(total_amount) OVER ()) / STDDEV_POP(total_amount) OVER (), 4) AS total_amount, "
    "ROUND((n_lines - AVG(CAST(n_lines AS DOUBLE)) OVER ()) / STDDEV_POP(CAST(n_lines AS DOUBLE)) OVER (), 4) AS n_lines FROM fm"))
def q_standardised(spark, sf_dir):
    """E5: z-scores with population std."""
    fm = features(spark, sf_dir, impute=False).select("transaction_id", "total_amount", "n_lines")
    return finish(E.standardise(fm, ["total_amount", "n_lines"]))


@register("robust_scaled", feature_sql(
    "SELECT transaction_id, ROUND((total_amount - (SELECT quantile_cont(total_amount, 0.5) FROM fm)) / "
    "((SELECT quantile_cont(total_amount, 0.75) FROM fm) - (SELECT quantile_cont(total_amount, 0.25) FROM fm)), 4) AS total_amount FROM fm"))
def q_robust(spark, sf_dir):
    """(x - median) / IQR."""
    fm = features(spark, sf_dir, impute=False).select("transaction_id", "total_amount")
    return finish(E.robust_scale(fm, ["total_amount"]))


@register("quantile_bins", feature_sql(
    """SELECT total_amount_bin, COUNT(*) AS n FROM (
         SELECT CASE WHEN total_amount IS NOT NULL THEN CAST(total_amount > q[1] AS INTEGER) + CAST(total_amount > q[2] AS INTEGER)
                     + CAST(total_amount > q[3] AS INTEGER) END AS total_amount_bin
         FROM fm, (SELECT quantile_cont(total_amount, [0.25, 0.5, 0.75]) AS q FROM fm))
       GROUP BY 1"""))
def q_quantile_bins(spark, sf_dir):
    """Quartile bins 0..3."""
    fm = features(spark, sf_dir, impute=False).select("total_amount")
    return E.quantile_bins(fm, ["total_amount"], 4).groupBy("total_amount_bin").agg(F.count(F.lit(1)).alias("n"))


@register("poly_features", feature_sql(
    "SELECT ROUND(SUM(CAST(n_lines AS DOUBLE) * n_lines), 4) AS sq_n_lines, ROUND(SUM(CAST(hour AS DOUBLE) * hour), 4) AS sq_hour, "
    "ROUND(SUM(CAST(n_lines AS DOUBLE) * hour), 4) AS n_lines_hour, COUNT(*) AS n FROM fm"))
def q_poly(spark, sf_dir):
    """Degree-2 expansion (squares and interactions), column sums."""
    fm = features(spark, sf_dir, impute=False).select("n_lines", "hour")
    x = E.expand(fm, ["n_lines", "hour"], 2)
    return finish(x.agg(F.sum("`n_lines^2`").alias("sq_n_lines"), F.sum("`hour^2`").alias("sq_hour"),
                        F.sum("`n_lines hour`").alias("n_lines_hour"), F.count(F.lit(1)).alias("n")))


@register("rows_without_nulls", feature_sql(
    "SELECT label, COUNT(*) AS n FROM fm WHERE COLUMNS(* EXCLUDE (damage)) IS NOT NULL GROUP BY label"))
def q_without_nulls(spark, sf_dir):
    """P10: rows without nulls in any column except damage, by label."""
    fm = features(spark, sf_dir)
    return fm.dropna(subset=[c for c in fm.columns if c != "damage"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("filter_overview", feature_sql(
    """SELECT COUNT(*) FILTER (WHERE label <> 'UNKNOWN') AS n_labeled, COUNT(*) FILTER (WHERE label = 'FRAUD') AS n_fraud,
              COUNT(*) FILTER (WHERE customer_feedback_null) AS n_feedback_null, COUNT(*) FILTER (WHERE NOT customer_feedback_null) AS n_feedback,
              COUNT(*) FILTER (WHERE total_amount > 50000 AND total_amount < 150000) AS n_mid_amount,
              COUNT(*) FILTER (WHERE daytime IN ('morning', 'evening')) AS n_morning_evening,
              COUNT(*) FILTER (WHERE NOT isnan(dpl) AND abs(dpl) < 'inf'::DOUBLE) AS n_finite_duration_per_line
       FROM (SELECT *, NOT has_feedback AS customer_feedback_null,
                    CAST(transaction_duration_seconds AS DOUBLE) / NULLIF(n_lines, 0) AS dpl FROM fm)"""))
def q_filters(spark, sf_dir):
    """P4, P6, P7, P8, P11 (+F8): labelled/class, null, open-range, membership and finite filters."""
    fm = features(spark, sf_dir, impute=False)
    dpl = S.per_line("transaction_duration_seconds", "n_lines")
    return fm.agg(
        F.count_if(F.col("label") != "UNKNOWN").alias("n_labeled"),
        F.count_if(F.col("label") == "FRAUD").alias("n_fraud"),
        F.count_if(~F.col("has_feedback")).alias("n_feedback_null"),
        F.count_if(F.col("has_feedback")).alias("n_feedback"),
        F.count_if((F.col("total_amount") > 50000) & (F.col("total_amount") < 150000)).alias("n_mid_amount"),
        F.count_if(F.col("daytime").isin("morning", "evening")).alias("n_morning_evening"),
        F.count_if(~F.isnan(dpl) & (F.abs(dpl) < F.lit(float("inf")))).alias("n_finite_duration_per_line"),
    )


@register("line_price_check", basket_sql(
    """SELECT l.transaction_id, l.id, ROUND(p.price * l.pieces_or_weight, 4) AS nominal_price,
              ROUND(p.price * l.pieces_or_weight - l.sales_price, 4) AS price_difference,
              ROUND(l.sales_price / NULLIF(p.price * l.pieces_or_weight, 0), 4) AS price_ratio,
              abs(l.sales_price / NULLIF(p.price * l.pieces_or_weight, 0) - 0.7) < 0.01 AS discount_30
       FROM transaction_lines l LEFT JOIN products p ON p.id = l.product_id"""))
def q_line_price(spark, sf_dir):
    """P16 / F17 / F18 / P9 over all lines: nominal price, difference, ratio, 30 % tag."""
    b = tables(spark, sf_dir)
    p = b.products.select(F.col("id").alias("product_id"), "price")
    j = b.lines.join(p, "product_id", "left")
    ratio = S.price_ratio("sales_price", "price", "pieces_or_weight")
    return finish(j.select(
        "transaction_id", "id", (F.col("price") * F.col("pieces_or_weight")).alias("nominal_price"),
        S.price_difference("price", "pieces_or_weight", "sales_price").alias("price_difference"),
        ratio.alias("price_ratio"), S.near(ratio, F.lit(0.7), 0.01).alias("discount_30"),
    ))


@register("camera_inserted_lines", basket_sql(
    "SELECT transaction_id, id, product_id, camera_product_similar FROM transaction_lines WHERE was_voided AND sales_price = 0"))
def q_camera_lines(spark, sf_dir):
    """Voided free lines (inserted by the camera)."""
    from tillsight.operators.audits import camera_inserted

    return camera_inserted(tables(spark, sf_dir).lines).select("transaction_id", "id", "product_id", "camera_product_similar")


@register("calendar_functions", basket_sql(
    """SELECT id, dayname(transaction_start) AS weekday, monthname(transaction_start) AS month_name,
              CASE CAST(month(transaction_start) AS VARCHAR) WHEN '1' THEN 'January' WHEN '2' THEN 'February' WHEN '3' THEN 'March'
                   WHEN '4' THEN 'April' WHEN '5' THEN 'May' WHEN '6' THEN 'June' WHEN '7' THEN 'July' WHEN '8' THEN 'August'
                   WHEN '9' THEN 'September' WHEN '10' THEN 'October' WHEN '11' THEN 'November' WHEN '12' THEN 'December' END AS month_from_text,
              CAST(year(transaction_start) AS INTEGER) AS year, CAST(second(transaction_start) AS INTEGER) AS second,
              strftime(transaction_start, '%Y-%m-%dT%H:%M:%S') AS start_iso,
              make_date(CAST(year(transaction_start) AS INTEGER), CAST(month(transaction_start) AS INTEGER), 1) AS month_start,
              ROUND(date_diff('microsecond', transaction_start, transaction_end) / 1e6, 4) AS duration_seconds,
              ROUND(CAST(CAST(trunc(date_diff('microsecond', transaction_start, transaction_end) / 1e6) AS BIGINT) AS DOUBLE) / NULLIF(n_lines, 0), 4) AS seconds_per_line,
              CAST(trunc(date_diff('microsecond', TIMESTAMP '1992-01-01 00:00:00', transaction_start) / 86400e6) AS BIGINT) AS days_since_1992,
              ROUND(LEAST(GREATEST(damage, 0.0), 25.0), 4) AS damage_clipped,
              CASE WHEN label = 'FRAUD' THEN 1 WHEN label IS NULL THEN NULL ELSE 0 END AS is_fraud
       FROM transactions"""))
def q_calendar(spark, sf_dir):
    """Calendar and duration functions on every receipt."""
    t = tables(spark, sf_dir).transactions
    st = F.col("transaction_start")
    return finish(t.select(
        "id", S.weekday_name(st).alias("weekday"), S.month_name(st).alias("month_name"),
        S.month_from_number(F.month(st).cast("string")).alias("month_from_text"),
        F.year(st).alias("year"), F.second(st).alias("second"), S.iso(st).alias("start_iso"),
        S.month_start(F.year(st), F.month(st)).alias("month_start"),
        S.seconds_between(st, "transaction_end").alias("duration_seconds"),
        S.per_line(S.whole_seconds(st, "transaction_end"), "n_lines").alias("seconds_per_line"),
        S.whole_days(F.lit("1992-01-01 00:00:00").cast("timestamp_ntz"), st).alias("days_since_1992"),
        S.clip("damage", 0.0, 25.0).alias("damage_clipped"), S.is_fraud("label").alias("is_fraud"),
    ))


def _ascii_sql(col: str) -> str:
    for src, dst in S.UMLAUTS:
        col = f"replace({col}, '{src}', '{dst}')"
    return col


@register("store_dimension", basket_sql(
    "SELECT CAST(id AS VARCHAR) AS store_id, " + "CASE location " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CITY_CODES.items())
    + " END AS location, urbanization, " + _ascii_sql("location") + " AS location_ascii, strftime(strptime(sco_introduction, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS sco_introduction FROM stores"))
def q_stores(spark, sf_dir):
    """Store dimension with recoded location, transliteration and parsed SCO date."""
    from tillsight.operators.features import store_features

    s = tables(spark, sf_dir).stores
    out = store_features(s).join(s.select(F.col("id").cast("string").alias("store_id"), S.transliterate("location").alias("location_ascii")), "store_id")
    return finish(out)
