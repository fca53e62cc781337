"""Registered queries: audits and profiling (A-, J-, W4/W5, P17, F13 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.functions import scalar as S
from tillsight.operators import audits as A
from tillsight.operators import rules
from tillsight.operators.features import category_flags
from tillsight.plans.basket_sql import CATEGORIES, feature_sql
from tillsight.plans.common import features, tables
from tillsight.plans.registry import basket_sql, finish, register

DESCRIBE_COLS = ["total_amount", "n_lines", "damage", "mean_time_between_scans", "max_time_between_scans", "calculated_price_difference"]
MORE_FLAGS = ["has_voided", "has_unscanned", "feedback_top"]
FLAG_COLS = ["has_" + c.lower() for c in CATEGORIES] + MORE_FLAGS  # the twin's list; the query discovers the categories


@register("row_counts", basket_sql(
    "SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM transactions) AS n_transactions, "
    "(SELECT CAST(COUNT(*) AS BIGINT) FROM transaction_lines) AS n_lines, "
    "(SELECT CAST(COUNT(DISTINCT transaction_id) AS BIGINT) FROM transaction_lines) AS n_baskets_with_lines, "
    "(SELECT CAST(COUNT(DISTINCT product_id) AS BIGINT) FROM transaction_lines) AS n_products_sold"))
def q_row_counts(spark, sf_dir):
    """A1: row counts and exact distinct-key counts."""
    b = tables(spark, sf_dir)
    l = b.lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("transaction_id").alias("n_baskets_with_lines"),
                    F.count_distinct("product_id").alias("n_products_sold"))
    return l.select(b.transactions.agg(F.count(F.lit(1))).scalar().alias("n_transactions"), "*")


@register("value_counts_daytime", feature_sql(
    "SELECT daytime, COUNT(*) AS count, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 4) AS proportion FROM fm GROUP BY daytime"))
def q_value_counts(spark, sf_dir):
    """A2 + W5: value counts with share of total."""
    return finish(A.val_count(features(spark, sf_dir, impute=False), "daytime"))


@register("fraud_rate_by_hour", feature_sql(
    "SELECT hour, COUNT(*) AS total, COUNT(*) FILTER (WHERE label = 'FRAUD') AS fraud, "
    "COUNT(*) FILTER (WHERE label = 'NORMAL') AS normal, "
    "ROUND(CAST(COUNT(*) FILTER (WHERE label = 'FRAUD') AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE label IN ('FRAUD', 'NORMAL')), 0), 4) AS fraud_rate "
    "FROM fm GROUP BY hour"))
def q_fraud_rate(spark, sf_dir):
    """A3: conditional counts and class rate per group."""
    return finish(A.fraud_rate(features(spark, sf_dir, impute=False), "hour"))


def _describe_sql() -> str:
    parts = []
    for c in DESCRIBE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", COUNT({x}) AS count, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, "
            f"ROUND(AVG({x}), 4) AS mean, ROUND(STDDEV_SAMP({x}), 4) AS std, ROUND(MIN({x}), 4) AS min, "
            f"ROUND(quantile_cont({x}, 0.25), 4) AS p25, ROUND(quantile_cont({x}, 0.5), 4) AS p50, "
            f"ROUND(quantile_cont({x}, 0.75), 4) AS p75, ROUND(MAX({x}), 4) AS max FROM fm"
        )
    return feature_sql(" UNION ALL ".join(parts))


@register("describe_features", _describe_sql())
def q_describe(spark, sf_dir):
    """Describe with exact quartiles."""
    return finish(A.describe(features(spark, sf_dir), DESCRIBE_COLS))


@register("null_report", feature_sql(
    "SELECT \"column\", null_count FROM (UNPIVOT (SELECT COUNT(*) - COUNT(COLUMNS(*)) AS \"\\0\" FROM fm0) "
    "ON COLUMNS(*) INTO NAME \"column\" VALUE null_count) WHERE null_count > 0"))
def q_null_report(spark, sf_dir):
    """Null count per column (non-zero only) of the raw feature matrix, over all its columns."""
    return A.null_report(features(spark, sf_dir, impute=False))


@register("hist_total_amount", basket_sql(
    "SELECT CAST(floor(total_amount / 50000.0) * 50000.0 AS DOUBLE) AS bin, COUNT(*) AS count FROM transactions "
    "WHERE total_amount IS NOT NULL GROUP BY 1"))
def q_hist_fixed(spark, sf_dir):
    """Fixed-width histogram."""
    return finish(A.fixed_width_hist(tables(spark, sf_dir).transactions, "total_amount", 50000.0))


@register("hist_duration_by_label", feature_sql(
    """SELECT label, bin, ROUND(lo + (hi - lo) * bin / 19.0, 4) AS edge_left, COUNT(*) AS count FROM (
         SELECT label, lo, hi, CAST(LEAST(floor((x - lo) / (hi - lo) * 19), 18) AS INTEGER) AS bin
         FROM (SELECT label, CAST(time_to_first_scan AS DOUBLE) AS x FROM fm0 WHERE time_to_first_scan IS NOT NULL),
              (SELECT MIN(CAST(time_to_first_scan AS DOUBLE)) AS lo, MAX(CAST(time_to_first_scan AS DOUBLE)) AS hi FROM fm0)
         WHERE hi > lo)
       GROUP BY label, bin, lo, hi"""))
def q_hist_shared(spark, sf_dir):
    """Shared-edge (linspace) histogram per class."""
    return finish(A.shared_edge_hist(features(spark, sf_dir, impute=False), "time_to_first_scan", "label", 19))


@register("crosstab_payment_label", feature_sql(
    "SELECT payment_medium, label, COUNT(*) AS n FROM fm GROUP BY payment_medium, label"))
def q_crosstab(spark, sf_dir):
    """Contingency table (long form)."""
    return A.crosstab(features(spark, sf_dir, impute=False), "payment_medium", "label")


@register("crosstab_wide_daytime_label", feature_sql(
    "SELECT daytime, COUNT(*) FILTER (WHERE label = 'FRAUD') AS FRAUD, COUNT(*) FILTER (WHERE label = 'NORMAL') AS NORMAL, "
    "COUNT(*) FILTER (WHERE label = 'UNKNOWN') AS UNKNOWN FROM fm GROUP BY daytime"))
def q_crosstab_wide(spark, sf_dir):
    """Contingency table (wide, pivot with given values)."""
    return A.crosstab_wide(features(spark, sf_dir, impute=False), "daytime", "label", ["FRAUD", "NORMAL", "UNKNOWN"])


@register("crosstab_share_daytime_label", feature_sql(
    "SELECT daytime, label, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY daytime), 4) AS share "
    "FROM fm GROUP BY daytime, label"))
def q_crosstab_share(spark, sf_dir):
    """Row-normalised contingency table."""
    return finish(A.crosstab_share(features(spark, sf_dir, impute=False), "daytime", "label"))


_WD_ORDER = ", ".join(f"'{d}'" for d in S.WEEKDAYS)


@register("class_counts_weekday", feature_sql(
    f"SELECT day_of_week, COUNT(*) FILTER (WHERE label = 'FRAUD') AS FRAUD, COUNT(*) FILTER (WHERE label = 'NORMAL') AS NORMAL, "
    f"CAST(list_position([{_WD_ORDER}], day_of_week) AS INTEGER) AS \"order\" "
    f"FROM fm WHERE label IN ('FRAUD', 'NORMAL') GROUP BY day_of_week"))
def q_class_counts(spark, sf_dir):
    """Class counts over categories, 0 for missing, custom order."""
    return A.class_counts(features(spark, sf_dir, impute=False), "day_of_week", order=S.WEEKDAYS)


def _flag_rate_sql() -> str:
    parts = []
    for f in FLAG_COLS:
        de = S.CATEGORY_NAMES_DE.get(f)
        de_sql = f"'{de}'" if de else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT '{f}' AS feature, CAST(SUM(CAST({f} AS BIGINT)) FILTER (WHERE label = 'FRAUD') AS BIGINT) AS FRAUD, "
            f"CAST(SUM(CAST({f} AS BIGINT)) FILTER (WHERE label = 'NORMAL') AS BIGINT) AS NORMAL, {de_sql} AS category_de FROM fm"
        )
    return feature_sql(
        "SELECT feature, FRAUD, NORMAL, ROUND(CAST(FRAUD AS DOUBLE) / NULLIF(FRAUD + NORMAL, 0), 4) AS fraud_rate, category_de FROM ("
        + " UNION ALL ".join(parts) + ")"
    )


@register("flag_rate_by_label", _flag_rate_sql())
def q_flag_rate(spark, sf_dir):
    """A21 (+F11): wide -> long -> wide, fraud rate per flag, German category names."""
    fm = features(spark, sf_dir, impute=False)
    return finish(A.flag_rate_by_label(fm, category_flags(fm) + MORE_FLAGS))


@register("camera_quality_by_month", basket_sql(
    "SELECT CAST(year(\"timestamp\") AS INTEGER) AS year, CAST(month(\"timestamp\") AS INTEGER) AS month, "
    "ROUND(AVG(CAST(camera_product_similar AS DOUBLE)), 4) AS mean_similar, "
    "ROUND(SUM(CAST(round(camera_certainty * 100) AS BIGINT)) / COUNT(camera_certainty) / 100.0, 6) AS mean_certainty, "
    "COUNT(*) AS n_lines, make_date(CAST(year(\"timestamp\") AS INTEGER), CAST(month(\"timestamp\") AS INTEGER), 1) AS month_start "
    "FROM transaction_lines GROUP BY 1, 2"))
def q_camera_quality(spark, sf_dir):
    """A23 (+F4, F9): monthly camera metrics (mean certainty kept to 6 decimals: exact-cent sums)."""
    out = A.camera_quality_by_month(tables(spark, sf_dir).lines)
    return finish(out.withColumn("mean_certainty", F.round("mean_certainty", 6)), keep=("mean_certainty",))


@register("missing_products_by_label", basket_sql(
    """SELECT t.label, COUNT(*) AS n_baskets, CAST(SUM(m.n) AS BIGINT) AS n_lines, MAX(m.n) AS max_per_basket
       FROM (SELECT l.transaction_id, COUNT(*) AS n FROM transaction_lines l LEFT JOIN products p ON l.product_id = p.id
             WHERE p.id IS NULL GROUP BY l.transaction_id) m
       JOIN transactions t ON t.id = m.transaction_id GROUP BY t.label"""))
def q_missing_products(spark, sf_dir):
    """Missing-product audit per label."""
    b = tables(spark, sf_dir)
    return A.missing_products(b.transactions, b.lines, b.products)


@register("empty_baskets", basket_sql(
    "SELECT label, n_lines, COUNT(*) AS n_baskets FROM transactions t "
    "WHERE NOT EXISTS (SELECT 1 FROM transaction_lines l WHERE l.transaction_id = t.id) GROUP BY label, n_lines"))
def q_empty_baskets(spark, sf_dir):
    """Receipts without lines by label and n_lines."""
    b = tables(spark, sf_dir)
    return A.empty_baskets(b.transactions, b.lines)


@register("reconcile_by_label", basket_sql(
    """SELECT label, COUNT(*) AS n_baskets, COUNT(*) FILTER (WHERE abs(total_amount - s) > 0.01) AS n_mismatch,
              ROUND(SUM(total_amount - s), 4) AS diff_sum
       FROM (SELECT t.label, t.total_amount, SUM(l.sales_price) AS s FROM transactions t
             JOIN transaction_lines l ON l.transaction_id = t.id GROUP BY t.id, t.label, t.total_amount)
       GROUP BY label"""))
def q_reconcile(spark, sf_dir):
    """A26 (+P9): receipt total vs Σ line prices."""
    b = tables(spark, sf_dir)
    r = A.reconcile(b.transactions, b.lines)
    return finish(r.groupBy("label").agg(F.count(F.lit(1)).alias("n_baskets"), F.count_if("mismatch").alias("n_mismatch"),
                                         F.sum("diff").alias("diff_sum")))


@register("explain_damage", basket_sql(
    """SELECT label, COUNT(*) AS n_baskets, COUNT(*) FILTER (WHERE abs(d + damage) < 0.01) AS n_explained,
              ROUND(COALESCE(SUM(damage) FILTER (WHERE abs(d + damage) < 0.01), 0), 4) AS damage_explained,
              ROUND(COALESCE(SUM(damage), 0), 4) AS damage_total
       FROM (SELECT t.label, t.damage, t.total_amount - SUM(l.pieces_or_weight * p.price) AS d
             FROM transactions t JOIN transaction_lines l ON l.transaction_id = t.id JOIN products p ON p.id = l.product_id
             GROUP BY t.id, t.label, t.damage, t.total_amount)
       GROUP BY label"""))
def q_explain_damage(spark, sf_dir):
    """A27 (+W4): damage explained by nominal-price arithmetic."""
    b = tables(spark, sf_dir)
    return finish(A.explain_damage(b.transactions, b.lines, b.products))


@register("camera_coverage", basket_sql(
    """SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_lines, COUNT(*) AS n_baskets,
              (SELECT COUNT(*) FROM transactions WHERE label = 'FRAUD') AS n_frauds,
              COALESCE(BOOL_AND(label = 'FRAUD'), TRUE) AS all_fraud, COALESCE(BOOL_AND(ns), TRUE) AS all_not_similar,
              ROUND(COALESCE(SUM(damage), 0), 4) AS damage_rule,
              ROUND((SELECT COALESCE(SUM(damage), 0) FROM transactions), 4) AS damage_total,
              ROUND(COUNT(*) / (SELECT COUNT(*) FROM transactions WHERE label = 'FRAUD'), 4) AS share_frauds,
              ROUND(COALESCE(SUM(damage), 0) / (SELECT SUM(damage) FROM transactions), 4) AS share_damage
       FROM (SELECT l.transaction_id, COUNT(*) AS n, MAX(t.label) AS label, MAX(t.damage) AS damage,
                    BOOL_AND(NOT COALESCE(l.camera_product_similar, FALSE)) AS ns
             FROM transaction_lines l JOIN transactions t ON t.id = l.transaction_id
             WHERE l.was_voided AND l.sales_price = 0 GROUP BY l.transaction_id)"""))
def q_camera_coverage(spark, sf_dir):
    """A28 (+P17, A4): camera-inserted lines — coverage of frauds and damage."""
    b = tables(spark, sf_dir)
    return finish(A.coverage(b.transactions, A.camera_inserted(b.lines)))


def _price_diff_sql(only_valid: bool) -> str:
    cond = "WHERE NOT l.was_voided" if only_valid else ""
    return basket_sql(
        f"""SELECT t.label, COUNT(*) AS n_baskets, ROUND(SUM(d.diff), 4) AS diff_sum
            FROM (SELECT l.transaction_id, SUM(p.price * l.pieces_or_weight - l.sales_price) AS diff
                  FROM transaction_lines l JOIN products p ON p.id = l.product_id {cond} GROUP BY l.transaction_id) d
            JOIN transactions t ON t.id = d.transaction_id WHERE d.diff > 0.01 GROUP BY t.label"""
    )


@register("price_diff_screen", _price_diff_sql(False))
def q_price_diff(spark, sf_dir):
    """A29 (+F17): baskets with positive price difference by label."""
    b = tables(spark, sf_dir)
    return finish(A.screen_price_diff(b.transactions, b.lines, b.products, 0.01, False))


@register("price_diff_screen_valid", _price_diff_sql(True))
def q_price_diff_valid(spark, sf_dir):
    """Same on non-voided lines only."""
    b = tables(spark, sf_dir)
    return finish(A.screen_price_diff(b.transactions, b.lines, b.products, 0.01, True))


@register("discount_by_label", basket_sql(
    """SELECT t.label, COUNT(*) AS n_baskets, CAST(SUM(d.n) AS BIGINT) AS n_lines, ROUND(COALESCE(SUM(t.damage), 0), 4) AS damage
       FROM (SELECT l.transaction_id, COUNT(*) AS n FROM transaction_lines l JOIN products p ON p.id = l.product_id
             WHERE abs(l.sales_price / NULLIF(p.price * l.pieces_or_weight, 0) - 0.7) < 0.01 GROUP BY l.transaction_id) d
       JOIN transactions t ON t.id = d.transaction_id GROUP BY t.label"""))
def q_discount_by_label(spark, sf_dir):
    """A30 (+F18, P9): 30 % discount baskets by label with damage."""
    b = tables(spark, sf_dir)
    return finish(A.discount_by_label(b.transactions, b.lines, b.products))


@register("damage_lost", feature_sql(
    "SELECT ROUND((SELECT COALESCE(SUM(damage), 0) FROM transactions), 4) AS damage_raw, "
    "(SELECT COUNT(*) FROM transactions) AS rows_raw, ROUND(COALESCE(SUM(damage), 0), 4) AS damage_features, "
    "COUNT(*) AS rows_features, ROUND((SELECT COALESCE(SUM(damage), 0) FROM transactions) - COALESCE(SUM(damage), 0), 4) AS damage_lost "
    "FROM fm"))
def q_damage_lost(spark, sf_dir):
    """Damage and rows between raw and feature table."""
    b = tables(spark, sf_dir)
    return finish(A.damage_lost(b.transactions, features(spark, sf_dir, b=b, impute=False)))


@register("segment_report", feature_sql(
    """SELECT segment, COUNT(*) AS n_baskets, COUNT(*) FILTER (WHERE label = 'FRAUD') AS n_fraud,
              ROUND(COUNT(*) FILTER (WHERE label = 'FRAUD') / COUNT(*), 4) AS fraud_share,
              ROUND(COALESCE(SUM(damage), 0), 4) AS damage_sum, ROUND(AVG(damage), 4) AS damage_mean,
              ROUND(quantile_cont(damage, 0.5), 4) AS damage_median
       FROM (SELECT fm.*, CASE WHEN has_unscanned THEN 'unscanned' WHEN wd.tid IS NOT NULL THEN 'wrong_discount' ELSE 'rest' END AS segment
             FROM fm LEFT JOIN (SELECT DISTINCT l.transaction_id AS tid FROM transaction_lines l JOIN products p ON l.product_id = p.id
                                WHERE p.category IN ('PROMO', 'SMALL') AND abs(p.price * l.pieces_or_weight - l.sales_price) > 0.01) wd
             ON wd.tid = fm.transaction_id
             WHERE label <> 'UNKNOWN')
       GROUP BY segment"""))
def q_segment_report(spark, sf_dir):
    """A32 (+R8, J8): unscanned / wrong discount / rest segments with damage statistics."""
    b = tables(spark, sf_dir)
    wd = rules.wrong_discount_baskets(b.lines, b.products, ["PROMO", "SMALL"], 0.01)
    return finish(A.segment_report(features(spark, sf_dir, b=b, impute=False), wd))


@register("damage_p99", basket_sql(
    "SELECT ROUND(quantile_cont(damage, 0.99), 4) AS damage_p, COUNT(*) AS n_positive FROM transactions WHERE damage > 0"))
def q_damage_p99(spark, sf_dir):
    """Exact 99th percentile of positive damage."""
    return finish(A.damage_percentile(tables(spark, sf_dir).transactions, 0.99))


@register("join_loss", basket_sql(
    "SELECT (SELECT COUNT(*) FROM transaction_lines) AS rows_before, "
    "(SELECT COUNT(*) FROM transaction_lines l JOIN products p ON p.id = l.product_id) AS rows_after, "
    "(SELECT COUNT(*) FROM transaction_lines) - (SELECT COUNT(*) FROM transaction_lines l JOIN products p ON p.id = l.product_id) AS rows_lost"))
def q_join_loss(spark, sf_dir):
    """Inner-join row-loss audit."""
    b = tables(spark, sf_dir)
    return A.join_loss(b.lines, b.products)


@register("labeled_line_table", basket_sql(
    """SELECT t.label, p.category, s.urbanization, COUNT(*) AS n_lines, ROUND(SUM(l.sales_price), 4) AS sales
       FROM transaction_lines l JOIN transactions t ON t.id = l.transaction_id AND t.label <> 'UNKNOWN'
       LEFT JOIN products p ON p.id = l.product_id LEFT JOIN stores s ON s.id = t.store_id
       GROUP BY t.label, p.category, s.urbanization"""))
def q_labeled_line_table(spark, sf_dir):
    """Labelled lines with dimensions, summarised."""
    b = tables(spark, sf_dir)
    j = A.labeled_line_table(b.transactions, b.lines, b.products, b.stores)
    return finish(j.groupBy("label", "category", "urbanization").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("sales_price").alias("sales")))


@register("labeled_lines", basket_sql(
    """SELECT t.label, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE lp.transaction_id IS NULL) AS n_without_lines,
              COUNT(lp.category) AS n_with_product
       FROM transactions t LEFT JOIN (SELECT l.transaction_id, p.category FROM transaction_lines l
                                      LEFT JOIN products p ON p.id = l.product_id) lp ON lp.transaction_id = t.id
       GROUP BY t.label"""))
def q_labeled_lines(spark, sf_dir):
    """Receipts ⟕ (lines ⟕ products), receipts without lines kept."""
    b = tables(spark, sf_dir)
    j = A.labeled_lines(b.transactions, b.lines, b.products)
    return j.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("id").isNull()).alias("n_without_lines"),
        F.count("category").alias("n_with_product"),
    )


@register("wide_join", basket_sql(
    """SELECT s.urbanization AS urbanization_store, p.category AS category_product, t.label,
              COUNT(*) AS n, ROUND(SUM(l.sales_price), 4) AS sales, ROUND(SUM(p.price), 4) AS nominal
       FROM transaction_lines l LEFT JOIN transactions t ON t.id = l.transaction_id
       LEFT JOIN products p ON p.id = l.product_id LEFT JOIN stores s ON s.id = t.store_id
       GROUP BY 1, 2, 3"""))
def q_wide_join(spark, sf_dir):
    """Four-table wide join with suffixed names, summarised."""
    b = tables(spark, sf_dir)
    j = A.wide_join(b.transactions, b.lines, b.products, b.stores)
    return finish(j.groupBy("urbanization_store", "category_product", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sales_price").alias("sales"), F.sum("price_product").alias("nominal")))


@register("features_with_damage", feature_sql(
    """SELECT label, COUNT(*) AS n, ROUND(SUM(COALESCE(d.damage, 0.0)), 4) AS damage_joined
       FROM fm LEFT JOIN (SELECT id AS tid, damage FROM transactions WHERE damage > 0) d ON d.tid = fm.transaction_id
       GROUP BY label"""))
def q_with_damage(spark, sf_dir):
    """Features ⟕ damage, 0 when absent."""
    b = tables(spark, sf_dir)
    dmg = b.transactions.where(F.col("damage") > 0).select(F.col("id").alias("transaction_id"), "damage")
    j = A.with_damage(features(spark, sf_dir, b=b, impute=False).drop("damage"), dmg)
    return finish(j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("damage_joined").alias("damage_joined")))


@register("group_total_share", basket_sql(
    """SELECT transaction_id, CAST(id AS INTEGER) AS id, ROUND(sales_price / NULLIF(SUM(sales_price) OVER (PARTITION BY transaction_id), 0), 4) AS share
       FROM transaction_lines"""))
def q_group_total(spark, sf_dir):
    """Group total mapped back to rows (line share of its basket), whole table."""
    l = tables(spark, sf_dir).lines.select("transaction_id", "id", "sales_price")
    j = A.with_group_total(l, "transaction_id", "sales_price", "basket_total")
    return finish(j.select("transaction_id", "id", F.try_divide("sales_price", F.when(F.col("basket_total") != 0, F.col("basket_total"))).alias("share")))


@register("category_text_lengths", basket_sql(
    "SELECT CAST(length(category) AS INTEGER) AS length, COUNT(*) AS count FROM products GROUP BY 1"))
def q_text_lengths(spark, sf_dir):
    """distinct string lengths."""
    return A.text_lengths(tables(spark, sf_dir).products, "category")
