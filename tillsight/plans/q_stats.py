"""Registered queries: statistics.

SQL twins recompute χ² the long way (full cell lattice including empty cells,
Yates per cell), ranks with window functions, and moments from definitions.
p-values need special functions DuckDB lacks, so the queries carrying them
are registered without a twin (rows-only) and tested against textbook values
in ``tests/test_stats.py``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import sampling as O
from tillsight.operators import stats as T
from tillsight.plans.basket_sql import CATEGORIES, feature_sql
from tillsight.plans.common import features
from tillsight.plans.q_sampling import _rank
from tillsight.plans.registry import finish, register

_LAB = "label IN ('FRAUD', 'NORMAL')"
CAT_COLS = ["payment_medium", "daytime", "day_of_week", "feedback_categorical", "cash_desk", "month", "urbanization"]
NUM_COLS = ["total_amount", "n_lines", "transaction_duration_seconds", "mean_time_between_scans", "max_product_price"]
CORR_COLS = ["total_amount", "n_lines", "transaction_duration_seconds", "max_product_price", "calculated_price_difference", "hour"]
SCORE_COLS = ["n_lines", "n_voided", "n_age_restricted", "n_sold_by_weight", "hour"]


def _labelled(spark, sf_dir, impute: bool = False):
    return features(spark, sf_dir, impute=impute).where(F.col("label").isin("FRAUD", "NORMAL"))


def _chi2_sql(ct: str, correction: bool = True) -> str:
    """χ² per feature from a CTE ``ct(feature, a, b, n)``, over the full cell lattice."""
    yates = "CASE WHEN (n_r - 1) * (n_c - 1) = 1 THEN pow(greatest(abs(o - r_tot * c_tot / n_tot) - 0.5, 0), 2) ELSE pow(o - r_tot * c_tot / n_tot, 2) END" \
        if correction else "pow(o - r_tot * c_tot / n_tot, 2)"
    return f"""
cells AS (SELECT r0.feature, r0.a, c0.b FROM (SELECT DISTINCT feature, a FROM {ct}) r0 JOIN (SELECT DISTINCT feature, b FROM {ct}) c0 USING (feature)),
full_ct AS (SELECT cells.*, COALESCE({ct}.n, 0) AS o FROM cells LEFT JOIN {ct} USING (feature, a, b)),
marg AS (SELECT *, SUM(o) OVER (PARTITION BY feature, a) AS r_tot, SUM(o) OVER (PARTITION BY feature, b) AS c_tot,
                SUM(o) OVER (PARTITION BY feature) AS n_tot FROM full_ct),
dims AS (SELECT feature, COUNT(DISTINCT a) AS n_r, COUNT(DISTINCT b) AS n_c FROM {ct} GROUP BY feature),
chi AS (SELECT m.feature, SUM({yates} / (r_tot * c_tot / n_tot)) AS chi2, CAST((n_r - 1) * (n_c - 1) AS BIGINT) AS dof,
               CAST(MAX(n_tot) AS BIGINT) AS n, CAST(n_r AS BIGINT) AS n_rows, CAST(n_c AS BIGINT) AS n_cols
        FROM marg m JOIN dims USING (feature) GROUP BY m.feature, n_r, n_c)"""


def _long_ct(cols, b_expr: str, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS a, {b_expr} AS b, COUNT(*) AS n FROM fm WHERE {where} AND {c} IS NOT NULL GROUP BY 2, 3"
        for c in cols
    )


@register("chi2_payment_label", feature_sql(
    "SELECT ROUND(chi2, 4) AS chi2, dof, n, n_rows, n_cols FROM chi WHERE n_rows >= 2 AND n_cols >= 2",
    f"ct AS ({_long_ct(['payment_medium'], 'label', 'TRUE')})," + _chi2_sql("ct")))
def q_chi2(spark, sf_dir):
    """χ² test payment medium × label (2×3, no correction)."""
    return finish(T.chi2_test(features(spark, sf_dir, impute=False), "payment_medium", "label").drop("p_value"))


@register("chi2_payment_fraud_2x2", feature_sql(
    "SELECT ROUND(chi2, 4) AS chi2, dof, n, n_rows, n_cols FROM chi WHERE n_rows >= 2 AND n_cols >= 2",
    f"ct AS ({_long_ct(['payment_medium'], 'label', _LAB)})," + _chi2_sql("ct")))
def q_chi2_2x2(spark, sf_dir):
    """T1 (N16): 2×2 table, Yates correction applied."""
    return finish(T.chi2_test(_labelled(spark, sf_dir), "payment_medium", "label").drop("p_value"))


@register("chi2_test_pvalue")
def q_chi2_p(spark, sf_dir):
    """Statistic with p-value (rows-only; p checked in tests)."""
    return finish(T.chi2_test(_labelled(spark, sf_dir), "daytime", "label"))


@register("chi2_expected", feature_sql(
    "SELECT payment_medium, label, observed, ROUND(expected, 4) AS expected FROM ("
    "SELECT payment_medium, label, COUNT(*) AS observed, "
    "SUM(COUNT(*)) OVER (PARTITION BY payment_medium) * SUM(COUNT(*)) OVER (PARTITION BY label) / SUM(COUNT(*)) OVER () AS expected "
    "FROM fm GROUP BY payment_medium, label)"))
def q_chi2_expected(spark, sf_dir):
    """Expected counts table."""
    return finish(T.chi2_expected(features(spark, sf_dir, impute=False), "payment_medium", "label"))


@register("chi2_screen", feature_sql(
    "SELECT feature, ROUND(chi2, 4) AS chi2, dof, n, n_rows, n_cols FROM chi WHERE n_rows >= 2 AND n_cols >= 2",
    f"ct AS ({_long_ct(CAT_COLS, 'label', _LAB)})," + _chi2_sql("ct")))
def q_chi2_screen(spark, sf_dir):
    """χ² of every categorical feature against the label (one pass)."""
    return finish(T.chi2_screen(_labelled(spark, sf_dir), CAT_COLS).drop("p_value", "significance"))


@register("chi2_screen_significance")
def q_chi2_screen_sig(spark, sf_dir):
    """T2 + F26: with p-values and significance labels (rows-only)."""
    return finish(T.chi2_screen(_labelled(spark, sf_dir), CAT_COLS))


def _score_sql() -> str:
    parts = []
    for c in SCORE_COLS:
        parts.append(f"SELECT '{c}' AS feature, label, COUNT(*) AS nk, SUM(CAST({c} AS DOUBLE)) AS obs FROM fm WHERE {_LAB} GROUP BY label")
    return feature_sql(
        """SELECT feature, ROUND(SUM(pow(obs - tot * nk / nn, 2) / (tot * nk / nn)), 4) AS chi2, CAST(COUNT(*) - 1 AS BIGINT) AS dof
           FROM (SELECT *, SUM(obs) OVER (PARTITION BY feature) AS tot, SUM(nk) OVER (PARTITION BY feature) AS nn FROM per)
           GROUP BY feature""",
        "per AS (" + " UNION ALL ".join(parts) + ")",
    )


@register("chi2_feature_scores", _score_sql())
def q_chi2_scores(spark, sf_dir):
    """χ² feature scores of non-negative features."""
    return finish(T.chi2_feature_scores(_labelled(spark, sf_dir), SCORE_COLS).drop("p_value"))


def _welch_sql(cols, grp: str, g1: str, g2: str, src: str) -> str:
    parts = [
        f"""SELECT '{c}' AS feature,
              AVG(CAST({c} AS DOUBLE)) FILTER (WHERE {grp} = '{g1}') AS m1, AVG(CAST({c} AS DOUBLE)) FILTER (WHERE {grp} = '{g2}') AS m2,
              VAR_SAMP(CAST({c} AS DOUBLE)) FILTER (WHERE {grp} = '{g1}') AS v1, VAR_SAMP(CAST({c} AS DOUBLE)) FILTER (WHERE {grp} = '{g2}') AS v2,
              COUNT({c}) FILTER (WHERE {grp} = '{g1}') AS n1, COUNT({c}) FILTER (WHERE {grp} = '{g2}') AS n2 FROM {src}"""
        for c in cols
    ]
    return " UNION ALL ".join(parts)


@register("welch_by_label", feature_sql(
    """SELECT feature, ROUND(m1, 4) AS mean_1, ROUND(m2, 4) AS mean_2, ROUND(sqrt(v1), 4) AS std_1, ROUND(sqrt(v2), 4) AS std_2,
              n1 AS n_1, n2 AS n_2, ROUND((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t,
              ROUND(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS dof
       FROM (""" + _welch_sql(NUM_COLS, "label", "FRAUD", "NORMAL", "fm") + ") WHERE n1 > 1 AND n2 > 1"))
def q_welch(spark, sf_dir):
    """T4: Welch t statistic and dof, fraud vs normal."""
    return finish(T.welch(features(spark, sf_dir), NUM_COLS, "label", "FRAUD", "NORMAL").drop("p_value"))


@register("welch_pvalues")
def q_welch_p(spark, sf_dir):
    """T4: with two-sided p-values (rows-only)."""
    return finish(T.welch(features(spark, sf_dir), NUM_COLS, "label", "FRAUD", "NORMAL"))


#: The twins' list of the feature matrix' columns; the queries take them from its schema.
_FLAGS = ["has_feedback", "feedback_low", "feedback_middle", "feedback_high", "feedback_top", "has_voided", "has_unscanned", "has_age_restricted",
          "has_sold_by_weight", "has_camera_detected_wrong_product", "has_camera_detected_wrong_product_high_certainty",
          *["has_" + c.lower() for c in CATEGORIES], "has_positive_price_difference"]
_NUMBERS = ["total_amount", "n_lines", "hour", "transaction_duration_seconds", "n_voided", "price_unscanned_articles", "n_age_restricted",
            "popularity_max", "popularity_min", "max_product_price", "n_sold_by_weight", "calculated_price_difference", "mean_time_between_scans",
            "max_time_between_scans", "time_to_first_scan", "time_from_last_scan_to_end", "days_since_sco_introduction"]
_TEXTS = ["store_id", "cash_desk", "payment_medium", "feedback_categorical", "daytime", "hour_categorical", "day_of_week", "month", "location", "urbanization"]
_NO_FEATURES = ("transaction_id", "damage", "label")


def _drift_sql(source: str) -> str:
    """T5 over every column of the rows of ``source``, a query with a column ``side`` (a or b)."""
    variance = "(v1 / n1 + v2 / n2)"
    return feature_sql(
        f"""SELECT feature, 'welch' AS test, ROUND((m1 - m2) / NULLIF(sqrt{variance}, 0), 4) AS statistic,
              ROUND(pow{variance[:-1]}, 2) / NULLIF(pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1), 0), 4) AS dof
       FROM (""" + _welch_sql(_NUMBERS + _FLAGS, "side", "a", "b", "sides") + """) WHERE n1 > 1 AND n2 > 1
       UNION ALL SELECT feature, 'chi2', ROUND(chi2, 4), CAST(dof AS DOUBLE) FROM chi WHERE n_rows >= 2 AND n_cols >= 2""",
        f"sides AS ({source}), ct AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS a, side AS b, COUNT(*) AS n FROM sides WHERE {c} IS NOT NULL GROUP BY 2, 3" for c in _TEXTS)
        + ")," + _chi2_sql("ct"))


_ROW_SPLIT = "CASE WHEN rk <= CAST(round(n * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END"
_RANKED = f"SELECT *, {_rank('label', 'transaction_id')} AS rk, COUNT(*) OVER (PARTITION BY label) AS n FROM fm"


@register("drift_labeled_unlabeled", _drift_sql("SELECT *, CASE WHEN label = 'UNKNOWN' THEN 'b' ELSE 'a' END AS side FROM fm"))
def q_drift(spark, sf_dir):
    """T5: labelled vs unlabelled baskets — Welch for every numeric, χ² for every text column."""
    fm = features(spark, sf_dir)
    num, cat = T.columns_by_kind(fm, _NO_FEATURES)
    return finish(T.drift_report(fm.where(F.col("label") != "UNKNOWN"), fm.where(F.col("label") == "UNKNOWN"), num, cat).drop("p_value"))


@register("drift_train_test", _drift_sql(f"SELECT * EXCLUDE (rk, n), CASE WHEN {_ROW_SPLIT} = 'train' THEN 'a' ELSE 'b' END AS side FROM ({_RANKED} WHERE {_LAB})"))
def q_drift_split(spark, sf_dir):
    """T5 (+O8): train vs test rows of the stratified split of the labelled baskets, every column."""
    fm = _labelled(spark, sf_dir, impute=True)
    num, cat = T.columns_by_kind(fm, _NO_FEATURES)
    s = O.split(fm, ["label"], "transaction_id", 0.2, 42)
    return finish(T.drift_report(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), num, cat).drop("p_value"))


_CV_COLS = ["payment_medium", "daytime", "day_of_week", "cash_desk"]


def _cv_sql() -> str:
    from itertools import combinations

    ct = " UNION ALL ".join(
        f"SELECT '{x}|{y}' AS feature, CAST({x} AS VARCHAR) AS a, CAST({y} AS VARCHAR) AS b, COUNT(*) AS n FROM fm "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 2, 3" for x, y in combinations(_CV_COLS, 2)
    )
    return feature_sql(
        """SELECT split_part(feature, '|', 1) AS col1, split_part(feature, '|', 2) AS col2,
                  ROUND(sqrt(greatest(0.0, chi2 / n - (n_cols - 1) * (n_rows - 1) / (n - 1.0))
                        / least((n_cols - pow(n_cols - 1, 2) / (n - 1.0)) - 1, (n_rows - pow(n_rows - 1, 2) / (n - 1.0)) - 1)), 4) AS cramers_v
           FROM chi WHERE n_rows >= 2 AND n_cols >= 2""",
        f"ct AS ({ct})," + _chi2_sql("ct"),
    )


@register("cramers_v", _cv_sql())
def q_cramers_v(spark, sf_dir):
    """Bias-corrected Cramér's V for all pairs of categorical columns."""
    return finish(T.cramers_v(features(spark, sf_dir, impute=False), _CV_COLS))


def _pairs(cols):
    from itertools import combinations

    return list(combinations(cols, 2))


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in CORR_COLS)


@register("pearson_matrix", feature_sql(
    " UNION ALL ".join(f"SELECT '{x}' AS col1, '{y}' AS col2, ROUND(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 4) AS r FROM fm WHERE {_COMPLETE}"
                       for x, y in _pairs(CORR_COLS))))
def q_pearson(spark, sf_dir):
    """Pearson matrix on complete rows."""
    return finish(T.pearson_matrix(features(spark, sf_dir, impute=False), CORR_COLS))


def _rank_cte(cols) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    ranks = ", ".join(
        f"RANK() OVER (ORDER BY CAST({c} AS DOUBLE)) + (COUNT(*) OVER (PARTITION BY CAST({c} AS DOUBLE)) - 1) / 2.0 AS rk_{c}" for c in cols
    )
    return f"rk AS (SELECT transaction_id, {ranks} FROM fm WHERE {complete})"


@register("spearman_matrix", feature_sql(
    " UNION ALL ".join(f"SELECT '{x}' AS col1, '{y}' AS col2, ROUND(corr(rk_{x}, rk_{y}), 4) AS rho, ROUND(abs(corr(rk_{x}, rk_{y})), 4) AS abs_rho, "
                       f"ROUND(1.0 - abs(corr(rk_{x}, rk_{y})), 4) AS distance FROM rk" for x, y in _pairs(CORR_COLS)),
    _rank_cte(CORR_COLS)))
def q_spearman(spark, sf_dir):
    """Spearman matrix with |ρ| and 1 - |ρ| distance (exact average ranks)."""
    return finish(T.spearman_matrix(features(spark, sf_dir, impute=False), CORR_COLS, "transaction_id"))


_GAP_FEATURES = ["n_lines", "total_amount", "transaction_duration_seconds", "hour"]
_GAP_ALL = [*_GAP_FEATURES, "max_product_price"]


@register("monotone_gap", feature_sql(
    "SELECT feature, ROUND(pearson, 4) AS pearson, ROUND(spearman, 4) AS spearman, ROUND(spearman - pearson, 4) AS diff FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, (SELECT corr(CAST({f} AS DOUBLE), CAST(max_product_price AS DOUBLE)) FROM fm WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in _GAP_ALL)
        + f") AS pearson, (SELECT corr(rk_{f}, rk_max_product_price) FROM rk) AS spearman" for f in _GAP_FEATURES)
    + ")", _rank_cte(_GAP_ALL)))
def q_monotone_gap(spark, sf_dir):
    """Pearson vs Spearman against a target, sorted by gap."""
    return finish(T.monotone_gap(features(spark, sf_dir, impute=False), _GAP_FEATURES, "max_product_price", "transaction_id"))


@register("point_biserial", feature_sql(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, ROUND(corr(CAST(label = 'FRAUD' AS DOUBLE), CAST({c} AS DOUBLE)), 4) AS r FROM fm WHERE {_LAB}"
                       for c in NUM_COLS)))
def q_point_biserial(spark, sf_dir):
    """Point-biserial correlation of is_fraud with numeric features."""
    fm = _labelled(spark, sf_dir, impute=True).withColumn("is_fraud", (F.col("label") == "FRAUD").cast("int"))
    return finish(T.point_biserial(fm, "is_fraud", NUM_COLS))


@register("outlier_counts", feature_sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT(*) FILTER (WHERE abs(CAST({c} AS DOUBLE) - (SELECT AVG(CAST({c} AS DOUBLE)) FROM fm)) / "
        f"(SELECT STDDEV_POP(CAST({c} AS DOUBLE)) FROM fm) > 3) AS n_outliers FROM fm WHERE {c} IS NOT NULL" for c in NUM_COLS)))
def q_outliers(spark, sf_dir):
    """|z| > 3 outlier counts (population std)."""
    return T.outlier_counts(features(spark, sf_dir), NUM_COLS)


def _ols_sql() -> str:
    """T12 by centred moments, for every column."""
    moments = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, split, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy
            FROM (SELECT split, CAST({c} AS DOUBLE) AS x, damage AS y FROM sp) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY split"""
        for c in _NUMBERS + _FLAGS
    )
    return feature_sql(
        """SELECT feature, ROUND(slope, 4) AS slope, ROUND(icpt, 4) AS intercept, ROUND(r * r, 4) AS r2_train,
              ROUND(1.0 - (syy_t - 2 * slope * sxy_t + slope * slope * sxx_t + n_t * pow(my_t - icpt - slope * mx_t, 2)) / NULLIF(syy_t, 0), 4) AS r2_test,
              ROUND(r, 4) AS r, n, ROUND(slope / NULLIF(sqrt(greatest(syy - slope * slope * sxx, 0.0) / (n - 2) / NULLIF(sxx, 0)), 0), 4) AS t
       FROM fit""",
        f"""sp AS (SELECT * EXCLUDE (rk, n), {_ROW_SPLIT} AS split FROM ({_RANKED} WHERE damage IS NOT NULL)), m AS ({moments}),
        fit AS (
          SELECT *, my - slope * mx AS icpt FROM (
            SELECT a.*, a.sxy / NULLIF(a.sxx, 0) AS slope, a.sxy / NULLIF(sqrt(a.sxx * a.syy), 0) AS r,
              b.n AS n_t, b.mx AS mx_t, b.my AS my_t, b.sxx AS sxx_t, b.sxy AS sxy_t, b.syy AS syy_t
            FROM m a LEFT JOIN m b ON a.feature = b.feature AND b.split = 'test' WHERE a.split = 'train'))""",
    )


@register("ols_screen", _ols_sql())
def q_ols(spark, sf_dir):
    """T12 (+O8): univariate OLS of the damage on every numeric column, R² on train and test, slope t."""
    fm = features(spark, sf_dir).where(F.col("damage").isNotNull())
    num, _ = T.columns_by_kind(fm, _NO_FEATURES)
    return finish(T.ols_screen(O.split(fm, ["label"], "transaction_id", 0.2, 42), num, "damage").drop("p_value"))


@register("residual_checks", feature_sql(
    """SELECT ROUND(n * r2, 4) AS bp_lm, ROUND(m3 / pow(m2, 1.5), 4) AS skewness, ROUND(m4 / pow(m2, 2) - 3, 4) AS excess_kurtosis
       FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS n, regr_r2(e * e, x) AS r2, AVG(pow(e - mu, 2)) AS m2, AVG(pow(e - mu, 3)) AS m3,
                    AVG(pow(e - mu, 4)) AS m4
             FROM (SELECT *, AVG(e) OVER () AS mu FROM res))""",
    "res AS (SELECT damage - (0.0001 * total_amount) AS e, CAST(n_lines AS DOUBLE) AS x FROM fm WHERE damage IS NOT NULL)"))
def q_residuals(spark, sf_dir):
    """Breusch-Pagan LM and residual moments."""
    fm = features(spark, sf_dir, impute=False).where(F.col("damage").isNotNull())
    r = fm.select((F.col("damage") - F.lit(0.0001) * F.col("total_amount")).alias("e"), "n_lines")
    return finish(T.residual_checks(r, "e", "n_lines").select("bp_lm", "skewness", "excess_kurtosis"))


@register("residual_normality")
def q_residual_normality(spark, sf_dir):
    """D'Agostino K² and Breusch-Pagan p-values (rows-only)."""
    fm = features(spark, sf_dir, impute=False).where(F.col("damage").isNotNull())
    r = fm.select((F.col("damage") - F.lit(0.0001) * F.col("total_amount")).alias("e"), "n_lines")
    return finish(T.residual_checks(r, "e", "n_lines"))
