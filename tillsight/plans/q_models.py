"""Registered queries: Spark ML training and evaluation (M-, T14-T16, X-rows).

Model scores are checked by properties (rows-only) — Spark ML is not the
reference's model library — except X3, whose 'external' model is the fixed
linear scorer and therefore has a SQL twin.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tillsight.operators import evaluate as V
from tillsight.operators import models as ML
from tillsight.operators import regression as R
from tillsight.operators import sampling as O
from tillsight.plans.basket_sql import feature_sql
from tillsight.plans.common import features
from tillsight.plans.q_rules import SCORED_CTE
from tillsight.plans.q_stats import _RANKED, _ROW_SPLIT
from tillsight.plans.registry import finish, register
from tillsight.session import cut_lineage
from tillsight.sources.files import scratch_path

MODEL_COLS = [
    "total_amount", "n_lines", "n_voided", "calculated_price_difference", "max_time_between_scans", "hour", "is_cash",
    "has_positive_price_difference", "feedback_top", "has_camera_detected_wrong_product_high_certainty", "price_unscanned_articles",
]


def _data(spark, sf_dir):
    fm = features(spark, sf_dir).where(F.col("label").isin("FRAUD", "NORMAL"))
    fm = fm.withColumn("y", (F.col("label") == "FRAUD").cast("int")).withColumn("is_cash", (F.col("payment_medium") == "CASH").cast("int"))
    fm = fm.withColumn("damage", F.coalesce(F.col("damage"), F.lit(0.0))).withColumn("_s", F.col("label"))
    data = ML.model_frame(fm, MODEL_COLS, keep=("_s",))
    split = O.split(data, ["_s"], "transaction_id", 0.2, 42)
    return data.drop("_s"), split.where(F.col("split") == "train").drop("_s", "split"), split.where(F.col("split") == "test").drop("_s", "split")


@register("model_comparison_cv")
def q_cv(spark, sf_dir):
    """M1 + M7 + M10 + X2 + A34: stratified CV of the whole factory, 5 folds and 5 repeats; metric × statistic × model."""
    data, _, _ = _data(spark, sf_dir)
    per_fold = ML.cross_validate(data, MODEL_COLS, ML.FACTORY, k=5, repeats=5)
    return finish(ML.compare_models(per_fold))


@register("damage_regressor")
def q_regressor(spark, sf_dir):
    """M3 + X1 + V13: GBT damage regressor on damage-only rows, metrics on the test split."""
    _, train, test = _data(spark, sf_dir)
    reg = ML.fit_regressor(train, MODEL_COLS, "damage_only")
    pred = reg.transform(test).withColumnRenamed("prediction", "damage_pred")
    return finish(V.regression_metrics(pred))


@register("combined_model")
def q_combined(spark, sf_dir):
    """M2 + M6: classifier + regressor + fitted malus, value on the test split."""
    _, train, test = _data(spark, sf_dir)
    clf, reg, malus = ML.fit_combined(train, MODEL_COLS)
    s = ML.score(test, clf, reg, cost_fp=malus)
    return finish(V.evaluate(s).select(F.lit(malus).alias("malus"), "*"))


@register("calibration_methods")
def q_calibration(spark, sf_dir):
    """M8 + V16: tree scores calibrated by sigmoid / isotonic / none on out-of-fold scores, Brier score each on the test split."""
    _, train, test = _data(spark, sf_dir)
    fitting = ML.out_of_fold_scores(train, "decision_tree", MODEL_COLS)
    s = ML.score(test, ML.classifier_pipeline("decision_tree", MODEL_COLS).fit(train))
    out = None
    for m in ("none", "sigmoid", "isotonic"):
        c = ML.calibrate(fitting, s, m).select("y", F.col("p_cal").alias("p"))
        b = V.brier(c).select(F.lit(m).alias("method"), "brier")
        out = b if out is None else out.unionByName(b)
    return finish(out)


@register("parameter_search")
def q_search(spark, sf_dir):
    """M9: 20 random settings of boosted trees, by business value (classifier) and R² (damage regressor) on the validation split."""
    _, train, test = _data(spark, sf_dir)
    return finish(ML.search(train, test, MODEL_COLS, "boosted_trees", ML.draw(ML.SEARCH_SPACE, 20)))


@register("feature_ablation")
def q_ablation(spark, sf_dir):
    """Leave-one-feature-out value for every model column, 5 folds."""
    data, _, _ = _data(spark, sf_dir)
    return finish(ML.ablate(data, MODEL_COLS, "decision_tree", k=5))


@register("final_models")
def q_final(spark, sf_dir):
    """M13 + S11: train on all labelled baskets, encoder included, save, load and score raw rows."""
    fm = features(spark, sf_dir).where(F.col("label").isin("FRAUD", "NORMAL"))
    fm = fm.withColumn("y", (F.col("label") == "FRAUD").cast("int")).withColumn("damage", F.coalesce(F.col("damage"), F.lit(0.0)))
    data = cut_lineage(fm, "final-rows")
    clf, reg = ML.train_final(data, scratch_path(spark, "models"))
    return finish(V.evaluate(ML.score(data, clf, reg)))


def _split_rows(spark, sf_dir):
    """The labelled rows with their split, written once for the passes over them."""
    data, train, test = _data(spark, sf_dir)
    split = lambda df, name: df.withColumn("split", F.lit(name))
    return ML.training_table(split(train, "train").unionByName(split(test, "test")), "split-rows")


@register("logit_screen")
def q_logit(spark, sf_dir):
    """T14 (+F26): univariate logit of every model column: pseudo-R² and accuracy on both splits, separation, relevance."""
    return finish(R.logit_screen(_split_rows(spark, sf_dir), MODEL_COLS))


#: 0/1 columns of the model frame; for these the maximum of the likelihood is known in closed form.
_FLAG_COLS = ["is_cash", "has_positive_price_difference", "feedback_top", "has_camera_detected_wrong_product_high_certainty"]


def _logit_sql() -> str:
    """T14 of 0/1 columns: the fitted probability of either value is its share of frauds among the train rows."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, split, y, COALESCE(CAST({c} AS INTEGER), 0) AS x, COUNT(*) AS n FROM sp GROUP BY ALL" for c in _FLAG_COLS)
    return feature_sql(
        """SELECT feature, ROUND(CASE WHEN ok THEN ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) END, 4) AS coefficient,
              ROUND(CASE WHEN ok THEN 1 - ll_train / null_train END, 4) AS pseudo_r2_train, ROUND(CASE WHEN ok THEN 1 - ll_test / null_test END, 4) AS pseudo_r2_test,
              NOT ok AS perfect_separation
       FROM fits""",
        f"""sp AS (SELECT * EXCLUDE (rk, n), CAST(label = 'FRAUD' AS INTEGER) AS y, CAST(payment_medium = 'CASH' AS INTEGER) AS is_cash, {_ROW_SPLIT} AS split
               FROM ({_RANKED} WHERE label IN ('FRAUD', 'NORMAL'))),
        cells AS ({cells}),
        shares AS (
          SELECT feature, SUM(n) FILTER (WHERE x = 1 AND y = 1) / SUM(n) FILTER (WHERE x = 1)::DOUBLE AS p1,
            SUM(n) FILTER (WHERE x = 0 AND y = 1) / SUM(n) FILTER (WHERE x = 0)::DOUBLE AS p0, COUNT(*) = 4 AS ok
          FROM cells WHERE split = 'train' GROUP BY feature),
        base AS (SELECT feature, split, SUM(n) FILTER (WHERE y = 1)::DOUBLE AS ones, SUM(n)::DOUBLE AS n FROM cells GROUP BY feature, split),
        nulls AS (SELECT feature, split, ones * ln(ones / n) + (n - ones) * ln(1 - ones / n) AS ll FROM base),
        lls AS (
          SELECT c.feature, c.split, SUM(n * CASE WHEN NOT ok THEN 0 WHEN x = 1 THEN CASE WHEN y = 1 THEN ln(p1) ELSE ln(1 - p1) END
            ELSE CASE WHEN y = 1 THEN ln(p0) ELSE ln(1 - p0) END END) AS ll
          FROM cells c JOIN shares s ON c.feature = s.feature GROUP BY c.feature, c.split),
        fits AS (
          SELECT s.*, a.ll AS ll_train, b.ll AS ll_test, c.ll AS null_train, d.ll AS null_test FROM shares s
          JOIN lls a ON s.feature = a.feature AND a.split = 'train' JOIN lls b ON s.feature = b.feature AND b.split = 'test'
          JOIN nulls c ON s.feature = c.feature AND c.split = 'train' JOIN nulls d ON s.feature = d.feature AND d.split = 'test')""",
    )


@register("logit_screen_flags", _logit_sql())
def q_logit_flags(spark, sf_dir):
    """The Newton screen of the 0/1 columns; their twin states the closed form."""
    out = R.logit_screen(_split_rows(spark, sf_dir), _FLAG_COLS)
    return finish(out.select("feature", "coefficient", "pseudo_r2_train", "pseudo_r2_test", "perfect_separation"))


@register("backward_elimination")
def q_backward(spark, sf_dir):
    """OLS backward elimination by p-value for the damage, all model columns, R² on both splits."""
    return finish(ML.reduce_model(_split_rows(spark, sf_dir), "damage", MODEL_COLS))


@register("backward_elimination_degree2")
def q_backward_degree(spark, sf_dir):
    """T15 + E8: the same over all products of two model columns."""
    return finish(ML.reduce_model(_split_rows(spark, sf_dir), "damage", MODEL_COLS, degree=2))


@register("backward_elimination_logit")
def q_backward_logit(spark, sf_dir):
    """Logit backward elimination for the label, all model columns, accuracy on both splits."""
    return finish(ML.reduce_model(_split_rows(spark, sf_dir), "y", MODEL_COLS, family="binomial"))


@register("pca_variance")
def q_pca(spark, sf_dir):
    """Explained variance of 5 principal components on standardised features."""
    data, _, _ = _data(spark, sf_dir)
    return finish(ML.pca_variance(data, MODEL_COLS, 5))


def _fixed_numpy(x: np.ndarray) -> np.ndarray:
    raw = -2.0 + 1.5 * x[:, 0] + 0.02 * x[:, 1] + 0.8 * x[:, 2]
    return np.round(1.0 / (1.0 + np.exp(-raw)), 6)


@register("external_scoring", feature_sql("SELECT transaction_id, ROUND(p, 4) AS p FROM scored", SCORED_CTE.strip()))
def q_external(spark, sf_dir):
    """Externally trained (numpy) model applied per Arrow batch with mapInPandas."""
    fm = features(spark, sf_dir, impute=False).select(
        "transaction_id", (F.col("payment_medium") == "CASH").cast("double").alias("cash"), F.col("n_lines").cast("double").alias("n"),
        F.coalesce(F.col("has_positive_price_difference"), F.lit(False)).cast("double").alias("flag"),
    )
    return finish(ML.score_external(fm, ["cash", "n", "flag"], _fixed_numpy))
