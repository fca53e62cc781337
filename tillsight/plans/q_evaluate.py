"""Registered queries: evaluation on the fixed linear score (V-, W6, W7, M4, M5, M12, A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import evaluate as V
from tillsight.plans.basket_sql import feature_sql
from tillsight.plans.common import features
from tillsight.plans.q_rules import SCORED_CTE
from tillsight.plans.registry import finish, register

EVAL_CTES = SCORED_CTE.strip() + """,
ev AS (
  SELECT transaction_id, CAST(label = 'FRAUD' AS INTEGER) AS y, COALESCE(damage, 0.0) AS damage, p, damage_pred,
         CAST(p > 10.0 / (5.0 + 10.0 + damage_pred) AS INTEGER) AS yhat
  FROM scored WHERE label IN ('FRAUD', 'NORMAL')
)"""

COEFFICIENTS = {
    "n_lines": 0.02, "total_amount": 0.00001, "max_product_price": 0.001, "calculated_price_difference": 0.01,
    "transaction_duration_seconds": 0.001, "hour": 0.05, "n_voided": 0.3,
}


def _lit(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _grid_cte(name: str, grid, col: str = "v") -> str:
    rows = ", ".join(f"({i}, {_lit(v)})" for i, v in enumerate(grid))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t(idx, {col}))"


def ev_sql(body: str, extra: str = "") -> str:
    return feature_sql(body, EVAL_CTES + ("," + extra if extra else ""))


def _ev(spark, sf_dir):
    return V.eval_table(features(spark, sf_dir, impute=False))  # reads no imputed column


_METRICS_SQL = """
SELECT tp, fp, fn, tn, ROUND(damage_total, 4) AS damage_total, ROUND(damage_prevented, 4) AS damage_prevented,
       ROUND(damage_missed, 4) AS damage_missed, ROUND(CAST(5.0 * tp AS DOUBLE), 4) AS detected_bonus, ROUND(CAST(10.0 * fp AS DOUBLE), 4) AS fp_penalty,
       ROUND(5.0 * tp - 10.0 * fp - damage_missed, 4) AS business_value,
       ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0.0), 4) AS precision, ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0.0), 4) AS recall,
       ROUND(COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0), 4) AS f1,
       ROUND(COALESCE((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
             / NULLIF(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0), 4) AS mcc,
       ROUND(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 4) AS accuracy
FROM (SELECT COUNT(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, COUNT(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
             COUNT(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, COUNT(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn,
             COALESCE(SUM(damage), 0) AS damage_total,
             COALESCE(SUM(damage) FILTER (WHERE y = 1 AND yhat = 1), 0) AS damage_prevented,
             COALESCE(SUM(damage) FILTER (WHERE y = 1 AND yhat = 0), 0) AS damage_missed
      FROM ev)"""


@register("evaluation_metrics", ev_sql(_METRICS_SQL))
def q_metrics(spark, sf_dir):
    """V1 + V2 + V5 + V6 (+M5): confusion, class metrics, damage and business value."""
    return finish(V.evaluate(_ev(spark, sf_dir)))


_CUM = """cum AS (
  SELECT score, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS n_pos, SUM(neg) OVER () AS n_neg
  FROM (SELECT p AS score, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 0) AS neg FROM ev GROUP BY p)
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


@register("average_precision", ev_sql(
    "SELECT ROUND(SUM(dr * pr), 4) AS average_precision FROM (SELECT r - COALESCE(LAG(r) OVER (ORDER BY score DESC), 0.0) AS dr, pr "
    "FROM (SELECT score, CAST(tp AS DOUBLE) / n_pos AS r, CAST(tp AS DOUBLE) / (tp + fp) AS pr FROM cum))", _CUM))
def q_average_precision(spark, sf_dir):
    """V3 (+W7): average precision with ties grouped."""
    return finish(V.average_precision(_ev(spark, sf_dir)))


@register("roc_points", ev_sql(
    "SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL "
    "SELECT score, ROUND(CAST(fp AS DOUBLE) / n_neg, 4), ROUND(CAST(tp AS DOUBLE) / n_pos, 4) FROM cum", _CUM))
def q_roc(spark, sf_dir):
    """V4: ROC points per distinct score (thresholds are 6-decimal scores, kept as is)."""
    return finish(V.roc(_ev(spark, sf_dir)), keep=("threshold",))


@register("roc_auc", ev_sql(
    "SELECT ROUND(SUM(a), 4) AS auc FROM (SELECT (fpr - LAG(fpr) OVER (ORDER BY threshold DESC)) * "
    "(tpr + LAG(tpr) OVER (ORDER BY threshold DESC)) / 2.0 AS a FROM ("
    "SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL "
    "SELECT score, CAST(fp AS DOUBLE) / n_neg, CAST(tp AS DOUBLE) / n_pos FROM cum))", _CUM))
def q_auc(spark, sf_dir):
    """V4: area under the ROC curve (trapezoid)."""
    return finish(V.auc(_ev(spark, sf_dir)))


def _sweep_sql(grid, name: str, positive: str) -> str:
    return ev_sql(
        f"""SELECT g.idx, ROUND(g.v, 4) AS {name},
                   COUNT(*) FILTER (WHERE y = 1 AND {positive}) AS tp, COUNT(*) FILTER (WHERE y = 0 AND {positive}) AS fp,
                   ROUND(5.0 * COUNT(*) FILTER (WHERE y = 1 AND {positive}) - 10.0 * COUNT(*) FILTER (WHERE y = 0 AND {positive})
                         - COALESCE(SUM(damage) FILTER (WHERE y = 1 AND NOT ({positive})), 0), 4) AS business_value,
                   ROUND(COALESCE(SUM(damage) FILTER (WHERE y = 1 AND NOT ({positive})), 0), 4) AS damage_missed
            FROM g, ev GROUP BY g.idx, g.v""",
        _grid_cte("g", grid),
    )


def _best_sql(grid, name: str, positive: str) -> str:
    inner = _sweep_sql(grid, name, positive)
    return inner.replace("FROM g, ev GROUP BY g.idx, g.v", "FROM g, ev GROUP BY g.idx, g.v ORDER BY business_value DESC, g.idx LIMIT 1")


@register("threshold_sweep", _sweep_sql(V.THRESHOLDS_100, "threshold", "p > g.v"))
def q_threshold_sweep(spark, sf_dir):
    """V7: value for 100 thresholds in [0.1, 1.0]."""
    return finish(V.threshold_sweep(_ev(spark, sf_dir)))


@register("threshold_best", _best_sql(V.THRESHOLDS_100, "threshold", "p > g.v"))
def q_threshold_best(spark, sf_dir):
    """V7 + O3: best threshold (first maximum)."""
    return finish(V.best(V.threshold_sweep(_ev(spark, sf_dir))))


_GATED = "(p >= g.v AND p * 5.0 - (1.0 - p) * 10.0 > -p * damage_pred)"


@register("gated_threshold_sweep", _sweep_sql(V.THRESHOLDS_18, "threshold", _GATED).replace(
    " AS business_value", f" AS business_value, COUNT(*) FILTER (WHERE {_GATED}) AS n_controls"))
def q_gated_sweep(spark, sf_dir):
    """V7: the 18 thresholds of the sweep that also asks for the larger expected gain; controls and value."""
    return finish(V.gated_sweep(_ev(spark, sf_dir)))


@register("threshold_sweep_101", _sweep_sql(V.THRESHOLDS_101, "threshold", "p > g.v"))
def q_threshold_sweep_101(spark, sf_dir):
    """V7: 101 thresholds in [0, 1]."""
    return finish(V.threshold_sweep(_ev(spark, sf_dir), V.THRESHOLDS_101))


@register("malus_sweep", _sweep_sql(V.MALUS_GRID, "malus", "p > g.v / (5.0 + g.v + damage_pred)"))
def q_malus_sweep(spark, sf_dir):
    """V8: cost rule swept over malus 1..199."""
    return finish(V.malus_sweep(_ev(spark, sf_dir)))


@register("malus_best", _best_sql(V.MALUS_GRID, "malus", "p > g.v / (5.0 + g.v + damage_pred)"))
def q_malus_best(spark, sf_dir):
    """V8 + O3: best malus."""
    return finish(V.best(V.malus_sweep(_ev(spark, sf_dir))))


@register("damage_threshold_sweep", _sweep_sql(V.DAMAGE_GRID, "damage_threshold", "damage_pred > g.v"))
def q_damage_sweep(spark, sf_dir):
    """1000 predicted-damage thresholds in [0.1, 20]."""
    return finish(V.damage_threshold_sweep(_ev(spark, sf_dir)))


@register("expected_gain", ev_sql(
    """SELECT CAST(SUM(c) AS BIGINT) AS n_controls, ROUND(SUM(gc), 4) AS sum_gain_control, ROUND(SUM(gn), 4) AS sum_gain_no_control,
              ROUND(SUM(CASE WHEN c = 1 AND y = 1 THEN 5.0 WHEN c = 1 AND y = 0 THEN -10.0 WHEN c = 0 AND y = 1 THEN -damage ELSE 0.0 END), 4) AS total_gain
       FROM (SELECT *, CAST(gc > gn AS INTEGER) AS c FROM
             (SELECT y, damage, p * 5.0 - (1.0 - p) * 10.0 AS gc, -p * damage_pred AS gn FROM ev))"""))
def q_expected_gain(spark, sf_dir):
    """V9: expected gain with / without control and realised value."""
    return finish(V.expected_gain(_ev(spark, sf_dir)))


@register("estimated_value", ev_sql(
    "SELECT ROUND(SUM(greatest(p * 5.0 - (1.0 - p) * 10.0, -(1.0 - p) * damage_pred) * CAST(p > 0.35 AS DOUBLE)), 4) AS estimated_value, "
    "COUNT(*) AS n FROM ev"))
def q_estimated_value(spark, sf_dir):
    """Self-estimated value, complement form, p > 0.35 mask."""
    return finish(V.estimated_value(_ev(spark, sf_dir)))


@register("estimated_value_probability_form", ev_sql(
    "SELECT ROUND(SUM(greatest(p * 5.0 - (1.0 - p) * 10.0, -p * damage_pred)), 4) AS estimated_value, COUNT(*) AS n FROM ev"))
def q_estimated_value_p(spark, sf_dir):
    """V12 (N15): probability form, no mask."""
    return finish(V.estimated_value(_ev(spark, sf_dir), threshold=None, form="probability"))


_MARGIN = "((p * 5.0 - (1.0 - p) * 10.0) - (-p * damage_pred))"


@register("margin_grid", ev_sql(
    f"""SELECT ROUND(pt, 4) AS p_thresh, ROUND(mt, 4) AS margin_thresh,
              COUNT(*) FILTER (WHERE ctl) AS controls, COUNT(*) FILTER (WHERE ctl AND y = 1) AS hits,
              COUNT(*) FILTER (WHERE ctl AND y = 0) AS false_alarms, COUNT(*) FILTER (WHERE NOT ctl AND y = 1) AS missed,
              ROUND(-5.0 * COUNT(*) FILTER (WHERE ctl AND y = 1) + 10.0 * COUNT(*) FILTER (WHERE ctl AND y = 0)
                    + COALESCE(SUM(damage) FILTER (WHERE NOT ctl AND y = 1), 0), 4) AS total_cost,
              ROUND(COALESCE(SUM(damage) FILTER (WHERE NOT ctl AND y = 1), 0), 4) AS missed_damage
       FROM (SELECT g1.v AS pt, g2.v AS mt, ev.*, (p >= g1.v AND {_MARGIN} >= g2.v) AS ctl FROM g1, g2, ev)
       GROUP BY pt, mt""",
    _grid_cte("g1", V.P_GRID) + ", " + _grid_cte("g2", V.MARGIN_GRID)))
def q_margin_grid(spark, sf_dir):
    """Probability × margin threshold grid."""
    return finish(V.margin_grid(_ev(spark, sf_dir)))


@register("parameter_grid", ev_sql(
    """SELECT ROUND(g, 4) AS gain_tp, ROUND(c, 4) AS cost_fp, ROUND(MAX(v), 4) AS best_value FROM (
         SELECT g, c, pt, mt, g * COUNT(*) FILTER (WHERE ctl AND y = 1) - c * COUNT(*) FILTER (WHERE ctl AND y = 0)
                - COALESCE(SUM(damage) FILTER (WHERE NOT ctl AND y = 1), 0) AS v
         FROM (SELECT gg.v AS g, cc.v AS c, g1.v AS pt, g2.v AS mt, ev.*,
                      (p >= g1.v AND ((p * gg.v - (1.0 - p) * cc.v) + p * damage_pred) >= g2.v) AS ctl
               FROM gg, cc, g1, g2, ev)
         GROUP BY g, c, pt, mt)
       GROUP BY g, c""",
    ", ".join([_grid_cte("gg", V.GAIN_GRID), _grid_cte("cc", V.COST_GRID), _grid_cte("g1", V.P_GRID), _grid_cte("g2", V.MARGIN_GRID)])))
def q_parameter_grid(spark, sf_dir):
    """Best value per (gain, cost) over the threshold grid."""
    return finish(V.parameter_grid(_ev(spark, sf_dir)))


_REG = """SELECT ROUND(mse, 4) AS mse, ROUND(sqrt(mse), 4) AS rmse, ROUND(mae, 4) AS mae, ROUND(1.0 - mse / NULLIF(v, 0), 4) AS r2
FROM (SELECT AVG((d_pred - damage) * (d_pred - damage)) AS mse, AVG(abs(d_pred - damage)) AS mae, VAR_POP(damage) AS v FROM ({src}))"""


@register("regression_metrics", ev_sql(_REG.format(src="SELECT damage, damage_pred AS d_pred FROM ev")))
def q_regression(spark, sf_dir):
    """MSE, RMSE, MAE, R² of the damage prediction."""
    return finish(V.regression_metrics(_ev(spark, sf_dir)))


@register("regression_on_flagged", ev_sql(_REG.format(src="SELECT damage, LEAST(GREATEST(damage_pred, 0.0), 25.0) AS d_pred FROM ev WHERE yhat = 1")))
def q_regression_flagged(spark, sf_dir):
    """V14 (+F22): regression metrics on flagged rows, clipped predictions."""
    return finish(V.metrics_on_flagged(_ev(spark, sf_dir)))


@register("calibration_curve", ev_sql(
    "SELECT CAST(LEAST(floor(p * 10), 9) AS INTEGER) AS bin, ROUND(AVG(p), 4) AS mean_predicted, "
    "ROUND(AVG(CAST(y AS DOUBLE)), 4) AS fraction_positive, COUNT(*) AS n FROM ev GROUP BY 1"))
def q_calibration(spark, sf_dir):
    """Calibration curve, 10 uniform bins."""
    return finish(V.calibration(_ev(spark, sf_dir)))


@register("brier_score", ev_sql("SELECT ROUND(AVG((p - y) * (p - y)), 4) AS brier FROM ev"))
def q_brier(spark, sf_dir):
    """Brier score."""
    return finish(V.brier(_ev(spark, sf_dir)))


@register("score_histogram", ev_sql(
    "SELECT CAST(LEAST(floor(p * 50), 49) AS INTEGER) AS bin, COUNT(*) FILTER (WHERE y = 0) AS n_normal, "
    "COUNT(*) FILTER (WHERE y = 1) AS n_fraud FROM ev GROUP BY 1"))
def q_score_hist(spark, sf_dir):
    """Probability histogram by class, 50 bins."""
    return V.score_hist(_ev(spark, sf_dir), 50)


@register("balanced_weights", ev_sql(
    "SELECT y, ROUND(CAST((SELECT COUNT(*) FROM ev) AS DOUBLE) / (2.0 * COUNT(*)), 4) AS weight, COUNT(*) AS n FROM ev GROUP BY y"))
def q_balanced_weights(spark, sf_dir):
    """M4: balanced class weights n / (2 n_class)."""
    w = V.balanced_weights(_ev(spark, sf_dir))
    return finish(w.groupBy("y", "weight").agg(F.count(F.lit(1)).alias("n")))


def _top_sql() -> str:
    cols = list(COEFFICIENTS)
    means = ", ".join(f"AVG(CAST({c} AS DOUBLE)) AS m_{c}" for c in cols)
    unions = " UNION ALL ".join(
        f"SELECT transaction_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
        f"{COEFFICIENTS[c]!r} * (CAST({c} AS DOUBLE) - (SELECT m_{c} FROM mm)) AS contribution FROM fm" for c in cols
    )
    return feature_sql(
        f"""SELECT transaction_id, feature, ROUND(value, 4) AS value, ROUND(contribution, 4) AS contribution, rank FROM (
              SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC NULLS LAST, feature) AS INTEGER) AS rank
              FROM long) WHERE rank <= 5""",
        f"mm AS (SELECT {means} FROM fm), long AS ({unions})",
    )


@register("top_contributions", _top_sql())
def q_top_contributions(spark, sf_dir):
    """M12 + W6: exact linear contributions, top 5 per basket."""
    long = V.linear_contributions(features(spark, sf_dir), COEFFICIENTS)
    return finish(V.top_features(long, 5))
