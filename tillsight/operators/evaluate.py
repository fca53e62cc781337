"""Evaluation of fraud decisions.

Input is a table ``(transaction_id, y, damage, p, yhat[, damage_pred, fold])``.
All metrics are conditional aggregates in one pass.  Curves (ROC, AP) first
aggregate rows per distinct score, so the ordered window sees one row per
score value, never the raw table; sweeps use :mod:`tillsight.functions.sweep`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.quantiles import bucket_bounds, bucket_of
from tillsight.functions import scalar as S
from tillsight.functions.nulls import sum0
from tillsight.functions.sweep import prefix_count, suffix_totals
from tillsight.operators.rules import decide, fixed_linear_score

GAIN_TP = 5.0
COST_FP = 10.0
# Fixed grids of the reference's sweeps (built by rule, natural order).
THRESHOLDS_100 = [float(x) for x in np.linspace(0.1, 1.0, 100)]
THRESHOLDS_101 = [float(x) for x in np.linspace(0.0, 1.0, 101)]
THRESHOLDS_18 = [float(x) for x in np.arange(0.1, 1.0, 0.05)]
MALUS_GRID = [float(x) for x in np.arange(1, 200)]
P_GRID = [float(x) for x in np.arange(0.05, 1.00, 0.1)]
MARGIN_GRID = [float(x) for x in np.arange(0, 12, 2)]
GAIN_GRID = [float(x) for x in np.arange(3, 12, 2)]
COST_GRID = [float(x) for x in np.arange(2, 14, 2)]
DAMAGE_GRID = [float(x) for x in np.linspace(0.1, 20, 1000)]


# ---------------------------------------------------------------- input table
def eval_table(features: DataFrame, scored: DataFrame | None = None, cost_fp: float = COST_FP, gain_tp: float = GAIN_TP) -> DataFrame:
    """Labelled baskets with y, damage, p, damage_pred and the M5 decision."""
    s = fixed_linear_score(features) if scored is None else scored
    s = s.where(F.col("label").isin("FRAUD", "NORMAL"))
    return s.select(
        "transaction_id",
        S.is_fraud("label").alias("y"),
        F.coalesce(F.col("damage"), F.lit(0.0)).alias("damage"),
        "p",
        "damage_pred",
        decide("p", "damage_pred", cost_fp, gain_tp).cast("int").alias("yhat"),
    )


# ---------------------------------------------------------------- V1 / V2
def confusion_aggs(y: str = "y", yhat: str = "yhat") -> list[Column]:
    Y, H = F.col(y), F.col(yhat)
    return [
        F.count_if((Y == 1) & (H == 1)).alias("tp"),
        F.count_if((Y == 0) & (H == 1)).alias("fp"),
        F.count_if((Y == 1) & (H == 0)).alias("fn"),
        F.count_if((Y == 0) & (H == 0)).alias("tn"),
    ]


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V1: tp, fp, fn, tn (optionally per group, e.g. per fold)."""
    return df.groupBy(*by).agg(*confusion_aggs())


def with_class_metrics(cm: DataFrame) -> DataFrame:
    """V2 from V1 counts: precision (0 when nothing flagged), recall, f1, mcc, accuracy."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, F.when(den > 0, den)), F.lit(0.0))
    acc = F.try_divide(tp + tn, tp + fp + fn + tn)
    return cm.select("*", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), mcc.alias("mcc"), acc.alias("accuracy"))


def class_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_class_metrics(confusion(df, by))


# ---------------------------------------------------------------- V5 / V6
def value_aggs(gain_tp: float = GAIN_TP, cost_fp: float = COST_FP, y: str = "y", yhat: str = "yhat", damage: str = "damage") -> list[Column]:
    Y, H, D = F.col(y), F.col(yhat), F.col(damage)
    tp = F.count_if((Y == 1) & (H == 1))
    fp = F.count_if((Y == 0) & (H == 1))
    missed = sum0(F.when((Y == 1) & (H == 0), D))
    return [
        sum0(D).alias("damage_total"),
        sum0(F.when((Y == 1) & (H == 1), D)).alias("damage_prevented"),
        missed.alias("damage_missed"),
        (tp * F.lit(gain_tp)).alias("detected_bonus"),
        (fp * F.lit(cost_fp)).alias("fp_penalty"),
        (tp * F.lit(gain_tp) - fp * F.lit(cost_fp) - missed).alias("business_value"),
    ]


def business_value(df: DataFrame, by: Sequence[str] = (), gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """V5 + V6: damage total / prevented / missed, bonus, penalty, value."""
    return df.groupBy(*by).agg(*value_aggs(gain_tp, cost_fp))


def evaluate(df: DataFrame, by: Sequence[str] = (), gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """V1 + V2 + V5 + V6 in one aggregate (the reference's per-fold metric dict)."""
    return with_class_metrics(df.groupBy(*by).agg(*confusion_aggs(), *value_aggs(gain_tp, cost_fp)))


# ---------------------------------------------------------------- W7 / V3 / V4
def score_counts(df: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """Rows per distinct score: positives, negatives (ties grouped before accumulating)."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def cumulative_by_score(df: DataFrame, score: str = "p", y: str = "y", buckets: int = 1024) -> DataFrame:
    """Cumulative TP/FP for 'flag when score >= s', one row per distinct score.

    No single ordered window over all scores: distinct scores are spread over
    buckets cut at approximate quantiles of the distinct scores (any monotone
    bucketing keeps the running sums exact), bucket totals give running offsets and class
    totals (windows over ≤ ``buckets`` rows, broadcast back), and the running
    sum inside each bucket is a window partitioned by bucket.
    """
    sc = score_counts(df, score, y)
    sc = sc.withColumn("_bounds", sc.agg(bucket_bounds("score", buckets)).scalar())
    sc = sc.withColumn("_b", bucket_of(F.col("score"), F.col("_bounds"), buckets)).drop("_bounds")
    tot = sc.groupBy("_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    before = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    off = tot.select(
        "_b",
        F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_op"), F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on"),
        F.sum("_bp").over(every).alias("n_pos"), F.sum("_bn").over(every).alias("n_neg"),
    )
    w = Window.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    j = sc.join(F.broadcast(off), "_b")  # ≤ buckets rows
    return j.select(
        "score", "pos", "neg",
        (F.col("_op") + F.sum("pos").over(w)).alias("tp"),
        (F.col("_on") + F.sum("neg").over(w)).alias("fp"),
        "n_pos", "n_neg",
    )


def average_precision(df: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """V3: Σ (R_k - R_{k-1}) · P_k over distinct scores = Σ pos_k · P_k / n_pos (no lag needed)."""
    c = cumulative_by_score(df, score, y)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.agg((F.sum(F.col("pos") * prec) / F.first("n_pos")).alias("average_precision"))


def average_precision_by(df: DataFrame, keys: Sequence[str], score: str = "p", y: str = "y", buckets: int = 256) -> DataFrame:
    """V3 of each group (fold, model): running counts from bucket offsets per group, no window over a whole group.

    Scores are shares, so buckets are equal parts of [0, 1]; groups without a positive have a null.
    """
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    counts = counts.withColumn("_b", F.floor(F.col("score") * buckets))
    totals = counts.groupBy(*keys, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))  # groups × buckets rows
    before = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_op"), F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tp, fp = F.col("_op") + F.sum("pos").over(inside), F.col("_on") + F.sum("neg").over(inside)
    part = counts.join(offsets, [*keys, "_b"]).select(*keys, "pos", (F.col("pos") * tp / (tp + fp)).alias("_part"))
    return part.groupBy(*keys).agg(F.try_divide(F.sum("_part"), F.sum("pos")).alias("average_precision"))


def roc(df: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """V4: ROC points (threshold, fpr, tpr) per distinct score, plus the origin."""
    c = cumulative_by_score(df, score, y)
    pts = c.select(
        F.col("score").alias("threshold"),
        (F.col("fp") / F.col("n_neg")).alias("fpr"),
        (F.col("tp") / F.col("n_pos")).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def auc(df: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """V4: trapezoid area under the ROC points.

    Each distinct score adds neg_k/n_neg × (tpr_k + tpr_{k-1})/2 =
    neg_k · (2·TP_k − pos_k) / (2·n_pos·n_neg): no ordered window needed.
    """
    c = cumulative_by_score(df, score, y)
    term = F.col("neg") * (F.lit(2.0) * F.col("tp") - F.col("pos"))
    return c.agg((F.sum(term) / (F.lit(2.0) * F.first("n_pos") * F.first("n_neg"))).alias("auc"))


# ---------------------------------------------------------------- V7 / V8 / V15
def _sweep(df: DataFrame, grid: Sequence[float], positive_at, gain_tp: float, cost_fp: float, name: str,
           crossing: Column | None = None) -> DataFrame:
    n = len(grid)
    k = prefix_count(grid, positive_at, crossing)
    b = df.groupBy(k.alias("k")).agg(
        F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("neg"),
        sum0(F.when(F.col("y") == 1, F.col("damage"))).alias("dmg"),
    )
    t = suffix_totals(b, n, "k", ["pos", "neg", "dmg"])
    grid_values = F.element_at(F.array(*[F.lit(float(g)) for g in grid]), F.col("k") + 1)
    return t.select(
        F.col("k").alias("idx"),
        grid_values.alias(name),
        F.col("above_pos").cast("bigint").alias("tp"),
        F.col("above_neg").cast("bigint").alias("fp"),
        (F.col("above_pos") * F.lit(gain_tp) - F.col("above_neg") * F.lit(cost_fp) - F.col("upto_dmg")).alias("business_value"),
        F.col("upto_dmg").alias("damage_missed"),
    )


def threshold_sweep(df: DataFrame, grid: Sequence[float] = THRESHOLDS_100, gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """V7: business value of 'flag when p > t' for every t of the grid."""
    return _sweep(df, grid, lambda t: F.col("p") > t, gain_tp, cost_fp, "threshold", F.col("p"))


def gated_sweep(df: DataFrame, grid: Sequence[float] = THRESHOLDS_18, gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """V7: value of 'control when p >= t and the expected gain of it is the larger' for every t of the grid, and how many are controlled."""
    p = F.col("p")
    worth = p * F.lit(gain_tp) - (F.lit(1.0) - p) * F.lit(cost_fp) > -p * F.col("damage_pred")
    out = _sweep(df, grid, lambda t: (p >= t) & worth, gain_tp, cost_fp, "threshold")
    return out.withColumn("n_controls", F.col("tp") + F.col("fp"))


def malus_sweep(df: DataFrame, grid: Sequence[float] = MALUS_GRID, gain_tp: float = GAIN_TP) -> DataFrame:
    """V8: value of the cost rule p > m / (gain + m + damage_pred) for every malus m (FP cost stays 10)."""
    rule = lambda m: F.col("p") > m / (F.lit(gain_tp) + m + F.col("damage_pred"))
    p, d = F.col("p"), F.col("damage_pred")
    # break-even malus: p·(gain + m + d) > m  <=>  m < p·(gain + d) / (1 - p)
    crossing = F.when(p >= 1, F.lit(float("inf"))).otherwise(p * (F.lit(gain_tp) + d) / (F.lit(1.0) - p))
    return _sweep(df, grid, rule, gain_tp, COST_FP, "malus", crossing)


def damage_threshold_sweep(df: DataFrame, grid: Sequence[float] = DAMAGE_GRID, gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """Value of 'flag when damage_pred > t'."""
    return _sweep(df, grid, lambda t: F.col("damage_pred") > t, gain_tp, cost_fp, "damage_threshold", F.col("damage_pred"))


def best(sweep: DataFrame, value: str = "business_value", key: str = "idx") -> DataFrame:
    """O3: arg-max row of a sweep; the first (lowest index) maximum wins."""
    return sweep.orderBy(F.desc(value), F.asc(key)).limit(1)


# ---------------------------------------------------------------- V9 / V12
def expected_gain(df: DataFrame, gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """V9: expected gain with / without control, decision, realised value."""
    p = F.col("p")
    ctrl = p * F.lit(gain_tp) - (F.lit(1.0) - p) * F.lit(cost_fp)
    no_ctrl = -p * F.col("damage_pred")
    d = df.withColumn("gain_control", ctrl).withColumn("gain_no_control", no_ctrl).withColumn(
        "control", (F.col("gain_control") > F.col("gain_no_control")).cast("int")
    )
    Y, C = F.col("y"), F.col("control")
    realised = F.when((C == 1) & (Y == 1), F.lit(gain_tp)).when((C == 1) & (Y == 0), F.lit(-cost_fp)).when(
        (C == 0) & (Y == 1), -F.col("damage")
    ).otherwise(F.lit(0.0))
    return d.agg(
        F.sum("control").alias("n_controls"),
        F.sum("gain_control").alias("sum_gain_control"),
        F.sum("gain_no_control").alias("sum_gain_no_control"),
        F.sum(realised).alias("total_gain"),
    )


def estimated_value(df: DataFrame, threshold: float | None = 0.35, form: str = "complement", damage: str = "damage_pred",
                    gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """Σ max(control, no control) with optional p > threshold mask.

    ``form='complement'`` uses -(1-p)·damage for 'no control' (estimate
    notebook), ``form='probability'`` uses -p·damage (decision notebook).
    """
    p = F.col("p")
    ctrl = p * F.lit(gain_tp) - (F.lit(1.0) - p) * F.lit(cost_fp)
    no_ctrl = -(F.lit(1.0) - p) * F.col(damage) if form == "complement" else -p * F.col(damage)
    v = F.greatest(ctrl, no_ctrl)
    if threshold is not None:
        v = v * (p > F.lit(threshold)).cast("double")
    return df.agg(F.sum(v).alias("estimated_value"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- V10 / V11
def _grid2_buckets(df: DataFrame, p_grid, m_grid, margin: Column, extra_keys: Sequence[Column] = ()) -> DataFrame:
    k1 = F.col("_k1") if "_k1" in df.columns else prefix_count(p_grid, lambda t: t <= F.col("p"), F.col("p"), inclusive=True)
    k2 = prefix_count(m_grid, lambda t: t <= margin, margin, inclusive=True)
    return df.groupBy(*extra_keys, k1.alias("k1"), k2.alias("k2")).agg(
        F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("neg"),
        sum0(F.when(F.col("y") == 1, F.col("damage"))).alias("dmg"),
    )


def _grid2_cells(buckets: DataFrame, n1: int, n2: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per cell (i, j): totals over rows with k1 > i and k2 > j (2-D suffix sums on the bucket table).

    The cell lattice is generated (``explode(sequence)``), (n1 + 1)·(n2 + 1)
    rows per key, and joined to the bucket totals on equality only.
    """
    out_keys = list(keys)
    keys = out_keys or ["_k"]
    if not out_keys:  # a constant key: all steps stay equi-joins over tiny frames
        buckets = buckets.withColumn("_k", F.lit(0))
    lattice = [F.explode(F.sequence(F.lit(0), F.lit(n1))).alias("k1")]
    base = buckets.select(*keys).distinct().select(*keys, *lattice)
    cells = base.select(*keys, "k1", F.explode(F.sequence(F.lit(0), F.lit(n2))).alias("k2"))
    full = cells.join(buckets, [*keys, "k1", "k2"], "left").fillna(0, subset=["pos", "neg", "dmg"])
    w1 = Window.partitionBy(*keys, "k2").orderBy(F.desc("k1")).rowsBetween(Window.unboundedPreceding, 0)
    full = full.select(*keys, "k1", "k2", *[F.sum(c).over(w1).alias(c) for c in ("pos", "neg", "dmg")])
    w2 = Window.partitionBy(*keys, "k1").orderBy(F.desc("k2")).rowsBetween(Window.unboundedPreceding, 0)
    full = full.select(*keys, "k1", "k2", *[F.sum(c).over(w2).alias(f"s_{c}") for c in ("pos", "neg", "dmg")])
    # totals = the suffix sums at cell (0, 0); a window over the lattice (≤ (n1+1)(n2+1) rows per key)
    origin = (F.col("k1") == 0) & (F.col("k2") == 0)
    lattice_key = Window.partitionBy(*keys)
    full = full.select("*", F.max(F.when(origin, F.col("s_pos"))).over(lattice_key).alias("n_pos"),
                       F.max(F.when(origin, F.col("s_dmg"))).over(lattice_key).alias("d_all"))
    # cell (i, j) is controlled by rows with k1 >= i + 1 and k2 >= j + 1
    out = full.select(*keys, (F.col("k1") - 1).alias("i"), (F.col("k2") - 1).alias("j"), "s_pos", "s_neg", "s_dmg", "n_pos", "d_all").where(
        (F.col("i") >= 0) & (F.col("j") >= 0)
    )
    return out if out_keys else out.drop("_k")


def margin_grid(df: DataFrame, p_grid: Sequence[float] = P_GRID, m_grid: Sequence[float] = MARGIN_GRID,
                gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """Control when p >= p_thresh and margin >= margin_thresh; counts and cost per cell."""
    p = F.col("p")
    margin = (p * F.lit(gain_tp) - (F.lit(1.0) - p) * F.lit(cost_fp)) - (-p * F.col("damage_pred"))
    b = _grid2_buckets(df, p_grid, m_grid, margin)
    cells = _grid2_cells(b, len(p_grid), len(m_grid))
    pa = F.array(*[F.lit(v) for v in p_grid])
    ma = F.array(*[F.lit(v) for v in m_grid])
    missed_dmg = F.col("d_all") - F.col("s_dmg")
    return cells.select(
        F.element_at(pa, F.col("i") + 1).alias("p_thresh"),
        F.element_at(ma, F.col("j") + 1).alias("margin_thresh"),
        (F.col("s_pos") + F.col("s_neg")).cast("bigint").alias("controls"),
        F.col("s_pos").cast("bigint").alias("hits"),
        F.col("s_neg").cast("bigint").alias("false_alarms"),
        (F.col("n_pos") - F.col("s_pos")).cast("bigint").alias("missed"),
        (-F.lit(gain_tp) * F.col("s_pos") + F.lit(cost_fp) * F.col("s_neg") + missed_dmg).alias("total_cost"),
        missed_dmg.alias("missed_damage"),
    )


def parameter_grid(df: DataFrame, gains: Sequence[float] = GAIN_GRID, costs: Sequence[float] = COST_GRID,
                   p_grid: Sequence[float] = P_GRID, m_grid: Sequence[float] = MARGIN_GRID) -> DataFrame:
    """Per (gain, cost) the best realised value over the V10 threshold grid.

    Each row carries one margin per (gain, cost) pair; the pairs are a fixed
    parameter list (30 by default), exploded right before the partial aggregate.
    """
    pairs = [(g, c) for g in gains for c in costs]
    p = F.col("p")
    gc = F.explode(F.array(*[F.struct(F.lit(g).alias("gain_tp"), F.lit(c).alias("cost_fp")) for g, c in pairs])).alias("gc")
    # the probability bucket does not depend on (gain, cost): computed once, before the explode
    k1 = prefix_count(p_grid, lambda t: t <= F.col("p"), F.col("p"), inclusive=True)
    x = df.select("y", "damage", "p", "damage_pred", k1.alias("_k1"), gc).select("*", "gc.gain_tp", "gc.cost_fp").drop("gc")
    margin = (p * F.col("gain_tp") - (F.lit(1.0) - p) * F.col("cost_fp")) + p * F.col("damage_pred")
    b = _grid2_buckets(x, p_grid, m_grid, margin, [F.col("gain_tp"), F.col("cost_fp")])
    cells = _grid2_cells(b, len(p_grid), len(m_grid), ["gain_tp", "cost_fp"])
    value = F.col("gain_tp") * F.col("s_pos") - F.col("cost_fp") * F.col("s_neg") - (F.col("d_all") - F.col("s_dmg"))
    return cells.groupBy("gain_tp", "cost_fp").agg(F.max(value).alias("best_value"))


# ---------------------------------------------------------------- V13 / V14
def regression_metrics(df: DataFrame, target: str = "damage", pred: str = "damage_pred") -> DataFrame:
    """MSE, RMSE, MAE, R² (population variance of the target)."""
    err = F.col(pred) - F.col(target)
    a = df.agg(
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(target).alias("_var"),
    )
    return a.select("mse", F.sqrt("mse").alias("rmse"), "mae", (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_var"))).alias("r2"))


def metrics_on_flagged(df: DataFrame, lo: float = 0.0, hi: float = 25.0) -> DataFrame:
    """Regression metrics on rows flagged as fraud, predictions clipped to [lo, hi]."""
    f = df.where(F.col("yhat") == 1).withColumn("damage_pred", S.clip("damage_pred", lo, hi))
    return regression_metrics(f)


# ---------------------------------------------------------------- V16
def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Uniform bins floor(p·bins) (last closed): mean predicted, observed rate; empty bins omitted."""
    b = F.least(F.floor(F.col("p") * F.lit(bins)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(
        F.avg("p").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("fraction_positive"), F.count(F.lit(1)).alias("n"),
    )


def brier(df: DataFrame) -> DataFrame:
    d = F.col("p") - F.col("y").cast("double")
    return df.agg(F.avg(d * d).alias("brier"))


# ---------------------------------------------------------------- M4
def balanced_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """M4: weight n / (2 · n_class) per row (one aggregate of two rows, broadcast back)."""
    cnt = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n_class"))
    cnt = cnt.withColumn("_n", F.sum("_n_class").over(Window.partitionBy()))  # two rows
    return df.join(F.broadcast(cnt), y, "left").withColumn(
        "weight", F.col("_n").cast("double") / (F.lit(2.0) * F.col("_n_class"))
    ).drop("_n_class", "_n")


def damage_weights(df: DataFrame, factor: float = 5.0) -> Column:
    """M4: weight 5 for damage > 0, else 1."""
    return F.when(F.col("damage") > 0, F.lit(factor)).otherwise(F.lit(1.0))


# ---------------------------------------------------------------- M12 / W6
def linear_contributions(features: DataFrame, coefficients: dict[str, float], key: str = "transaction_id") -> DataFrame:
    """Exact per-feature contribution coef·(x - mean) of a linear model, long form.

    Means are one aggregate (a scalar per feature); unpivot keeps (key,
    feature, value) narrow; no join of rows with rows.
    """
    cols = list(coefficients)
    means = features.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).unpivot([], cols, "feature", "mean")
    coefs = features.sparkSession.createDataFrame([(c, float(coefficients[c])) for c in cols], "feature string, coef double")
    params = means.join(coefs, "feature", "inner")  # one row per feature
    x = features.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    long = x.unpivot([key], cols, "feature", "value")
    return long.join(F.broadcast(params), "feature", "inner").select(
        key, "feature", "value", (F.col("coef") * (F.col("value") - F.col("mean"))).alias("contribution"),
    )


def top_features(long: DataFrame, k: int = 5, key: str = "transaction_id") -> DataFrame:
    """The k largest |contribution| per row, ties by feature name."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), F.asc("feature"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- A34 / A35
def fold_summary(per_fold: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, max, min and population variance per metric over folds (long form)."""
    long = per_fold.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics
    ])).alias("m")).select(*keys, "m.metric", "m.v")
    return long.groupBy(*keys, "metric").agg(
        F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"), F.var_pop("v").alias("var"),
    )


def metric_spread(summary: DataFrame) -> DataFrame:
    """Mean, std = sqrt(var), mean - min, max - mean."""
    return summary.select(
        "*", F.sqrt("var").alias("std"), (F.col("mean") - F.col("min")).alias("below"), (F.col("max") - F.col("mean")).alias("above"),
    )


# ---------------------------------------------------------------- A17
def score_hist(df: DataFrame, bins: int = 50) -> DataFrame:
    b = F.least(F.floor(F.col("p") * F.lit(bins)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count_if(F.col("y") == 0).alias("n_normal"), F.count_if(F.col("y") == 1).alias("n_fraud"))


# ---------------------------------------------------------------- folds: V17 / V18 / V19 / A22
def fold_metrics(ev: DataFrame, fold_assign: DataFrame, models: dict[str, Column], key: str = "transaction_id",
                 gain_tp: float = GAIN_TP, cost_fp: float = COST_FP) -> DataFrame:
    """Per (model, repeat, fold): V1 + V2 + V5 + V6 on the fold's rows.

    ``models`` maps a name to a decision column (a fixed, small list); each row
    is evaluated under every decision in the same pass.
    """
    j = ev.drop("yhat").join(fold_assign, key, "inner")
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), e.cast("int").alias("yhat")) for n, e in models.items()]))
    x = j.select("*", m.alias("_m")).select("*", "_m.model", "_m.yhat").drop("_m")
    out = evaluate(x, ["model", "repeat", "fold"], gain_tp, cost_fp)
    return out.join(j.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n_rows")), ["repeat", "fold"], "inner")


def compare_folds(per_fold: DataFrame, baseline: str, combined: str) -> DataFrame:
    """Value of two models per fold, gain and % improvement."""
    w = per_fold.groupBy("repeat", "fold").pivot("model", [baseline, combined]).agg(F.first("business_value"))
    return w.select(
        "repeat", "fold",
        F.col(baseline).alias("value_baseline"), F.col(combined).alias("value_combined"),
        (F.col(combined) - F.col(baseline)).alias("gain"),
        F.try_divide((F.col(combined) - F.col(baseline)) * F.lit(100.0), F.abs(F.col(baseline))).alias("improvement_pct"),
    )


def discount_recall(ev: DataFrame, fold_assign: DataFrame, discount: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Per fold, fraud cases with a discount, how many the decision catches, and their damage."""
    d = discount.select(key, F.lit(True).alias("_disc"))
    j = ev.join(fold_assign, key, "inner").join(d, key, "inner").where(F.col("y") == 1)
    return j.groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(F.col("yhat") == 1).alias("n_detected"),
        (F.count_if(F.col("yhat") == 1) / F.count(F.lit(1))).alias("share_detected"),
        sum0("damage").alias("damage_cases"),
        sum0(F.when(F.col("yhat") == 1, F.col("damage"))).alias("damage_detected"),
    )


def melt_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], tag: str) -> DataFrame:
    """Wide fold metrics to long form (keys, tag, metric, value)."""
    long = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")
    return long.withColumn("tag", F.lit(tag))


def value_summary(per_fold: DataFrame, model: str, rules: DataFrame, share: float = 0.2, gain_tp: float = GAIN_TP) -> DataFrame:
    """Model (mean over folds) + static rules (share of their catch) and the total, per transaction."""
    m = per_fold.where(F.col("model") == model).agg(
        F.avg("damage_total").alias("damage"), F.avg("business_value").alias("value"), F.avg("n_rows").alias("n_transactions"),
    ).select(F.lit("model").alias("part"), (-F.col("damage")).alias("damage"), "value",
             (F.col("value") + F.col("damage")).alias("added_value"), "n_transactions")
    r = rules.agg(sum0("damage").alias("d"), F.count(F.lit(1)).alias("n")).select(
        F.lit("static_rules").alias("part"),
        (-F.col("d") * F.lit(share)).alias("damage"),
        (F.col("n") * F.lit(gain_tp * share)).alias("value"),
        (F.col("n") * F.lit(gain_tp * share) + F.col("d") * F.lit(share)).alias("added_value"),
        (F.col("n") * F.lit(share)).alias("n_transactions"),
    )
    parts = m.unionByName(r)
    total = parts.agg(
        F.sum("damage").alias("damage"), F.sum("value").alias("value"), F.sum("added_value").alias("added_value"),
        F.sum("n_transactions").alias("n_transactions"),
    ).select(F.lit("total").alias("part"), "*")
    out = parts.unionByName(total)
    return out.withColumn("added_value_per_transaction", F.try_divide(F.col("added_value"), F.col("n_transactions")))
