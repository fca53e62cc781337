"""Registered queries: sorting, sampling, splits, folds and fold-level evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.operators import audits as A
from tillsight.operators import evaluate as V
from tillsight.operators import rules
from tillsight.operators import sampling as O
from tillsight.plans.basket_sql import feature_sql
from tillsight.plans.common import features, tables
from tillsight.plans.q_evaluate import EVAL_CTES
from tillsight.plans.registry import basket_sql, finish, register

SEED = 42


def _h(col: str, seed: int = SEED) -> str:
    return f"md5(CAST({col} AS VARCHAR) || '{seed}')"


def _rank(part: str, key: str, seed: int = SEED) -> str:
    return f"ROW_NUMBER() OVER (PARTITION BY {part} ORDER BY {_h(key, seed)}, {key})"


@register("sorted_baskets", basket_sql(
    "SELECT id, store_id, total_amount FROM transactions ORDER BY store_id ASC, total_amount DESC, id ASC"))
def q_sorted(spark, sf_dir):
    """O1: multi-key sort (asc / desc), whole table."""
    t = tables(spark, sf_dir).transactions.select("id", "store_id", "total_amount")
    return O.sort(t, ["store_id", "total_amount", "id"], [True, False, True])


@register("top_damage", basket_sql(
    "SELECT id, damage FROM transactions WHERE damage IS NOT NULL ORDER BY damage DESC, id LIMIT 6"))
def q_top_damage(spark, sf_dir):
    """O2: the six largest damages (top-k is the feature)."""
    t = tables(spark, sf_dir).transactions.where(F.col("damage").isNotNull()).select("id", "damage")
    return O.top_k(t, "damage", 6, "id")


@register("sample_one_basket", basket_sql(
    f"SELECT id, label FROM transactions ORDER BY {_h('id')}, id LIMIT 1"))
def q_sample_one(spark, sf_dir):
    """One reproducible random basket."""
    return O.sample_one(tables(spark, sf_dir).transactions.select("id", "label"), "id", SEED)


@register("shuffled_baskets", basket_sql(
    f"SELECT id, {_h('id')} AS shuffle_pos FROM transactions"))
def q_shuffled(spark, sf_dir):
    """Reproducible permutation key of every basket."""
    return O.shuffled(tables(spark, sf_dir).transactions.select("id"), "id", SEED)


@register("balanced_sample", feature_sql(
    f"""SELECT dmg, COUNT(*) AS n, ROUND(SUM(damage), 4) AS damage FROM (
          SELECT *, {_rank('dmg', 'transaction_id')} AS rk FROM (SELECT transaction_id, damage, damage > 0 AS dmg FROM fm WHERE label <> 'UNKNOWN'))
        WHERE rk <= (SELECT MIN(c) FROM (SELECT COUNT(*) AS c FROM fm WHERE label <> 'UNKNOWN' GROUP BY damage > 0))
        GROUP BY dmg"""))
def q_balanced(spark, sf_dir):
    """Equal numbers of baskets with and without damage."""
    fm = features(spark, sf_dir, impute=False).where(F.col("label") != "UNKNOWN").select("transaction_id", "damage")
    b = O.balanced(fm, F.col("damage") > 0, "transaction_id", SEED)
    return finish(b.groupBy((F.col("damage") > 0).alias("dmg")).agg(F.count(F.lit(1)).alias("n"), F.sum("damage").alias("damage")))


@register("normals_plus_frauds", basket_sql(
    f"""SELECT label, COUNT(*) AS n FROM (
          SELECT id, label FROM (SELECT id, label, {_rank('label', 'id')} AS rk FROM transactions WHERE label = 'NORMAL') WHERE rk <= 1000
          UNION ALL SELECT id, label FROM transactions WHERE label = 'FRAUD')
        GROUP BY label"""))
def q_normals_plus_frauds(spark, sf_dir):
    """O6 (+U1): 1000 sampled normals united with all frauds."""
    t = tables(spark, sf_dir).transactions.select("id", "label")
    return O.normals_plus_frauds(t, 1000, "id", SEED).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("damage_only", basket_sql("SELECT id, damage FROM transactions WHERE damage > 0"))
def q_damage_only(spark, sf_dir):
    """Damage-only subset."""
    return finish(O.damage_only(tables(spark, sf_dir).transactions.select("id", "damage")))


_SPLIT_SQL = f"""SELECT id, label, CASE WHEN rk <= CAST(round(n * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, label, {_rank('label', 'id')} AS rk, COUNT(*) OVER (PARTITION BY label) AS n FROM transactions)"""


@register("stratified_split", basket_sql(_SPLIT_SQL))
def q_split(spark, sf_dir):
    """Exact stratified 80/20 split by hash order."""
    t = tables(spark, sf_dir).transactions.select("id", "label")
    return O.split(t, ["label"], "id", 0.2, SEED)


@register("split_store_shares", basket_sql(
    f"""SELECT a.store_id, a.n_train, ROUND(a.n_train / SUM(a.n_train) OVER (), 4) AS share_train,
               b.n_test, ROUND(b.n_test / SUM(b.n_test) OVER (), 4) AS share_test
        FROM (SELECT store_id, COUNT(*) AS n_train FROM t2 WHERE split = 'train' GROUP BY store_id) a
        JOIN (SELECT store_id, COUNT(*) AS n_test FROM t2 WHERE split = 'test' GROUP BY store_id) b USING (store_id)""",
    f"t2 AS (SELECT s.*, t.store_id FROM ({_SPLIT_SQL}) s JOIN transactions t USING (id))"))
def q_split_shares(spark, sf_dir):
    """J11 (+O8): store shares in train vs test."""
    t = tables(spark, sf_dir).transactions.select("id", "label", "store_id")
    s = O.split(t, ["label"], "id", 0.2, SEED)
    return finish(A.compare_shares(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), "store_id"))


def _folds_sql(k: int = 5, repeats: int = 2) -> str:
    parts = [
        f"SELECT transaction_id, {r} AS repeat, CAST(({_rank('label', 'transaction_id', SEED + r)} - 1) % {k} AS INTEGER) AS fold FROM ev0"
        for r in range(repeats)
    ]
    return "folds AS (" + " UNION ALL ".join(parts) + ")"


FOLD_CTES = EVAL_CTES + ", ev0 AS (SELECT transaction_id, label FROM fm WHERE label IN ('FRAUD', 'NORMAL')), " + _folds_sql()


@register("fold_sizes", feature_sql(
    "SELECT repeat, fold, e.y, COUNT(*) AS n FROM folds JOIN ev e USING (transaction_id) GROUP BY repeat, fold, e.y", FOLD_CTES))
def q_fold_sizes(spark, sf_dir):
    """Repeated stratified 5-fold assignment (2 repeats), class counts per fold."""
    fm = features(spark, sf_dir, impute=False)
    ev = V.eval_table(fm)
    f = O.folds(fm.where(F.col("label").isin("FRAUD", "NORMAL")), ["label"], "transaction_id", 5, 2, SEED)
    return ev.join(f, "transaction_id").groupBy("repeat", "fold", "y").agg(F.count(F.lit(1)).alias("n"))


MODELS = {"cost_rule": "yhat", "threshold_0_5": "CAST(p > 0.5 AS INTEGER)"}


def _per_fold_sql() -> str:
    parts = []
    for name, expr in MODELS.items():
        parts.append(
            f"""SELECT '{name}' AS model, repeat, fold,
                  COUNT(*) FILTER (WHERE y = 1 AND ({expr}) = 1) AS tp, COUNT(*) FILTER (WHERE y = 0 AND ({expr}) = 1) AS fp,
                  COUNT(*) FILTER (WHERE y = 1 AND ({expr}) = 0) AS fn, COUNT(*) FILTER (WHERE y = 0 AND ({expr}) = 0) AS tn,
                  COALESCE(SUM(damage), 0) AS damage_total,
                  COALESCE(SUM(damage) FILTER (WHERE y = 1 AND ({expr}) = 0), 0) AS damage_missed, COUNT(*) AS n_rows
                FROM ev JOIN folds USING (transaction_id) GROUP BY repeat, fold"""
        )
    return "pf AS (SELECT *, 5.0 * tp - 10.0 * fp - damage_missed AS business_value, " \
           "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS precision, COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0) AS recall FROM (" \
           + " UNION ALL ".join(parts) + "))"


def _per_fold(spark, sf_dir):
    fm = features(spark, sf_dir, impute=False)  # reads no imputed column
    ev = V.eval_table(fm)
    f = O.folds(fm.where(F.col("label").isin("FRAUD", "NORMAL")), ["label"], "transaction_id", 5, 2, SEED)
    models = {"cost_rule": F.col("_yhat0"), "threshold_0_5": (F.col("p") > 0.5).cast("int")}
    return V.fold_metrics(ev.withColumn("_yhat0", F.col("yhat")), f, models).drop("_yhat0"), ev, f, fm


@register("fold_metrics", feature_sql(
    "SELECT model, repeat, fold, tp, fp, fn, tn, ROUND(business_value, 4) AS business_value, ROUND(precision, 4) AS precision, "
    "ROUND(recall, 4) AS recall, n_rows FROM pf", FOLD_CTES + ", " + _per_fold_sql()))
def q_fold_metrics(spark, sf_dir):
    """O9 + V1-V6 per fold for two decision rules."""
    pf, *_ = _per_fold(spark, sf_dir)
    return finish(pf.select("model", "repeat", "fold", "tp", "fp", "fn", "tn", "business_value", "precision", "recall", "n_rows"))


@register("fold_summary", feature_sql(
    """SELECT model, metric, ROUND(AVG(v), 4) AS mean, ROUND(MAX(v), 4) AS max, ROUND(MIN(v), 4) AS min, ROUND(VAR_POP(v), 4) AS var,
              ROUND(sqrt(VAR_POP(v)), 4) AS std, ROUND(AVG(v) - MIN(v), 4) AS below, ROUND(MAX(v) - AVG(v), 4) AS above
       FROM (SELECT model, 'business_value' AS metric, business_value AS v FROM pf UNION ALL
             SELECT model, 'precision', precision FROM pf UNION ALL SELECT model, 'recall', recall FROM pf)
       GROUP BY model, metric""", FOLD_CTES + ", " + _per_fold_sql()))
def q_fold_summary(spark, sf_dir):
    """A34 + A35: mean / max / min / population variance and spread per metric over folds."""
    pf, *_ = _per_fold(spark, sf_dir)
    return finish(V.metric_spread(V.fold_summary(pf, ["model"], ["business_value", "precision", "recall"])))


@register("compare_folds", feature_sql(
    """SELECT b.repeat, b.fold, ROUND(b.business_value, 4) AS value_baseline, ROUND(c.business_value, 4) AS value_combined,
              ROUND(c.business_value - b.business_value, 4) AS gain,
              ROUND((c.business_value - b.business_value) * 100.0 / NULLIF(abs(b.business_value), 0), 4) AS improvement_pct
       FROM pf b JOIN pf c ON b.repeat = c.repeat AND b.fold = c.fold AND b.model = 'threshold_0_5' AND c.model = 'cost_rule'""",
    FOLD_CTES + ", " + _per_fold_sql()))
def q_compare_folds(spark, sf_dir):
    """Baseline vs combined decision per fold."""
    pf, *_ = _per_fold(spark, sf_dir)
    return finish(V.compare_folds(pf, "threshold_0_5", "cost_rule"))


@register("melted_fold_metrics", feature_sql(
    """SELECT model, repeat, fold, tag, metric, ROUND(v, 4) AS value FROM (
         SELECT model, repeat, fold, 'test' AS tag, 'business_value' AS metric, CAST(business_value AS DOUBLE) AS v FROM pf UNION ALL
         SELECT model, repeat, fold, 'test', 'precision', precision FROM pf UNION ALL
         SELECT model, repeat, fold, 'test', 'tp', CAST(tp AS DOUBLE) FROM pf)""", FOLD_CTES + ", " + _per_fold_sql()))
def q_melt(spark, sf_dir):
    """Fold metrics in long form with a tag."""
    pf, *_ = _per_fold(spark, sf_dir)
    return finish(V.melt_metrics(pf, ["model", "repeat", "fold"], ["business_value", "precision", "tp"], "test"))


@register("discount_recall", feature_sql(
    """SELECT repeat, fold, COUNT(*) AS n_cases, COUNT(*) FILTER (WHERE yhat = 1) AS n_detected,
              ROUND(COUNT(*) FILTER (WHERE yhat = 1) / COUNT(*), 4) AS share_detected, ROUND(COALESCE(SUM(damage), 0), 4) AS damage_cases,
              ROUND(COALESCE(SUM(damage) FILTER (WHERE yhat = 1), 0), 4) AS damage_detected
       FROM ev JOIN folds USING (transaction_id)
       WHERE y = 1 AND transaction_id IN (SELECT transaction_id FROM fm WHERE calculated_price_difference > 0)
       GROUP BY repeat, fold""", FOLD_CTES))
def q_discount_recall(spark, sf_dir):
    """Discount fraud cases detected per fold."""
    _, ev, f, fm = _per_fold(spark, sf_dir)
    disc = fm.where(F.col("calculated_price_difference") > 0).select("transaction_id")
    return finish(V.discount_recall(ev, f, disc))


@register("value_summary", feature_sql(
    """SELECT part, ROUND(damage, 4) AS damage, ROUND(value, 4) AS value, ROUND(added_value, 4) AS added_value,
              ROUND(n_transactions, 4) AS n_transactions, ROUND(added_value / NULLIF(n_transactions, 0), 4) AS added_value_per_transaction
       FROM (SELECT * FROM parts UNION ALL
             SELECT 'total', SUM(damage), SUM(value), SUM(added_value), SUM(n_transactions) FROM parts)""",
    FOLD_CTES + ", " + _per_fold_sql() + """,
    parts AS (
      SELECT 'model' AS part, -AVG(damage_total) AS damage, AVG(business_value) AS value, AVG(business_value) + AVG(damage_total) AS added_value,
             CAST(AVG(n_rows) AS DOUBLE) AS n_transactions FROM pf WHERE model = 'cost_rule'
      UNION ALL
      SELECT 'static_rules', -COALESCE(SUM(damage), 0) * 0.2, COUNT(*) * 1.0, COUNT(*) * 1.0 + COALESCE(SUM(damage), 0) * 0.2, COUNT(*) * 0.2
      FROM fm WHERE (has_missing OR has_unscanned) AND label <> 'UNKNOWN'
    )"""))
def q_value_summary(spark, sf_dir):
    """V19 (+R6): model plus 20 % of the static-rule catch, totals and value per transaction."""
    pf, _, _, fm = _per_fold(spark, sf_dir)
    r = rules.certain_frauds(fm).join(fm.where(F.col("label") != "UNKNOWN").select("transaction_id", "damage"), "transaction_id")
    return finish(V.value_summary(pf, "cost_rule", r, 0.2))
