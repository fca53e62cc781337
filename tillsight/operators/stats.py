"""Statistical profiling and tests.

Every statistic is one or two aggregation passes in Spark; only the p-value
of each (tiny) result row goes through :mod:`tillsight.functions.special`.

* χ² tests work on *long contingency counts* (key, a, b, n), so one pass
  screens many columns at once; the statistic uses N·Σ o²/(r·c) − N, which
  needs only the cells that occur.  For 2×2 tables (dof = 1) the Yates
  correction uses that all four |o − e| are equal: χ² = max(|D| − ½, 0)² ·
  N · Σ 1/r · Σ 1/c.
* Spearman ranks are average ranks computed without a global window: values
  are counted per distinct value, spread over value-range buckets, and a
  running count per bucket plus a bucket offset gives the exact rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.quantiles import bucket_bounds, bucket_of
from tillsight.functions import scalar as S
from tillsight.functions.special import chi2_p, t_p


# ---------------------------------------------------------------- χ² core
def chi2_from_counts(ct: DataFrame, keys: Sequence[str], a: str, b: str, n: str = "n", correction: bool = True) -> DataFrame:
    """χ² independence statistic per key from long counts (key.., a, b, n)."""
    keys = list(keys)
    per_key = Window.partitionBy(*keys)  # over the small row / column total tables only
    rows = ct.groupBy(*keys, a).agg(F.sum(n).alias("_r"))
    rows = rows.select("*", F.sum("_r").over(per_key).alias("_ntot"), F.count(F.lit(1)).over(per_key).alias("_nr"),
                       F.sum(F.lit(1.0) / F.col("_r")).over(per_key).alias("_A"))
    cols = ct.groupBy(*keys, b).agg(F.sum(n).alias("_c"))
    cols = cols.select("*", F.count(F.lit(1)).over(per_key).alias("_nc"), F.sum(F.lit(1.0) / F.col("_c")).over(per_key).alias("_B"))
    j = ct.join(rows, [*keys, a]).join(cols, [*keys, b])
    e = F.col("_r") * F.col("_c") / F.col("_ntot")
    stats = j.groupBy(*keys).agg(
        F.sum(F.col(n) * F.col(n) / (F.col("_r") * F.col("_c"))).alias("_S"),
        F.max(F.abs(F.col(n) - e)).alias("_D"),
        *[F.first(c).alias(c) for c in ("_ntot", "_nr", "_A", "_nc", "_B")],
    )
    N = F.col("_ntot").cast("double")
    dof = ((F.col("_nr") - 1) * (F.col("_nc") - 1)).cast("bigint")
    plain = N * F.col("_S") - N
    yates = F.pow(F.greatest(F.col("_D") - F.lit(0.5), F.lit(0.0)), 2) * N * F.col("_A") * F.col("_B")
    chi2 = F.when(dof == 1, yates).otherwise(plain) if correction else plain
    return stats.select(
        *keys,
        chi2.alias("chi2"),
        dof.alias("dof"),
        F.col("_ntot").cast("bigint").alias("n"),
        F.col("_nr").cast("bigint").alias("n_rows"),
        F.col("_nc").cast("bigint").alias("n_cols"),
    )


def with_p(df: DataFrame, stat: str = "chi2", dof: str = "dof") -> DataFrame:
    return df.withColumn("p_value", chi2_p(F.col(stat), F.col(dof)))


def chi2_test(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    """χ² test of independence (statistic, dof, p); skipped for tables smaller than 2×2."""
    ct = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    out = chi2_from_counts(ct, [], a, b, "n", correction)
    return with_p(out.where((F.col("n_rows") >= 2) & (F.col("n_cols") >= 2)))


def chi2_expected(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected count of every occurring cell."""
    ct = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    r = ct.groupBy(a).agg(F.sum("observed").alias("_r"))
    c = ct.groupBy(b).agg(F.sum("observed").alias("_c"))
    total = ct.agg(F.sum("observed")).scalar()
    return ct.join(r, a).join(c, b).select(a, b, "observed", (F.col("_r") * F.col("_c") / total).alias("expected"))


def _long_values(df: DataFrame, cols: Sequence[str], extra: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(*extra, F.explode(arr).alias("_kv")).select(*extra, "_kv.feature", "_kv.value")


def chi2_screen(df: DataFrame, cols: Sequence[str], label: str = "label", correction: bool = True) -> DataFrame:
    """T2 (+F26): χ² of every categorical column against the label, one pass."""
    long = _long_values(df.where(F.col(label).isNotNull()), cols, [label]).where(F.col("value").isNotNull())
    ct = long.groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n"))
    out = chi2_from_counts(ct, ["feature"], "value", label, "n", correction)
    out = with_p(out.where((F.col("n_rows") >= 2) & (F.col("n_cols") >= 2)))
    return out.withColumn("significance", S.significance("p_value"))


# ---------------------------------------------------------------- T3
def chi2_feature_scores(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """χ² score of non-negative features (Σ feature per class vs class-share expectation)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nk"), *[F.sum(F.col(c).cast("double")).alias(c) for c in cols])
    long = per.unpivot([label, "_nk"], list(cols), "feature", "observed")
    w_f = Window.partitionBy("feature")
    long = long.select(
        "*", F.sum("observed").over(w_f).alias("_tot"), F.sum("_nk").over(w_f).alias("_n"), F.count(F.lit(1)).over(w_f).alias("_k"),
    )
    exp = F.col("_tot") * F.col("_nk") / F.col("_n")
    scored = long.groupBy("feature").agg(
        F.sum(F.pow(F.col("observed") - exp, 2) / exp).alias("chi2"), F.first("_k").alias("_k"),
    )
    return with_p(scored.withColumn("dof", F.col("_k") - 1).drop("_k"))


# ---------------------------------------------------------------- T4 / T5
def welch(df: DataFrame, cols: Sequence[str], group: str, g1: str, g2: str) -> DataFrame:
    """T4: Welch's unequal-variance t-test of every column between two groups."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.where(F.col(group).isin(g1, g2)).select(F.col(group).alias("_g"), F.explode(arr).alias("_kv")).select("_g", "_kv.*")
    agg = long.where(F.col("x").isNotNull()).groupBy("feature").agg(
        *[fn(F.when(F.col("_g") == g, F.col("x"))).alias(f"{name}_{i}")
          for i, g in ((1, g1), (2, g2))
          for name, fn in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))]
    )
    se1 = F.col("var_1") / F.col("n_1")
    se2 = F.col("var_2") / F.col("n_2")
    # neither group varies: no statistic
    t = F.try_divide(F.col("mean_1") - F.col("mean_2"), F.sqrt(se1 + se2))
    dof = F.try_divide(F.pow(se1 + se2, 2), F.pow(se1, 2) / (F.col("n_1") - 1) + F.pow(se2, 2) / (F.col("n_2") - 1))
    out = agg.where((F.col("n_1") > 1) & (F.col("n_2") > 1)).select(
        "feature", "mean_1", "mean_2", F.sqrt("var_1").alias("std_1"), F.sqrt("var_2").alias("std_2"),
        "n_1", "n_2", t.alias("t"), dof.alias("dof"),
    )
    return out.withColumn("p_value", t_p(F.col("t"), F.col("dof")))


def drift_report(a: DataFrame, b: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """T5: are two samples alike? numeric columns by Welch, categorical by χ²."""
    both = a.select(*num, *cat).withColumn("_side", F.lit("a")).unionByName(b.select(*num, *cat).withColumn("_side", F.lit("b")))
    w = welch(both, num, "_side", "a", "b").select(
        "feature", F.lit("welch").alias("test"), F.col("t").alias("statistic"), F.col("dof").cast("double").alias("dof"), "p_value"
    )
    c = chi2_screen(both, cat, "_side").select(
        "feature", F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), F.col("dof").cast("double").alias("dof"), "p_value"
    )
    return w.unionByName(c)


def columns_by_kind(df: DataFrame, leave: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric and boolean, text) columns of a table, but those to leave."""
    kinds = [(c, t) for c, t in df.dtypes if c not in leave]
    return [c for c, t in kinds if t != "string"], [c for c, t in kinds if t == "string"]


# ---------------------------------------------------------------- T6
def cramers_v(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-corrected Cramér's V for every pair of categorical columns (one pass)."""
    pairs = list(combinations(cols, 2))
    arr = F.array(*[
        F.struct(F.lit(x).alias("col1"), F.lit(y).alias("col2"), F.col(x).cast("string").alias("v1"), F.col(y).cast("string").alias("v2"))
        for x, y in pairs
    ])
    long = df.select(F.explode(arr).alias("_p")).select("_p.*").where(F.col("v1").isNotNull() & F.col("v2").isNotNull())
    ct = long.groupBy("col1", "col2", "v1", "v2").agg(F.count(F.lit(1)).alias("n"))
    chi = chi2_from_counts(ct, ["col1", "col2"], "v1", "v2", "n", True)
    # Bergsma (2013): under independence chi2 has the mean of its degrees of freedom (times n / (n - 1)), and a
    # dimension of d levels counts as if it had (d - 1)^2 / (n - 1) levels fewer
    freedom = {side: F.col(side).cast("double") - 1 for side in ("n_rows", "n_cols")}
    less_one = F.col("n").cast("double") - 1
    excess = F.col("chi2") / F.col("n") - freedom["n_rows"] * freedom["n_cols"] / less_one
    bound = F.least(*[d * (1 - d / less_one) for d in freedom.values()])
    strength = F.sqrt(F.when(excess > 0, excess).otherwise(0.0) / bound)
    return chi.where((F.col("n_rows") >= 2) & (F.col("n_cols") >= 2)).select("col1", "col2", strength.alias("cramers_v"))


# ---------------------------------------------------------------- T7 / T8 / T9 / T10
def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair on complete rows (one aggregate)."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    pairs = list(combinations(cols, 2))
    wide = d.agg(*[F.corr(x, y).alias(f"{i}") for i, (x, y) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(x).alias("col1"), F.lit(y).alias("col2"), F.col(f"{i}").alias("r")) for i, (x, y) in enumerate(pairs)])
    return wide.select(F.explode(arr).alias("_r")).select("_r.*")


#: Values that more than one in so many rows of a feature have are looked up by broadcast: at most so many a feature.
FREQUENT = 1_000


def average_ranks(long: DataFrame, feature: str = "feature", value: str = "value", buckets: int = 1024) -> DataFrame:
    """Exact average (tie-aware) ranks of ``value`` within each feature, no global window.

    Ranks are given to distinct values and brought back to the rows.  A value
    that more than one in ``FREQUENT`` rows of its feature have (the zeros of a
    count, say) would be a hot key there: such values, at most ``FREQUENT`` a
    feature, are broadcast, and only the others meet their rows by value.
    """
    counts = long.groupBy(feature, value).agg(F.count(F.lit(1)).alias("_cnt"))
    cuts = counts.groupBy(feature).agg(bucket_bounds(value, buckets).alias("_bounds"))  # one row per feature
    c = counts.join(F.broadcast(cuts), feature)
    c = c.withColumn("_b", bucket_of(F.col(value), F.col("_bounds"), buckets)).drop("_bounds")
    btot = c.groupBy(feature, "_b").agg(F.sum("_cnt").alias("_nb"))
    prior = Window.partitionBy(feature).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    boff = btot.select(feature, "_b", F.coalesce(F.sum("_nb").over(prior), F.lit(0)).alias("_off"))  # ≤ features × buckets rows
    c = c.join(F.broadcast(boff), [feature, "_b"])
    w = Window.partitionBy(feature, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = c.select(
        feature, value, "_cnt",
        (F.col("_off") + F.coalesce(F.sum("_cnt").over(w), F.lit(0)) + (F.col("_cnt") + 1) / F.lit(2.0)).alias("rank"),
    )
    sizes = btot.groupBy(feature).agg(F.sum("_nb").alias("_n"))  # a row per feature
    frequent = counts.join(F.broadcast(sizes), feature).where(F.col("_cnt") * FREQUENT > F.col("_n")).select(feature, value, F.lit(True).alias("_hot"))
    ranked = ranked.join(F.broadcast(frequent), [feature, value], "left")
    hot = ranked.where("_hot").select(feature, value, F.col("rank").alias("_hot_rank"))  # FREQUENT rows a feature at most
    marked = long.join(F.broadcast(hot), [feature, value], "left")
    met = marked.where("_hot_rank is null").drop("_hot_rank").join(ranked.where("_hot is null").select(feature, value, "rank"), [feature, value])
    return met.unionByName(marked.where("_hot_rank is not null").withColumnRenamed("_hot_rank", "rank"))


def spearman_matrix(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Spearman ρ (Pearson on average ranks) on complete rows, |ρ| and distance 1 - |ρ|."""
    d = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    long = d.unpivot([key], list(cols), "feature", "value")
    r = average_ranks(long)
    wide = r.groupBy(key).pivot("feature", list(cols)).agg(F.first("rank"))
    pm = pearson_matrix(wide, cols)
    return pm.select("col1", "col2", F.col("r").alias("rho"), F.abs("r").alias("abs_rho"), (F.lit(1.0) - F.abs("r")).alias("distance"))


def monotone_gap(df: DataFrame, features: Sequence[str], target: str, key: str) -> DataFrame:
    """Pearson vs Spearman of each feature against the target, sorted by |gap|.

    The columns are written once: the two matrices and the steps of the ranks
    read them several times.
    """
    from tillsight.session import cut_lineage

    cols = [*features, target]
    df = cut_lineage(df.select(key, *cols), "gap-columns")
    p = pearson_matrix(df, cols).where(F.col("col2") == target).select(F.col("col1").alias("feature"), F.col("r").alias("pearson"))
    s = spearman_matrix(df, cols, key).where(F.col("col2") == target).select(F.col("col1").alias("feature"), F.col("rho").alias("spearman"))
    j = p.join(s, "feature")
    return j.withColumn("diff", F.col("spearman") - F.col("pearson")).orderBy(F.desc(F.abs("diff")), "feature")


def point_biserial(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    """Point-biserial correlation = Pearson r of the 0/1 flag with x."""
    wide = df.agg(*[F.corr(F.col(flag).cast("double"), F.col(c).cast("double")).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "feature", "r")


# ---------------------------------------------------------------- T11
def outlier_counts(df: DataFrame, cols: Sequence[str], z: float = 3.0) -> DataFrame:
    """Per column, values with |x - mean| / std_pop > z."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.explode(arr).alias("_kv")).select("_kv.*").where(F.col("x").isNotNull())
    mom = long.groupBy("feature").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))  # one row per feature
    j = long.join(F.broadcast(mom), "feature")
    return j.groupBy("feature").agg(
        F.count_if(F.abs(F.col("x") - F.col("_m")) / F.col("_s") > F.lit(z)).alias("n_outliers")
    ).orderBy(F.desc("n_outliers"), "feature")


# ---------------------------------------------------------------- T12 / T13
def ols_screen(rows: DataFrame, cols: Sequence[str], y: str, split: str = "split") -> DataFrame:
    """Univariate OLS of ``y`` on every column: slope, intercept, R², r and slope t on the train rows, R² on the test rows.

    One pass: both splits' centred moments of every column are partial sums, and
    the residuals of the test rows follow from them.  Where a column or ``y``
    does not vary, what would divide by it is null.
    """
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    long = rows.select(split, F.col(y).cast("double").alias("y"), F.explode(arr).alias("_kv")).select(split, "y", "_kv.*").dropna()
    moments = long.groupBy("feature", split).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"),
    )
    train = moments.where(F.col(split) == "train").drop(split)
    test = moments.where(F.col(split) == "test").select("feature", *[F.col(c).alias(f"{c}_test") for c in ("n", "mx", "my", "sxx", "sxy", "syy")])
    fit = train.join(test, "feature", "left").withColumn("slope", F.try_divide("sxy", "sxx")).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    shift = F.col("my_test") - F.col("intercept") - F.col("slope") * F.col("mx_test")
    sse_test = F.col("syy_test") - 2 * F.col("slope") * F.col("sxy_test") + F.pow("slope", 2) * F.col("sxx_test") + F.col("n_test") * F.pow(shift, 2)
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    sse = F.greatest(F.col("syy") - F.pow("slope", 2) * F.col("sxx"), F.lit(0.0))
    t = F.try_divide(F.col("slope"), F.sqrt(F.try_divide(F.try_divide(sse, F.col("n") - 2), F.col("sxx"))))
    out = fit.select(
        "feature", "slope", "intercept", (r * r).alias("r2_train"), (F.lit(1.0) - F.try_divide(sse_test, F.col("syy_test"))).alias("r2_test"),
        r.alias("r"), "n", t.alias("t"),
    )
    return out.withColumn("p_value", F.when(F.col("t").isNotNull(), t_p(F.col("t"), (F.col("n") - 2).cast("double"))))


def residual_checks(df: DataFrame, resid: str, x: str) -> DataFrame:
    """Breusch-Pagan LM = n·R²(resid² ~ x); skewness, kurtosis and D'Agostino K² of the residuals."""
    d = df.select(F.col(resid).cast("double").alias("e"), F.col(x).cast("double").alias("x")).dropna()
    mean = d.agg(F.avg("e")).scalar()
    c = F.col("e") - mean
    m = d.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.regr_r2(F.col("e") * F.col("e"), F.col("x")).alias("_r2"),
        F.avg(c * c).alias("m2"), F.avg(c * c * c).alias("m3"), F.avg(c * c * c * c).alias("m4"),
    )
    n = F.col("n")
    g1 = F.col("m3") / F.pow(F.col("m2"), 1.5)
    b2 = F.col("m4") / F.pow(F.col("m2"), 2)
    # skewness z (D'Agostino)
    y = g1 * F.sqrt((n + 1) * (n + 3) / (F.lit(6.0) * (n - 2)))
    beta2 = F.lit(3.0) * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.lit(-1.0) + F.sqrt(F.lit(2.0) * (beta2 - 1))
    delta = F.lit(1.0) / F.sqrt(F.lit(0.5) * F.log(w2))
    alpha = F.sqrt(F.lit(2.0) / (w2 - 1))
    y1 = F.when(y == 0, F.lit(1.0)).otherwise(y)
    zs = delta * F.log(y1 / alpha + F.sqrt(F.pow(y1 / alpha, 2) + 1))
    # kurtosis z (Anscombe-Glynn)
    e_b2 = F.lit(3.0) * (n - 1) / (n + 1)
    var_b2 = F.lit(24.0) * n * (n - 2) * (n - 3) / (F.pow(n + 1, 2) * (n + 3) * (n + 5))
    xk = (b2 - e_b2) / F.sqrt(var_b2)
    sb1 = F.lit(6.0) * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(F.lit(6.0) * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = F.lit(6.0) + F.lit(8.0) / sb1 * (F.lit(2.0) / sb1 + F.sqrt(F.lit(1.0) + F.lit(4.0) / (sb1 * sb1)))
    t1 = F.lit(1.0) - F.lit(2.0) / (F.lit(9.0) * a)
    den = F.lit(1.0) + xk * F.sqrt(F.lit(2.0) / (a - 4))
    t2 = F.signum(den) * F.pow((F.lit(1.0) - F.lit(2.0) / a) / F.abs(den), F.lit(1.0 / 3.0))
    zk = (t1 - t2) / F.sqrt(F.lit(2.0) / (F.lit(9.0) * a))
    k2 = zs * zs + zk * zk
    return m.select(
        (n * F.col("_r2")).alias("bp_lm"), g1.alias("skewness"), (b2 - 3).alias("excess_kurtosis"),
        zs.alias("z_skew"), zk.alias("z_kurt"), k2.alias("k2"), F.exp(-k2 / 2).alias("k2_p_value"),
    ).withColumn("bp_p_value", chi2_p(F.col("bp_lm"), F.lit(1.0)))
