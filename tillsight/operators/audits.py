"""Data-quality audits and profiling.

Rules of thumb used throughout:
* global shares (W5) are computed on *aggregated* rows — a window over ()
  only ever sees one row per group, never the raw table;
* group totals mapped back to rows (W4) are aggregate + join, which AQE's
  skew-join handling can split, instead of a window partition that cannot;
* exact percentiles (``percentile``) buffer one counter per distinct value
  of the group; ``exact=False`` switches to ``percentile_approx`` for
  high-cardinality measures.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import scalar as S
from tillsight.functions.nulls import left_join_spread, sum0
from tillsight.functions.quantiles import exact_quantiles

LABELS = ["FRAUD", "NORMAL", "UNKNOWN"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- A2 / W5
def with_share(counts: DataFrame, count_col: str = "count", share_col: str = "proportion") -> DataFrame:
    """Share of the grand total, over already-aggregated rows."""
    return counts.withColumn(share_col, F.col(count_col) / F.sum(count_col).over(Window.partitionBy()))


def val_count(df: DataFrame, col: str) -> DataFrame:
    """A2: value counts (nulls are a value) with proportion."""
    return with_share(df.groupBy(col).agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- A3
def fraud_rate(df: DataFrame, col: str, label: str = "label") -> DataFrame:
    """A3: per value: total, fraud, normal, fraud / (fraud + normal)."""
    g = df.groupBy(col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == "FRAUD").alias("fraud"),
        F.count_if(F.col(label) == "NORMAL").alias("normal"),
    )
    return g.withColumn("fraud_rate", F.try_divide(F.col("fraud").cast("double"), (F.col("fraud") + F.col("normal")).cast("double")))


# ---------------------------------------------------------------- A13
def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, nulls, mean, sample std, min, quartiles, max per column (long form).

    One long (column, value) pass feeds both the moments and the quartiles;
    exact quartiles use :func:`exact_quantiles` (no single-task buffer).
    """
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.explode(arr).alias("_kv")).select("_kv.*")
    mom = long.groupBy("column").agg(
        F.count("x").alias("count"), F.count_if(F.col("x").isNull()).alias("null_count"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    if exact:
        q = exact_quantiles(long, "x", [0.25, 0.5, 0.75], by=["column"], names=["p25", "p50", "p75"])
    else:
        q = long.groupBy("column").agg(*[F.percentile_approx("x", F.lit(p), F.lit(10000)).alias(n) for p, n in
                                          ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return mom.join(q, "column", "left").select("column", "count", "null_count", "mean", "std", "min", "p25", "p50", "p75", "max")


# ---------------------------------------------------------------- A14
def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column, non-zero only, sorted by count desc then name."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "null_count")
    return long.where(F.col("null_count") > 0).orderBy(F.desc("null_count"), "column")


# ---------------------------------------------------------------- A15-A17
def fixed_width_hist(df: DataFrame, col: str, width: float) -> DataFrame:
    """Bins floor(x / w) * w with counts."""
    b = F.floor(F.col(col) / F.lit(width)) * F.lit(width)
    return df.where(F.col(col).isNotNull()).groupBy(b.cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def shared_edge_hist(df: DataFrame, col: str, by: str, bins: int = 19) -> DataFrame:
    """linspace(min, max, bins + 1) edges shared by all classes; last bin closed.

    Skips the column when its range is zero; classes without values yield no rows.
    The two columns are written once for the range and the counts.
    """
    from tillsight.session import cut_lineage

    x = F.col("_x")
    df = cut_lineage(df.select(by, F.col(col).cast("double").alias("_x")), "hist")
    rng = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()  # one scalar subquery
    lo, hi = rng["lo"], rng["hi"]
    idx = F.least(F.floor((x - lo) / (hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counted = df.where(x.isNotNull() & (hi > lo)).groupBy(F.col(by), idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(by, "bin", (lo + (hi - lo) * F.col("bin") / F.lit(bins)).alias("edge_left"), "count")


# ---------------------------------------------------------------- A18-A21
def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """A18 long form: (a, b, n)."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """A18 wide form; pivot values are given, so no extra distinct pass."""
    return df.groupBy(a).pivot(b, list(values)).count().fillna(0, subset=[str(v) for v in values])


def crosstab_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row-normalised contingency table (long form, rows sum to 1)."""
    ct = crosstab(df, a, b)
    return ct.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def class_counts(df: DataFrame, col: str, labels: Sequence[str] = ("FRAUD", "NORMAL"), order: Sequence | None = None) -> DataFrame:
    """Per category the count of each class, 0 for missing, optional custom order."""
    out = df.where(F.col("label").isin(list(labels))).groupBy(col).pivot("label", list(labels)).count().fillna(0, subset=list(labels))
    for lab in labels:
        out = out.withColumn(lab, F.col(lab).cast("bigint"))
    if order is not None:
        pos = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col)).cast("int")
        out = out.withColumn("order", pos).orderBy("order")
    return out


def flag_rate_by_label(df: DataFrame, flags: Sequence[str], labels: Sequence[str] = ("FRAUD", "NORMAL")) -> DataFrame:
    """Σ flag per label (wide), unpivot, pivot on label, fraud_rate."""
    sums = df.where(F.col("label").isin(list(labels))).groupBy("label").agg(
        *[F.sum(F.col(f).cast("bigint")).alias(f) for f in flags]
    )
    long = sums.unpivot(["label"], list(flags), "feature", "value")
    wide = long.groupBy("feature").pivot("label", list(labels)).agg(F.first("value"))
    return wide.withColumn(
        "fraud_rate", F.try_divide(F.col("FRAUD").cast("double"), (F.col("FRAUD") + F.col("NORMAL")).cast("double"))
    ).withColumn("category_de", S.recode("feature", S.CATEGORY_NAMES_DE))


# ---------------------------------------------------------------- A23
def camera_quality_by_month(lines: DataFrame) -> DataFrame:
    """Monthly mean of the camera 'similar' flag and of its certainty."""
    ts = F.col("timestamp")
    # certainty has two decimals: summing integer hundredths keeps the mean independent of summation order
    cents = F.round(F.col("camera_certainty") * 100).cast("bigint")
    return lines.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.avg(F.col("camera_product_similar").cast("double")).alias("mean_similar"),
        (F.sum(cents) / F.count(cents) / F.lit(100.0)).alias("mean_certainty"),
        F.count(F.lit(1)).alias("n_lines"),
    ).withColumn("month_start", S.month_start("year", "month"))


# ---------------------------------------------------------------- A24 / J4
def wide_join(tx: DataFrame, lines: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Lines ⟕ transactions ⟕ products ⟕ stores; clashing names get a table suffix."""
    l = lines.select(
        F.col("id").alias("id_line"), "transaction_id", "product_id", "timestamp", "pieces_or_weight",
        "sales_price", "was_voided", "camera_product_similar", "camera_certainty",
    )
    t = tx.select(*[F.col(c).alias(f"{c}_transaction" if c == "id" else c) for c in tx.columns])
    p = products.select(*[F.col(c).alias(f"{c}_product") for c in products.columns])
    s = stores.select(*[F.col(c).alias(f"{c}_store") for c in stores.columns])
    j = l.join(t, l["transaction_id"] == t["id_transaction"], "left")
    j = j.join(p, j["product_id"] == p["id_product"], "left")
    return j.join(F.broadcast(s), j["store_id"] == s["id_store"], "left")


def missing_products(tx: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines without a known product, per label: baskets affected and lines."""
    p = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_known"))
    miss = left_join_spread(lines, p, "product_id").where(F.col("_known").isNull())
    per_basket = miss.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_missing"))
    t = tx.select(F.col("id").alias("transaction_id"), "label")
    j = per_basket.join(t, "transaction_id", "inner")
    return j.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_baskets"),
        F.sum("n_missing").alias("n_lines"),
        F.max("n_missing").alias("max_per_basket"),
    )


# ---------------------------------------------------------------- A25
def empty_baskets(tx: DataFrame, lines: DataFrame) -> DataFrame:
    """Receipts without any line, by label and declared n_lines."""
    has = lines.select(F.col("transaction_id").alias("id")).distinct()
    empty = tx.join(has, "id", "left_anti")
    return empty.groupBy("label", "n_lines").agg(F.count(F.lit(1)).alias("n_baskets"))


# ---------------------------------------------------------------- A26 / W4
def with_group_total(df: DataFrame, key: str, value: str | Column, name: str) -> DataFrame:
    """Group total mapped back to each row (aggregate + join; AQE splits hot keys)."""
    tot = df.groupBy(key).agg(F.sum(_c(value)).alias(name))
    return df.join(tot, key, "left")


def reconcile(tx: DataFrame, lines: DataFrame, eps: float = 0.01) -> DataFrame:
    """Σ sales per basket vs total_amount; flag |diff| > eps."""
    s = lines.groupBy("transaction_id").agg(F.sum("sales_price").alias("sales_sum"))
    t = tx.select(F.col("id").alias("transaction_id"), "total_amount", "label", "damage")
    j = t.join(s, "transaction_id", "inner")
    return j.withColumn("diff", F.col("total_amount") - F.col("sales_sum")).withColumn("mismatch", S.far("total_amount", "sales_sum", eps))


# ---------------------------------------------------------------- A27
def explain_damage(tx: DataFrame, lines: DataFrame, products: DataFrame, eps: float = 0.01) -> DataFrame:
    """Baskets whose (total - Σ nominal price) ≈ -damage; counts and damage explained by label."""
    p = products.select(F.col("id").alias("product_id"), "price")
    nominal = lines.join(p, "product_id", "inner").groupBy("transaction_id").agg(
        F.sum(F.col("pieces_or_weight") * F.col("price")).alias("nominal_sum")
    )
    t = tx.select(F.col("id").alias("transaction_id"), "total_amount", "damage", "label")
    j = t.join(nominal, "transaction_id", "inner").withColumn("difference", F.col("total_amount") - F.col("nominal_sum"))
    hit = F.abs(F.col("difference") + F.col("damage")) < F.lit(eps)
    return j.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_baskets"),
        F.count_if(hit).alias("n_explained"),
        sum0(F.when(hit, F.col("damage"))).alias("damage_explained"),
        sum0("damage").alias("damage_total"),
    )


# ---------------------------------------------------------------- A28 / P17
def camera_inserted(lines: DataFrame) -> DataFrame:
    """Voided lines with price 0 (inserted by the camera)."""
    return lines.where(F.col("was_voided") & (F.col("sales_price") == 0))


def coverage(tx: DataFrame, rule_lines: DataFrame) -> DataFrame:
    """One row — lines and baskets hit by a line rule, share of frauds and of damage."""
    t = tx.select(F.col("id").alias("transaction_id"), "label", "damage")
    hits = rule_lines.join(t, "transaction_id", "inner")
    per_basket = hits.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("label").alias("label"), F.max("damage").alias("damage"),
        F.bool_and(~F.coalesce(F.col("camera_product_similar"), F.lit(False))).alias("all_not_similar"),
    )
    tot = tx.agg(F.struct(F.count_if(F.col("label") == "FRAUD").alias("n"), sum0("damage").alias("d"))).scalar()
    n_frauds, damage_total = tot["n"], tot["d"]
    rule = per_basket.agg(
        sum0("n").cast("bigint").alias("n_lines"),
        F.count(F.lit(1)).alias("n_baskets"),
        F.coalesce(F.bool_and(F.col("label") == "FRAUD"), F.lit(True)).alias("all_fraud"),
        F.coalesce(F.bool_and("all_not_similar"), F.lit(True)).alias("all_not_similar"),
        sum0("damage").alias("damage_rule"),
    )
    rule = rule.select("*", n_frauds.alias("n_frauds"), damage_total.alias("damage_total"))
    return rule.select(
        "n_lines", "n_baskets", "n_frauds", "all_fraud", "all_not_similar", "damage_rule", "damage_total",
        F.try_divide(F.col("n_baskets").cast("double"), F.col("n_frauds").cast("double")).alias("share_frauds"),
        F.try_divide(F.col("damage_rule"), F.col("damage_total")).alias("share_damage"),
    )


# ---------------------------------------------------------------- A29
def screen_price_diff(tx: DataFrame, lines: DataFrame, products: DataFrame, eps: float = 0.01, only_valid: bool = False) -> DataFrame:
    """Baskets with Σ(price·qty - sales) > eps, by label (optionally non-voided lines only)."""
    p = products.select(F.col("id").alias("product_id"), "price")
    l = lines.where(~F.col("was_voided")) if only_valid else lines
    d = l.join(p, "product_id", "inner").groupBy("transaction_id").agg(
        F.sum(S.price_difference("price", "pieces_or_weight", "sales_price")).alias("diff")
    ).where(F.col("diff") > F.lit(eps))
    t = tx.select(F.col("id").alias("transaction_id"), "label")
    return d.join(t, "transaction_id", "inner").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_baskets"), F.sum("diff").alias("diff_sum"),
    )


# ---------------------------------------------------------------- A30 / F18
def discount_lines(lines: DataFrame, products: DataFrame, ratio: float = 0.7, eps: float = 0.01) -> DataFrame:
    """lines whose paid/nominal ratio is within eps of ``ratio`` (30 % discount)."""
    p = products.select(F.col("id").alias("product_id"), "price")
    j = lines.join(p, "product_id", "inner").withColumn("price_ratio", S.price_ratio("sales_price", "price", "pieces_or_weight"))
    return j.where(S.near("price_ratio", F.lit(ratio), eps))


def discount_by_label(tx: DataFrame, lines: DataFrame, products: DataFrame, ratio: float = 0.7, eps: float = 0.01) -> DataFrame:
    """Baskets with a discounted line, by label, with the baskets' total damage."""
    ids = discount_lines(lines, products, ratio, eps).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_lines"))
    t = tx.select(F.col("id").alias("transaction_id"), "label", "damage")
    j = ids.join(t, "transaction_id", "inner")
    return j.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_baskets"), F.sum("n_lines").alias("n_lines"), sum0("damage").alias("damage"),
    )


# ---------------------------------------------------------------- A31
def damage_lost(tx: DataFrame, features: DataFrame) -> DataFrame:
    """Damage and row count in the raw table vs the feature table."""
    a = tx.agg(sum0("damage").alias("damage_raw"), F.count(F.lit(1)).alias("rows_raw"))
    fs = features.agg(F.struct(sum0("damage").alias("d"), F.count(F.lit(1)).alias("n"))).scalar()
    a = a.select("*", fs["d"].alias("damage_features"), fs["n"].alias("rows_features"))
    return a.withColumn("damage_lost", F.col("damage_raw") - F.col("damage_features"))


# ---------------------------------------------------------------- A32 / A33
def segment_report(features: DataFrame, wrong_discount_ids: DataFrame, exact: bool = True) -> DataFrame:
    """Unscanned / wrong discount / rest — baskets, frauds, share, damage sum/mean/median."""
    w = wrong_discount_ids.select("transaction_id", F.lit(True).alias("_wd"))
    j = features.where(F.col("label") != "UNKNOWN").join(w, "transaction_id", "left")
    seg = (
        F.when(F.col("has_unscanned"), F.lit("unscanned"))
        .when(F.col("_wd"), F.lit("wrong_discount"))
        .otherwise(F.lit("rest"))
    )
    j = j.withColumn("segment", seg)
    agg = j.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_baskets"),
        F.count_if(F.col("label") == "FRAUD").alias("n_fraud"),
        (F.count_if(F.col("label") == "FRAUD") / F.count(F.lit(1))).alias("fraud_share"),
        sum0("damage").alias("damage_sum"),
        F.avg("damage").alias("damage_mean"),
    )
    if exact:
        med = exact_quantiles(j, "damage", [0.5], by=["segment"], names=["damage_median"])
    else:
        med = j.groupBy("segment").agg(F.percentile_approx("damage", F.lit(0.5), F.lit(10000)).alias("damage_median"))
    return agg.join(med, "segment", "left")


def damage_percentile(tx: DataFrame, p: float = 0.99, exact: bool = True) -> DataFrame:
    """Percentile of the positive damages."""
    pos = tx.where(F.col("damage") > 0)
    if exact:
        q = exact_quantiles(pos, "damage", [p], names=["damage_p"])
    else:
        q = pos.agg(F.percentile_approx("damage", F.lit(p), F.lit(10000)).alias("damage_p"))
    return q.select("damage_p", pos.agg(F.count(F.lit(1))).scalar().alias("n_positive"))


# ---------------------------------------------------------------- J5 / J6 / J12 / J13 / J11
def join_loss(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Rows before and after an inner lines⋈products join, and the loss."""
    before = lines.agg(F.count(F.lit(1)).alias("rows_before"))
    after = lines.join(products.select(F.col("id").alias("product_id")), "product_id", "inner").agg(F.count(F.lit(1))).scalar()
    return before.select("rows_before", after.alias("rows_after")).withColumn("rows_lost", F.col("rows_before") - F.col("rows_after"))


def labeled_line_table(tx: DataFrame, lines: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Lines ⋈ labelled receipts, then ⟕ products and stores."""
    t = tx.where(F.col("label") != "UNKNOWN").select(F.col("id").alias("transaction_id"), "label", "damage", "store_id")
    p = products.select(F.col("id").alias("product_id"), "category", "price")
    s = stores.select(F.col("id").alias("store_id"), "location", "urbanization")
    return left_join_spread(lines.join(t, "transaction_id", "inner"), p, "product_id").join(F.broadcast(s), "store_id", "left")


def labeled_lines(tx: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Receipts ⟕ (lines ⟕ products); receipts without lines keep one null row."""
    p = products.select(F.col("id").alias("product_id"), "category", "price")
    lp = left_join_spread(lines, p, "product_id")
    t = tx.select(F.col("id").alias("transaction_id"), "label", "damage")
    return t.join(lp, "transaction_id", "left")


def with_damage(features: DataFrame, damages: DataFrame) -> DataFrame:
    """Attach damage by transaction id, 0 when absent."""
    d = damages.select("transaction_id", F.col("damage").alias("_damage"))
    return features.join(d, "transaction_id", "left").withColumn("damage_joined", F.coalesce(F.col("_damage"), F.lit(0.0))).drop("_damage")


def compare_shares(a: DataFrame, b: DataFrame, dim: str, names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Share of each dimension value in two frames, joined."""
    def share(df: DataFrame, name: str) -> DataFrame:
        return with_share(df.groupBy(dim).agg(F.count(F.lit(1)).alias(f"n_{name}")), f"n_{name}", f"share_{name}")

    return share(a, names[0]).join(share(b, names[1]), dim, "inner")


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), dfs)


def text_lengths(df: DataFrame, col: str) -> DataFrame:
    """distinct string lengths with counts."""
    return df.groupBy(F.char_length(F.col(col)).alias("length")).agg(F.count(F.lit(1)).alias("count"))
