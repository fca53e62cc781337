"""Registered queries: rule mining, basket items, itemsets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tillsight.functions import scalar as S
from tillsight.operators import mining as M
from tillsight.operators.features import category_flags, discover_categories
from tillsight.plans.basket_sql import CATEGORIES, feature_sql
from tillsight.plans.common import features, tables
from tillsight.plans.registry import basket_sql, finish, register

RULE_COLS = ["payment_medium", "daytime", "feedback_categorical", "has_unscanned", "has_missing", "has_positive_price_difference", "cash_desk"]
MORE_FLAGS = [
    "has_voided", "has_unscanned", "has_age_restricted", "has_sold_by_weight", "has_positive_price_difference",
    "feedback_low", "feedback_top", "has_feedback",
]
FLAGS = ["has_" + c.lower() for c in CATEGORIES] + MORE_FLAGS  # the twins' list; the queries discover the categories
_LAB = "label IN ('FRAUD', 'NORMAL')"


def _labelled(spark, sf_dir):
    return features(spark, sf_dir, impute=False).where(F.col("label").isin("FRAUD", "NORMAL"))


@register("single_feature_rules", feature_sql(
    "SELECT feature, value, support, fraud_hits, ROUND(CAST(fraud_hits AS DOUBLE) / support, 4) AS precision, "
    f"ROUND(CAST(fraud_hits AS DOUBLE) / (SELECT COUNT(*) FROM fm WHERE label = 'FRAUD'), 4) AS recall FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, COUNT(*) AS support, "
        f"CAST(COUNT(*) FILTER (WHERE label = 'FRAUD') AS BIGINT) AS fraud_hits FROM fm WHERE {_LAB} GROUP BY 2" for c in RULE_COLS)
    + ")"))
def q_single_rules(spark, sf_dir):
    """Support / hits / precision / recall of every value of low-cardinality columns."""
    fm = _labelled(spark, sf_dir)
    out = M.single_rules(fm, RULE_COLS)
    return finish(out.withColumn("value", F.when(F.col("value") == "true", "true").when(F.col("value") == "false", "false").otherwise(F.col("value"))))


@register("pair_rules", feature_sql(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, COUNT(*) FILTER (WHERE COALESCE({a} AND {b}, FALSE)) AS matches, "
        f"COUNT(*) FILTER (WHERE COALESCE({a} AND {b}, FALSE) AND label = 'FRAUD') AS frauds_captured, "
        f"ROUND(CAST(COUNT(*) FILTER (WHERE COALESCE({a} AND {b}, FALSE) AND label = 'FRAUD') AS DOUBLE) / "
        f"NULLIF(COUNT(*) FILTER (WHERE COALESCE({a} AND {b}, FALSE)), 0), 4) AS precision FROM fm WHERE {_LAB}"
        for a, b in combinations(FLAGS, 2)) + ") WHERE matches > 0"))
def q_pair_rules(spark, sf_dir):
    """Two-flag rules over all binary columns, one aggregate pass."""
    fm = _labelled(spark, sf_dir)
    return finish(M.pair_rules(fm, category_flags(fm) + MORE_FLAGS))


_RULES_SQL = {
    "has_unscanned": "has_unscanned", "has_missing": "has_missing",
    "has_positive_price_difference": "has_positive_price_difference", "payment_cash": "payment_medium = 'CASH'",
}


@register("rule_evaluation", feature_sql(
    "SELECT rule, tp, fp, fn, tn, ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0), 4) AS precision, "
    "ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0), 4) AS recall, ROUND(COALESCE(CAST(fp AS DOUBLE) / NULLIF(fp + tn, 0), 0), 4) AS fpr, "
    "ROUND(COALESCE(CAST(fn AS DOUBLE) / NULLIF(tp + fn, 0), 0), 4) AS fnr, ROUND(damage_prevented, 4) AS damage_prevented FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, COUNT(*) FILTER (WHERE label = 'FRAUD' AND COALESCE({e}, FALSE)) AS tp, "
        f"COUNT(*) FILTER (WHERE label <> 'FRAUD' AND COALESCE({e}, FALSE)) AS fp, "
        f"COUNT(*) FILTER (WHERE label = 'FRAUD' AND NOT COALESCE({e}, FALSE)) AS fn, "
        f"COUNT(*) FILTER (WHERE label <> 'FRAUD' AND NOT COALESCE({e}, FALSE)) AS tn, "
        f"COALESCE(SUM(damage) FILTER (WHERE label = 'FRAUD' AND COALESCE({e}, FALSE)), 0) AS damage_prevented FROM fm WHERE {_LAB}"
        for n, e in _RULES_SQL.items()) + ")"))
def q_rule_eval(spark, sf_dir):
    """Confusion, rates and prevented damage per rule."""
    rules = {
        "has_unscanned": F.col("has_unscanned"), "has_missing": F.col("has_missing"),
        "has_positive_price_difference": F.col("has_positive_price_difference"), "payment_cash": F.col("payment_medium") == "CASH",
    }
    return finish(M.evaluate_rules(_labelled(spark, sf_dir), rules))


_ITEMS_CTE = """items AS (
  SELECT l.transaction_id, list_sort(list_distinct(list(COALESCE(lower(p.category), 'missing')))) AS items
  FROM transaction_lines l LEFT JOIN products p ON p.id = l.product_id GROUP BY l.transaction_id
)"""


def _items(spark, sf_dir):
    b = tables(spark, sf_dir)
    return M.basket_items(b.lines, b.products), b


@register("basket_items", basket_sql("SELECT transaction_id, array_to_string(items, ', ') AS items FROM items", _ITEMS_CTE))
def q_basket_items(spark, sf_dir):
    """U5 (+U9): sorted category set per basket, text form."""
    items, _ = _items(spark, sf_dir)
    return items.select("transaction_id", M.itemset_text("items").alias("items"))


@register("items_with_label", basket_sql(
    "SELECT i.transaction_id, t.label, array_to_string(list_sort(list_distinct(list_append(i.items, t.label))), ', ') AS items_label "
    "FROM items i JOIN transactions t ON t.id = i.transaction_id", _ITEMS_CTE))
def q_items_with_label(spark, sf_dir):
    """Items plus the label, de-duplicated."""
    items, b = _items(spark, sf_dir)
    out = M.items_with_label(items, b.transactions)
    return out.select("transaction_id", "label", F.array_join("items_label", ", ").alias("items_label"))


@register("item_fraud_share", basket_sql(
    "SELECT item, COUNT(*) AS n_baskets, COUNT(*) FILTER (WHERE label = 'FRAUD') AS n_fraud, "
    "ROUND(COUNT(*) FILTER (WHERE label = 'FRAUD') / COUNT(*), 4) AS fraud_share "
    "FROM (SELECT unnest(i.items) AS item, t.label FROM items i JOIN transactions t ON t.id = i.transaction_id) WHERE item <> 'missing' GROUP BY item",
    _ITEMS_CTE))
def q_item_fraud_share(spark, sf_dir):
    """Fraud share of baskets containing each item."""
    items, b = _items(spark, sf_dir)
    return finish(M.item_fraud_share(items, b.transactions))


_VOCAB = [c.lower() for c in CATEGORIES if c != "MISSING"]


@register("multi_hot_items", basket_sql(
    "SELECT " + ", ".join(f"CAST(SUM(CAST(list_contains(items, '{v}') AS INTEGER)) AS BIGINT) AS item_{v}" for v in _VOCAB) + " FROM items",
    _ITEMS_CTE))
def q_multi_hot(spark, sf_dir):
    """Multi-hot item columns (column sums over all baskets)."""
    items, b = _items(spark, sf_dir)
    names = [c.lower() for c in discover_categories(b.products) if c != S.MISSING]
    mh = M.multi_hot(items, names)
    return mh.agg(*[F.sum(f"item_{v}").cast("bigint").alias(f"item_{v}") for v in names])


def _powerset_sql() -> str:
    from itertools import combinations as comb

    vocab = sorted(_VOCAB + ["missing"])
    sets = [list(c) for r in range(1, len(vocab) + 1) for c in comb(vocab, r)]
    rows = ", ".join("([" + ", ".join(f"'{x}'" for x in s) + "])" for s in sets)
    return f"cand AS (SELECT * FROM (VALUES {rows}) AS t(iset))"


def _itemsets_sql(label: str) -> str:
    return f"""SELECT array_to_string(iset, ', ') AS itemset, CAST(len(iset) AS INTEGER) AS size, freq,
                      ROUND(CAST(freq AS DOUBLE) / nb, 4) AS support FROM (
                 SELECT c.iset, COUNT(*) AS freq, (SELECT COUNT(*) FROM lb) AS nb FROM cand c JOIN lb ON list_has_all(lb.items, c.iset) GROUP BY c.iset)
               WHERE CAST(freq AS DOUBLE) / nb >= 0.1"""


def _lb_cte(label: str) -> str:
    return f"lb AS (SELECT i.items FROM items i JOIN transactions t ON t.id = i.transaction_id WHERE t.label = '{label}')"


@register("frequent_itemsets_fraud", basket_sql(_itemsets_sql("FRAUD"), _ITEMS_CTE + ", " + _powerset_sql() + ", " + _lb_cte("FRAUD")))
def q_itemsets_fraud(spark, sf_dir):
    """U8 (+U9): frequent category sets of FRAUD baskets, support >= 0.1 (FP-growth)."""
    items, b = _items(spark, sf_dir)
    fr = items.join(b.transactions.where(F.col("label") == "FRAUD").select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi")
    return finish(M.frequent_itemsets(fr, 0.1))


@register("itemsets_fraud_vs_normal", basket_sql(
    """SELECT COALESCE(f.itemset, n.itemset) AS itemset, ROUND(COALESCE(f.support, 0), 4) AS support_fraud,
              ROUND(COALESCE(n.support, 0), 4) AS support_normal, ROUND(COALESCE(f.support, 0) - COALESCE(n.support, 0), 4) AS difference
       FROM fr f FULL OUTER JOIN nr n ON f.itemset = n.itemset""",
    _ITEMS_CTE + ", " + _powerset_sql()
    + ", lbf AS (SELECT i.items FROM items i JOIN transactions t ON t.id = i.transaction_id WHERE t.label = 'FRAUD')"
    + ", lbn AS (SELECT i.items FROM items i JOIN transactions t ON t.id = i.transaction_id WHERE t.label = 'NORMAL')"
    + ", fr AS (" + _itemsets_sql("FRAUD").replace("lb", "lbf").replace("ROUND(CAST(freq AS DOUBLE) / nb, 4) AS support", "CAST(freq AS DOUBLE) / nb AS support") + ")"
    + ", nr AS (" + _itemsets_sql("NORMAL").replace("lb", "lbn").replace("ROUND(CAST(freq AS DOUBLE) / nb, 4) AS support", "CAST(freq AS DOUBLE) / nb AS support") + ")"))
def q_itemsets_compare(spark, sf_dir):
    """U8 + J10: itemset support FRAUD vs NORMAL, full outer join, 0 where absent."""
    items, b = _items(spark, sf_dir)
    def by(label):
        ids = b.transactions.where(F.col("label") == label).select(F.col("id").alias("transaction_id"))
        return M.frequent_itemsets(items.join(ids, "transaction_id", "left_semi"), 0.1)
    return finish(M.compare_itemsets(by("FRAUD"), by("NORMAL")))


@register("discount_fraud_intersection", feature_sql(
    "SELECT COUNT(*) AS n FROM (SELECT transaction_id FROM fm WHERE calculated_price_difference > 0 "
    "INTERSECT SELECT transaction_id FROM fm WHERE label = 'FRAUD')"))
def q_intersection(spark, sf_dir):
    """Baskets that are both discounted and fraud (set intersection of ids)."""
    fm = features(spark, sf_dir)
    a = fm.where(F.col("calculated_price_difference") > 0)
    b = fm.where(F.col("label") == "FRAUD")
    return M.id_intersection(a, b, "transaction_id").agg(F.count(F.lit(1)).alias("n"))


@register("distinct_categories", basket_sql("SELECT DISTINCT category FROM products"))
def q_distinct(spark, sf_dir):
    """Distinct values."""
    return M.distinct_values(tables(spark, sf_dir).products, "category")


@register("first_per_basket", basket_sql(
    "SELECT l.transaction_id, ANY_VALUE(t.label) AS label FROM transaction_lines l JOIN transactions t ON t.id = l.transaction_id "
    "GROUP BY l.transaction_id"))
def q_first_per_key(spark, sf_dir):
    """The first row of every basket that has lines (the label is constant within a basket)."""
    b = tables(spark, sf_dir)
    j = b.lines.join(b.transactions.select(F.col("id").alias("transaction_id"), "label"), "transaction_id")
    return M.first_per_key(j.select("transaction_id", "label"), "transaction_id")


@register("column_cardinalities", feature_sql(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM fm" for c in RULE_COLS) + ")"))
def q_cardinalities(spark, sf_dir):
    """Exact distinct counts per column."""
    return M.cardinalities(features(spark, sf_dir), RULE_COLS)
