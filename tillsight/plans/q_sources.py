"""Registered queries: sources, sinks and the request stream (S-rows, ST1/ST2)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tillsight.operators import audits as A
from tillsight.operators import rules
from tillsight.operators.features import discover_categories
from tillsight.plans.basket_sql import feature_sql
from tillsight.plans.common import FIXTURE_EXCLUDED, features, tables
from tillsight.plans.q_rules import RULE_CTES
from tillsight.plans.registry import basket_sql, finish, register
from tillsight.sources import files as IO
from tillsight.sources.requests import header_rows, line_rows, parse_requests, to_payload, write_requests
from tillsight.streaming.screening import start_request_stream


@register("payload_roundtrip", basket_sql(
    """SELECT t.id AS transaction_id, CAST(t.store_id AS VARCHAR) AS store_id, t.payment_medium,
              strftime(t.transaction_start, '%Y-%m-%d %H:%M:%S') AS transaction_start,
              COUNT(l.id) AS n_request_lines, ROUND(COALESCE(SUM(l.sales_price), 0), 4) AS sales_sum,
              strftime(MIN(l."timestamp"), '%Y-%m-%d %H:%M:%S') AS first_scan
       FROM transactions t LEFT JOIN transaction_lines l ON l.transaction_id = t.id
       GROUP BY t.id, t.store_id, t.payment_medium, t.transaction_start"""))
def q_payload(spark, sf_dir):
    """S5 + S4: export one JSON document per basket, parse it back, compare with the tables."""
    b = tables(spark, sf_dir)
    parsed = parse_requests(to_payload(b.transactions, b.lines))
    h = header_rows(parsed, "transaction_id")
    ln = line_rows(parsed, "transaction_id").groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("sales_price").alias("sales_sum"), F.min("timestamp").alias("first_scan"))
    j = h.join(ln, h["id"] == ln["transaction_id"], "left")
    return finish(j.select(
        F.col("id").cast("bigint").alias("transaction_id"), "store_id", "payment_medium", "transaction_start",
        F.col("n_lines").alias("n_request_lines"), F.coalesce(F.col("sales_sum"), F.lit(0.0)).alias("sales_sum"), "first_scan"))


@register("csv_dimension_roundtrip", basket_sql("SELECT id, category, price, popularity, sold_by_weight, age_restricted FROM products"))
def q_csv(spark, sf_dir):
    """S10 + S2: write the product dimension as CSV, read it back with a declared schema."""
    p = tables(spark, sf_dir).products
    path = IO.write_csv(p, IO.scratch_path(spark, "products-csv"))
    return finish(IO.read_dim(spark, path, IO.PRODUCTS_SCHEMA))


@register("variant_sinks", feature_sql(
    "SELECT label, COUNT(*) AS n, ROUND(SUM(damage), 4) AS damage FROM fm WHERE label <> 'UNKNOWN' GROUP BY label"))
def q_variants(spark, sf_dir):
    """S7 (+S1): write target-first variants and re-read the label+damage one."""
    out = IO.write_variants(features(spark, sf_dir), IO.scratch_path(spark, "variants"))
    df = IO.read_facts(spark, out["label_and_damage"])
    assert df.columns[:2] == ["label", "damage"]
    return finish(df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("damage").alias("damage")))


@register("predictions_sink", feature_sql(
    "SELECT CAST(is_fraud AS VARCHAR) AS is_fraud, COUNT(*) AS n FROM ("
    "SELECT TRUE AS is_fraud FROM fm WHERE has_missing OR has_unscanned UNION ALL "
    "SELECT p > 10.0 / (5.0 + 10.0 + damage_pred) FROM scored WHERE transaction_id NOT IN (SELECT transaction_id FROM fm WHERE has_missing OR has_unscanned)) "
    "GROUP BY 1", RULE_CTES))
def q_predictions_sink(spark, sf_dir):
    """S9 (+R7): write batch predictions, re-read, count decisions."""
    path = IO.write_parquet(rules.predict_batch(features(spark, sf_dir, impute=False)), IO.scratch_path(spark, "predictions"))
    return IO.read_facts(spark, path).groupBy(F.col("is_fraud").cast("string").alias("is_fraud")).agg(F.count(F.lit(1)).alias("n"))


@register("wide_join_sink", basket_sql(
    "SELECT t.label, COUNT(*) AS n, ROUND(SUM(l.sales_price), 4) AS sales FROM transaction_lines l "
    "LEFT JOIN transactions t ON t.id = l.transaction_id GROUP BY t.label"))
def q_wide_sink(spark, sf_dir):
    """S8 (+J4): write the wide joined table, re-read it."""
    b = tables(spark, sf_dir)
    path = IO.write_parquet(A.wide_join(b.transactions, b.lines, b.products, b.stores), IO.scratch_path(spark, "wide"))
    df = IO.read_facts(spark, path)
    return finish(df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("sales_price").alias("sales")))


@register("sample_rows_csv", basket_sql("SELECT id, label, total_amount FROM transactions ORDER BY id LIMIT 1000"))
def q_sample_rows(spark, sf_dir):
    """S12 + S10: the first 1000 receipts by id exported to CSV and re-read (the head is the feature)."""
    from pyspark.sql import types as T

    t = tables(spark, sf_dir).transactions.select("id", "label", "total_amount")
    path = IO.write_csv(IO.sample_rows(t, 1000, "id"), IO.scratch_path(spark, "sample"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("total_amount", T.DoubleType())])
    return finish(IO.read_csv(spark, path, schema))


@register("test_split_loader", basket_sql(
    "SELECT 'UNKNOWN' AS label, COUNT(*) AS n, CAST(0.0 AS DOUBLE) AS damage FROM transactions"))
def q_test_loader(spark, sf_dir):
    """S3: test split gets label UNKNOWN and damage 0."""
    t = IO.load_split(tables(spark, sf_dir).transactions, testdata=True)
    return finish(t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("damage").alias("damage")))


_REQ_CTES = re.sub(r"\bfm\b", "fmq", RULE_CTES)
_STREAM_SQL = feature_sql(
    "SELECT transaction_id, rule, is_fraud, ROUND(fraud_proba, 4) AS fraud_proba, ROUND(estimated_damage, 4) AS estimated_damage, "
    "reason, offending_products FROM screen_out",
    "fmq AS (SELECT fm0.* REPLACE (COALESCE(nla.n, 0) AS n_lines) FROM fm0 "
    "LEFT JOIN (SELECT transaction_id AS tid, COUNT(*) AS n FROM transaction_lines GROUP BY 1) nla ON nla.tid = fm0.transaction_id), "
    + _REQ_CTES,
)


@register("stream_screening", _STREAM_SQL)
def q_stream(spark, sf_dir):
    """ST1 (+ST2, S4, S5): request documents streamed through foreachBatch, screened like the batch job."""
    b = tables(spark, sf_dir)
    src = IO.scratch_path(spark, "requests")
    write_requests(to_payload(b.transactions, b.lines), src)
    out, rej, ck = (IO.scratch_path(spark, n) for n in ("stream-out", "stream-rejects", "stream-ckpt"))
    excl = rules.excluded_categories(spark, FIXTURE_EXCLUDED)
    q = start_request_stream(spark, src, out, rej, ck, b.products, b.stores, excl, discover_categories(b.products))
    q.awaitTermination()
    res = spark.read.parquet(out).drop("epoch")
    res = res.drop("request_id").withColumn("transaction_id", F.col("transaction_id").cast("bigint"))
    return finish(res.withColumn("offending_products", F.array_join("offending_products", ", ")))
