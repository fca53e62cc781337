"""Library behaviour the registered queries do not pin down on their own."""

import json

from pyspark.sql import functions as F

from tillsight.operators import encode as E
from tillsight.operators import mining as M
from tillsight.operators import rules
from tillsight.operators import sampling as O
from tillsight.sources.files import load_split, scratch_path


def test_encoder_unseen_absent_and_null(spark):
    train = spark.createDataFrame([(1, "CASH", 2.0, True), (2, "CARD", 3.0, False)], "id int, pay string, x double, f boolean")
    enc = E.BasketEncoder(drop_first=False).fit(train, exclude=["id"])
    assert enc.columns_ == ["x", "f", "pay_CARD", "pay_CASH"]
    path = scratch_path(spark, "encoder-state")
    enc.save(spark, path)
    enc2 = E.BasketEncoder.load(spark, path)
    assert enc2.to_json() == enc.to_json()
    test = spark.createDataFrame([(3, "VOUCHER", 1.0), (4, None, 1.0)], "id int, pay string, x double")  # f absent
    rows = {r["id"]: r for r in enc2.transform(test, keep=["id"]).collect()}
    assert rows[3]["pay_CARD"] == 0 and rows[3]["pay_CASH"] == 0 and rows[3]["f"] == 0   # unseen -> 0, absent -> 0
    assert rows[4]["pay_CARD"] is None and rows[4]["pay_CASH"] is None                   # null -> null dummies


def test_drop_first_dummies_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    out = E.to_dummies(df, ["k"], drop_first=True)
    assert out.columns == ["k_b", "k_c"]


def test_schema_diff_and_columns_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert E.schema_diff(df, ["a", "b", "z"]) == [("c", "unexpected"), ("z", "missing")]
    assert E.with_columns_first(df, ["c"]).columns == ["c", "a", "b"]
    assert E.drop_existing(df, ["b", "nope"]).columns == ["a", "c"]


def test_columns_by_cardinality(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("low"), F.lit(1).alias("const"))
    assert M.columns_by_cardinality(df, ["id", "low", "const"], 2, 20) == ["low"]
    assert M.columns_by_cardinality(df, ["id", "low", "const"], 1, 1) == ["const"]


def test_response_json_shape(spark):
    s = spark.createDataFrame(
        [(1, "model", False, 0.2, 1.5, None, None), (2, "unscanned", True, 1.0, 3.0, rules.REASON_CAMERA, ["7"])],
        "transaction_id long, rule string, is_fraud boolean, fraud_proba double, estimated_damage double, reason string, offending_products array<string>",
    )
    out = {r["transaction_id"]: json.loads(r["response_json"]) for r in rules.to_response(s, "1.2.3").collect()}
    assert out[1] == {"version": "1.2.3", "is_fraud": False, "fraud_proba": 0.2, "estimated_damage": 1.5}
    assert out[2]["explanation"] == {"human_readable_reason": rules.REASON_CAMERA, "offending_products": ["7"]}


def test_split_sizes_are_exact_per_stratum(spark):
    rows = [(i, "FRAUD" if i % 10 == 0 else "NORMAL") for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "id long, label string")
    s = O.split(df, ["label"], "id", 0.2, 42)
    counts = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert counts[("FRAUD", "test")] == 40 and counts[("NORMAL", "test")] == 360
    again = O.split(df, ["label"], "id", 0.2, 42).where(F.col("split") == "test").select("id")
    assert again.exceptAll(s.where(F.col("split") == "test").select("id")).count() == 0  # reproducible


def test_load_split_test_data(spark):
    tx = spark.createDataFrame([(1, "FRAUD", 2.0), (2, "UNKNOWN", None)], "id int, label string, damage double")
    t = load_split(tx, testdata=True).collect()
    assert {r["label"] for r in t} == {"UNKNOWN"} and {r["damage"] for r in t} == {0.0}
    assert [r["id"] for r in load_split(tx, only_labeled=True).collect()] == [1]


def test_null_report_counts_every_column_of_the_matrix(spark, tmp_path):
    from datetime import datetime

    from tillsight.plans import QUERIES

    day = datetime(1995, 3, 4)
    tables = {
        "region": ([(0, "CITIES")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
        "part": ([(1, "PROMO", 5, 10.0)], "p_partkey long, p_type string, p_size int, p_retailprice double"),
        "orders": ([(1, 0, "F", 20.0, day, "1-URGENT"), (2, 0, "O", None, day, "1-URGENT"), (3, 1, "O", 5.0, day, "2-HIGH")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, 1, 2.0, 0.0, "N", "O"), (1, 1, 1, 2, 1.0, 0.0, "N", "O")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, "
                     "l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["column"]: r["null_count"] for r in QUERIES["null_report"](spark, str(tmp_path)).collect()}
    # one order has no amount, two have no lines, one has a store that is not in the table
    assert got["total_amount"] == got["urbanization"] == got["location"] == got["days_since_sco_introduction"] == 1
    assert got["n_voided"] == got["has_promo"] == got["max_product_price"] == got["time_from_last_scan_to_end"] == 2
    assert {"transaction_id", "store_id", "damage", "label", "n_lines"}.isdisjoint(got) and all(got.values())
