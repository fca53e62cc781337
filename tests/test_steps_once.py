"""Lines dealt out by basket, and columns that are computed once for all that reads them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillsight.operators import audits as A
from tillsight.operators import models as ML
from tillsight.operators import stats as T
from tillsight.sources import basket as B

LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"


def business_tables(spark):
    lineitem = spark.createDataFrame([(i // 3, i % 7, i % 5, i % 3 + 1, 2.0, 0.1, "RN"[i % 2], "O") for i in range(300)], LINEITEM)
    part = spark.createDataFrame([(k, 10.0 + k) for k in range(6)], "p_partkey long, p_retailprice double")
    orders = spark.createDataFrame([(k, datetime(2024, 3, 1)) for k in range(90)], "o_orderkey long, o_orderdate timestamp_ntz")
    return lineitem, part, orders


def test_lines_fill_their_partitions(spark, monkeypatch):
    lineitem, part, orders = business_tables(spark)
    assert B.basket_tasks(lineitem) is None
    cores, session = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(B, "LINES_PER_TASK", 3)
    tasks = B.basket_tasks(lineitem)
    assert tasks == max(101, session) and tasks > cores
    dealt = B.lines_view(lineitem, part, orders, tasks)
    per_basket = dealt.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    assert per_basket.rdd.getNumPartitions() == tasks  # no merging of what is dealt out, no further exchange
    assert sorted(map(str, dealt.collect())) == sorted(map(str, B.lines_view(lineitem, part, orders).collect()))


@pytest.fixture
def counted(spark):
    """Rows of a table, and how many of them were computed."""
    seen = spark.sparkContext.accumulator(0)

    def value(i):
        seen.add(1)
        return float(i * i % 17)

    rows = spark.range(0, 200, 1, 4).select("id", (F.col("id") % 2).cast("string").alias("label"), F.udf(value, "double").asNondeterministic()("id").alias("x"))
    return rows.withColumn("y", F.col("id").cast("double")), seen


def test_histogram_computes_its_column_once(counted):
    df, seen = counted
    assert sum(r["count"] for r in A.shared_edge_hist(df, "x", "label", 4).collect()) == 200
    assert seen.value == 200


def test_monotone_gap_computes_its_columns_once(counted):
    df, seen = counted
    assert [r["feature"] for r in T.monotone_gap(df, ["x"], "y", "id").collect()] == ["x"]
    assert seen.value == 200


def test_final_fits_encode_each_row_once(counted, tmp_path):
    df, seen = counted
    data = df.select("id", F.col("label").cast("int").alias("y"), (F.col("id") % 3).cast("double").alias("damage"), "x", F.col("label").alias("medium"))
    clf, reg = ML.train_final(data, str(tmp_path), exclude=("id", "y", "damage"))
    assert seen.value == 200
    assert len(clf.stages) == len(reg.stages) == 3 and reg.transform(data).count() == 200


def test_rows_of_a_fit_are_dealt_to_all_cores(spark, monkeypatch):
    rows = spark.range(0, 4000, 1, 2).withColumn("x", F.col("id") * 2)
    cores = spark.sparkContext.defaultParallelism
    assert ML.fit_table(rows, 4000, "few").rdd.getNumPartitions() == 1  # too few for more tasks
    monkeypatch.setattr(ML, "LEAST_ROWS", 10)
    for most in (ML.ROWS_PER_TASK, 20):
        monkeypatch.setattr(ML, "ROWS_PER_TASK", most)
        share = min(max(4000 // cores, 10) * 11 // 10, most)
        table = ML.fit_table(rows, 4000, "dealt")
        sizes = [len(p) for p in table.rdd.glom().collect()]
        assert len(sizes) == 2 * -(-2000 // share) and max(sizes) == min(share, 2000)
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.conf.get("spark.sql.files.openCostInBytes") != spark.conf.get("spark.sql.files.maxPartitionBytes")
