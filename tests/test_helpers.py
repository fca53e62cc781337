"""Sweep, rank and special-function helpers against brute force / textbook values."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tillsight.functions.special import chi2_sf, t_two_sided
from tillsight.functions.sweep import prefix_count
from tillsight.operators.sampling import stratified_rank
from tillsight.operators.stats import average_ranks


def test_pvalues_textbook():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(t_two_sided(1.959963984540054, 1e9) - 0.05) < 1e-6
    assert chi2_sf(0.0, 3) == 1.0


def test_prefix_count_matches_brute_force(spark):
    rnd = random.Random(7)
    vals = [round(rnd.random(), 6) for _ in range(400)] + [0.1, 1.0, 0.0, 0.55]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    for grid in (list(np.linspace(0.1, 1.0, 100)), list(np.arange(0.05, 1.0, 0.1)), [0.3, 0.31, 0.7]):
        grid = [float(g) for g in grid]
        got = df.select("p", prefix_count(grid, lambda t: F.col("p") > t, F.col("p")).alias("k"),
                        prefix_count(grid, lambda t: t <= F.col("p"), F.col("p"), inclusive=True).alias("k2")).collect()
        for r in got:
            assert r["k"] == sum(1 for g in grid if r["p"] > g)
            assert r["k2"] == sum(1 for g in grid if g <= r["p"])


def test_stratified_rank_exact(spark):
    rows = [(i, "A" if i % 7 else "B") for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = stratified_rank(df, ["s"], "id", 42, prefix_chars=2).collect()
    import hashlib

    for s in ("A", "B"):
        ids = sorted((hashlib.md5(f"{i}42".encode()).hexdigest(), i) for i, ss in rows if ss == s)
        want = {i: r + 1 for r, (_, i) in enumerate(ids)}
        for r in got:
            if r["s"] == s:
                assert r["rank"] == want[r["id"]] and r["n_stratum"] == len(ids)


def test_average_ranks_ties(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 10.0, 10.0]
    long = spark.createDataFrame([(i, "x", v) for i, v in enumerate(vals)], "rid int, feature string, value double")
    got = {r["rid"]: r["rank"] for r in average_ranks(long, buckets=3).collect()}
    order = sorted(vals)
    for i, v in enumerate(vals):
        first = order.index(v) + 1
        ties = order.count(v)
        assert math.isclose(got[i], first + (ties - 1) / 2)


def test_exact_quantiles_match_numpy(spark):
    from tillsight.functions.quantiles import exact_quantiles

    rnd = random.Random(3)
    rows = [("a", float(rnd.randint(0, 50))) for _ in range(500)] + [("b", rnd.random()) for _ in range(333)] + [("c", 7.0)]
    rows += [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, "x", probs, by=["g"], buckets=16).collect()}
    for g in ("a", "b", "c"):
        vals = np.array([x for gg, x in rows if gg == g and x is not None])
        for p in probs:
            name = f"q{int(round(p * 100))}"
            assert math.isclose(got[g][name], float(np.quantile(vals, p)), rel_tol=1e-12, abs_tol=1e-12)
    whole = exact_quantiles(df, "x", [0.5], names=["median"]).first()["median"]
    allv = np.array([x for _, x in rows if x is not None])
    assert math.isclose(whole, float(np.quantile(allv, 0.5)))


def test_buckets_stand_outliers_and_frequent_values(spark):
    """One value far off and one on 95 % of the rows: no bucket holds much more than its share of the distinct values."""
    import numpy as np

    from tillsight.functions.quantiles import bucket_bounds, bucket_of, exact_quantiles

    values = [float(i) for i in range(2000)] + [1e9] + [7.0] * 40000
    df = spark.createDataFrame([(v,) for v in values], "x double")
    distinct = df.distinct()
    bounds = distinct.agg(bucket_bounds("x", 64).alias("b")).first()["b"]
    sizes = distinct.groupBy(bucket_of(F.col("x"), F.array(*map(F.lit, bounds)), 64).alias("b")).count().collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) <= 3 * 2001 / 64
    got = exact_quantiles(df, "x", [0.01, 0.5, 0.99, 1.0], names=["a", "b", "c", "d"]).first()
    assert [got[n] for n in "abcd"] == [float(np.quantile(values, p)) for p in (0.01, 0.5, 0.99, 1.0)]


def test_null_keys_are_dealt_out_and_keep_their_rows(spark):
    from tillsight.functions.nulls import left_join_spread

    left = spark.createDataFrame([(i, None if i % 2 else i % 10, f"t{i}") for i in range(2000)], "line long, product_id long, note string")
    right = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "product_id long, name string")
    rows = left_join_spread(left, right, "product_id")
    got = {r.line: (r.product_id, r.name, r.note) for r in rows.collect()}
    assert len(got) == rows.count() == 2000 and rows.columns == ["product_id", "line", "note", "name"]
    assert all(got[i] == ((None, None) if i % 2 else (i % 10, f"p{i % 10}" if i % 10 < 8 else None)) + (f"t{i}",) for i in range(2000))
    # half of the rows have no key: no task gets them all
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        by_join = left_join_spread(left.repartition(4), right.hint("merge"), "product_id").selectExpr("spark_partition_id() as p", "product_id")
        most = by_join.where("product_id is null").groupBy("p").count().agg({"count": "max"}).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 400


def test_average_ranks_with_a_value_on_most_rows(spark):
    from tillsight.operators import stats

    rows = [(i, "a", 0.0 if i % 20 else float(i % 170)) for i in range(3000)] + [(i, "b", float(i * 7919 % 3000)) for i in range(3000)]
    got = {(r.feature, r.key): r["rank"] for r in stats.average_ranks(spark.createDataFrame(rows, "key long, feature string, value double")).collect()}
    assert len(got) == 6000
    for name in "ab":
        own = sorted((v, k) for k, f, v in rows if f == name)
        places = {}
        for place, (v, _) in enumerate(own, 1):
            places.setdefault(v, []).append(place)
        assert all(got[name, k] == sum(places[v]) / len(places[v]) for v, k in own)
