"""The seven request cases of the reference's end-to-end tests, plus null-semantics edge cases."""

from datetime import timedelta

from pyspark.sql import functions as F

from tests.baskets import LINE_SCHEMA, PRODUCT_SCHEMA, PRODUCTS, STORE_SCHEMA, STORES, T0, TX_SCHEMA, line, tx
from tillsight.operators import rules
from tillsight.operators.features import feature_matrix

CATS = ["ALCOHOL", "BEVERAGES", "DAIRY", "SNACKS", "MISSING"]


def _run(spark, txs, lines, excluded=None):
    t = spark.createDataFrame(txs, TX_SCHEMA)
    ln = spark.createDataFrame(lines, LINE_SCHEMA)
    p = spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA)
    s = spark.createDataFrame(STORES, STORE_SCHEMA)
    ex = rules.excluded_categories(spark, excluded or {})
    fm = feature_matrix(t, ln, p, s, categories=CATS, impute=False)
    out = rules.to_response(rules.screen(t, ln, p, fm, ex)).select("transaction_id", "response.*")
    return {r["transaction_id"]: r for r in out.collect()}, {r["transaction_id"]: r for r in fm.collect()}


def test_golden_cases(spark):
    txs = [
        tx(1, cash="CASH", total=500000.0, n=40),          # model fraud (large, cash, many lines)
        tx(2, total=5.0, n=1),                              # model non-fraud
        tx(3, n=2),                                         # unscanned product
        tx(4, n=2),                                         # unscanned, product id missing
        tx(5, store=1, n=1),                                # excluded discount (store 1 configured)
        tx(6, n=0),                                         # no lines
        tx(7, n=1),                                         # camera values missing
    ]
    lines = [line(1, i, 2, 3.0) for i in range(1, 41)] + [line(1, 41, 1, 1.0)]  # discount on line 41 -> price diff 1.0 > 0.1
    lines += [line(2, 1, 3, 1.5)]
    lines += [line(3, 1, 1, 2.0), line(3, 2, 4, 0.0, voided=True, similar=False, cert=0.95)]
    lines += [line(4, 1, 1, 2.0), line(4, 2, None, 0.0, voided=True, similar=False)]
    lines += [line(5, 1, 1, 1.0)]  # BEVERAGES at 1.0 instead of 2.0
    lines += [line(7, 1, 2, 3.0, voided=True, similar=None, cert=None)]
    res, fm = _run(spark, txs, lines, excluded={"1": ["BEVERAGES", "ALCOHOL"]})

    r = res[1]
    assert r["is_fraud"] and r["fraud_proba"] > 0 and r["estimated_damage"] > 0
    assert r["explanation"]["human_readable_reason"].startswith(
        "Das Modell hat einen möglichen Betrugsfall erkannt: Merkmal payment_cash hat den Wert 1.00 (1.50 Einfluss)\n - Merkmal "
    )
    r = res[2]
    assert not r["is_fraud"] and r["explanation"] is None
    r = res[3]
    assert r["is_fraud"] and r["fraud_proba"] == 1.0 and r["estimated_damage"] == 10.0
    assert r["explanation"]["human_readable_reason"] == rules.REASON_CAMERA and r["explanation"]["offending_products"] == ["4"]
    r = res[4]
    assert r["is_fraud"] and r["fraud_proba"] == 1.0 and r["estimated_damage"] is None
    assert r["explanation"]["offending_products"] == ["unbekannt"]
    r = res[5]
    assert r["is_fraud"] and r["fraud_proba"] == 1.0 and r["estimated_damage"] > 0
    assert r["explanation"]["human_readable_reason"] == rules.REASON_DISCOUNT
    assert r["explanation"]["offending_products"] == ["1 (BEVERAGES)"]
    r = res[6]
    assert r["is_fraud"] and r["fraud_proba"] is None
    assert r["explanation"]["human_readable_reason"] == "Keine Transaktionszeilen vorhanden"
    r = res[7]
    assert not r["is_fraud"]  # null camera flags must not fire a rule
    assert fm[7]["has_unscanned"] is False and fm[7]["has_camera_detected_wrong_product"] is None


def test_excluded_rule_disabled(spark):
    res, _ = _run(spark, [tx(5, store=1, n=1)], [line(5, 1, 1, 1.0)], excluded=None)
    assert res[5]["explanation"] is None or res[5]["explanation"]["human_readable_reason"] != rules.REASON_DISCOUNT


def test_null_semantics_and_edges(spark):
    txs = [tx(10, n=1, start=T0.replace(hour=3)), tx(11, n=2), tx(12, n=3)]
    lines = [
        line(10, 1, None, 1.0),                                   # unknown product: all-null product attributes
        line(11, 1, 4, 0.0, voided=True, similar=False),          # the same unscanned product twice
        line(11, 2, 4, 0.0, voided=True, similar=False),
        line(12, 1, 1, 2.0, dt=5), line(12, 2, 2, 3.0, dt=5), line(12, 3, 3, 1.5, dt=20),
    ]
    res, fm = _run(spark, txs, lines)
    f = fm[10]
    assert f["daytime"] is None                       # N10: hour 3 has no daytime
    assert f["n_age_restricted"] == 0                 # N1/N4: sum of all-null is 0
    assert f["has_age_restricted"] is None            # N3: max of all-null stays null
    assert f["has_unscanned"] is False                # N2: any of all-null is false
    assert f["mean_time_between_scans"] is None and f["max_time_between_scans"] is None  # single line: no gap
    assert f["has_missing"] is True
    assert res[11]["estimated_damage"] == 10.0        # J9: duplicate unscanned product counted once
    f = fm[12]
    assert f["max_time_between_scans"] == 50.0 and abs(f["mean_time_between_scans"] - 27.5) < 1e-9  # gaps 5 s, 50 s


def test_scan_gaps_across_time_slices(spark):
    """A basket spanning several hour slices gives the same gaps as one window over the basket."""
    t = tx(20, n=4, start=T0.replace(minute=58))
    lines = [line(20, 1, 1, 2.0, t=T0.replace(minute=58), dt=30), line(20, 2, 2, 3.0, t=T0.replace(minute=58), dt=30),
             line(20, 3, 3, 1.5, t=T0.replace(minute=58), dt=50), line(20, 4, 1, 2.0, t=T0.replace(minute=58) + timedelta(hours=2), dt=1)]
    _, fm = _run(spark, [t], lines)
    ts = sorted(l[3] for l in lines)
    gaps = [(b - a).total_seconds() for a, b in zip(ts, ts[1:])]
    assert fm[20]["max_time_between_scans"] == max(gaps)
    assert abs(fm[20]["mean_time_between_scans"] - sum(gaps) / len(gaps)) < 1e-9


def test_scan_gaps_of_a_hot_basket(spark):
    """One basket with 30 % of all lines within a minute: the same gaps, and no task sorts more than a second of it."""
    import random

    from pyspark.sql import functions as F

    from tillsight.operators.features import scan_gaps

    rnd = random.Random(6)
    rows = [(1, T0 + timedelta(seconds=rnd.randrange(60), microseconds=rnd.randrange(10**6))) for _ in range(3000)]
    rows += [(2 + i % 500, T0 + timedelta(hours=rnd.randrange(30), seconds=rnd.randrange(3600))) for i in range(7000)] + [(900, None), (901, T0)]
    lines = spark.createDataFrame(rows, "transaction_id long, timestamp timestamp_ntz")
    got = {r.transaction_id: r for r in scan_gaps(lines).collect()}
    assert set(got) == {t for t, ts in rows if ts}
    for t, r in got.items():
        ts = sorted(x for k, x in rows if k == t and x)
        gaps = [(b - a).total_seconds() for a, b in zip(ts, ts[1:])]
        assert r.max_time_between_scans == (max(gaps) if gaps else None)
        assert (r.mean_time_between_scans is None) if not gaps else abs(r.mean_time_between_scans - sum(gaps) / len(gaps)) < 1e-6
    per_window = lines.where("timestamp is not null").groupBy("transaction_id", F.date_trunc("second", "timestamp")).count()
    assert per_window.agg({"count": "max"}).first()[0] < 120


def test_mode_imputation_ties_lowest(spark):
    from tillsight.operators.features import impute_by_label

    df = spark.createDataFrame(
        [(1, "FRAUD", True, 1.0), (2, "FRAUD", False, 3.0), (3, "FRAUD", None, None), (4, "NORMAL", None, None)],
        "id int, label string, flag boolean, gap double",
    )
    out = {r["id"]: r for r in impute_by_label(df, ["flag"], ["gap"]).collect()}
    assert out[3]["flag"] is False and out[3]["gap"] == 2.0     # tie -> lowest value; mean over label
    assert out[4]["flag"] is None and out[4]["gap"] is None     # nothing to impute from
    assert F is not None
