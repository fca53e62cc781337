"""ST1/ST2: stream answers like the batch job; invalid requests go to the reject sink."""

import json
import os

from pyspark.sql import functions as F

from tests.baskets import PRODUCT_SCHEMA, PRODUCTS, STORE_SCHEMA, STORES
from tillsight.operators import rules
from tillsight.sources.files import scratch_path
from tillsight.sources.requests import parse_requests, write_requests
from tillsight.streaming import screening
from tillsight.streaming.screening import held_requests, start_request_stream


def _doc(tid, lines, pay="CASH"):
    return json.dumps({
        "transaction_id": tid,
        "transaction_header": {"store_id": "2", "cash_desk": 1, "transaction_start": "2024-03-04T09:00:00",
                               "transaction_end": "2024-03-04T09:05:00", "total_amount": 20.0, "payment_medium": pay,
                               "customer_feedback": None},
        "transaction_lines": lines,
    })


def test_stream_rejects_and_results(spark):
    good_line = {"id": 1, "product_id": "4", "timestamp": "2024-03-04T09:01:00", "pieces_or_weight": 1.0, "sales_price": 0.0,
                 "was_voided": True, "camera_product_similar": False, "camera_certainty": 0.9}
    docs = [_doc(1, [good_line]), _doc(2, []), _doc(3, [dict(good_line, timestamp=None)]), _doc(4, [good_line], pay=None),
            "{not json"]
    src = scratch_path(spark, "test-requests")
    spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.text(src)
    out, rej, ck = (scratch_path(spark, n) for n in ("t-out", "t-rej", "t-ck"))
    p = spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA)
    s = spark.createDataFrame(STORES, STORE_SCHEMA)
    q = start_request_stream(spark, src, out, rej, ck, p, s, rules.excluded_categories(spark, {}), ["ALCOHOL", "BEVERAGES", "DAIRY", "SNACKS", "MISSING"])
    q.awaitTermination()
    res = {int(r["transaction_id"]): r for r in spark.read.parquet(out).collect()}  # ids are text, as sent
    assert set(res) == {1, 2}
    assert res[1]["rule"] == "unscanned" and res[1]["estimated_damage"] == 10.0
    assert res[2]["rule"] == "no_lines"
    rejects = [r["reject_reason"] for r in spark.read.parquet(rej).collect()]
    assert len(rejects) == 3 and "malformed JSON" in rejects
    assert any("header.payment_medium" in r for r in rejects) and any("line field missing" in r for r in rejects)
    assert F is not None


def _stream(spark, docs, products, name):
    src, out, rej, ck = (scratch_path(spark, f"{name}-{n}") for n in ("src", "out", "rej", "ck"))
    spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.text(src)
    s = spark.createDataFrame(STORES, STORE_SCHEMA)
    cats = ["ALCOHOL", "BEVERAGES", "DAIRY", "SNACKS", "MISSING"]
    start_request_stream(spark, src, out, rej, ck, products, s, rules.excluded_categories(spark, {}), cats).awaitTermination()
    return spark.read.parquet(out).collect(), [r["reject_reason"] for r in spark.read.parquet(rej).collect()]


def test_bad_records_do_not_stop_good_ones(spark):
    """UUID ids are read as they are; values of a wrong type reject their own document only."""
    uid = "6f1c2a34-9f0e-4c1b-8a55-0c3f6f3b7d10"
    line = {"id": 1, "product_id": "4", "timestamp": "2024-03-04T09:01:00", "pieces_or_weight": 1.0, "sales_price": 0.0,
            "was_voided": True, "camera_product_similar": False, "camera_certainty": 0.9}
    late = json.loads(_doc(5, [line]))
    late["transaction_header"]["transaction_start"] = "soon"
    odd = json.loads(_doc(6, [line]))
    odd["transaction_header"]["customer_feedback"] = "good"
    docs = [
        _doc("5b0e-not-a-number", [dict(line, product_id=uid)]), _doc(2, [dict(line, timestamp="yesterday")]),
        _doc(3, [dict(line, camera_certainty="high")]), json.dumps(late), json.dumps(odd), _doc(7, [line]),
    ]
    res, rejects = _stream(spark, docs, spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA), "bad")
    assert {r["transaction_id"] for r in res} == {"5b0e-not-a-number", "7"}
    assert sorted(rejects) == [
        "header.customer_feedback: not a int", "header.transaction_start: not a timestamp_ntz",
        "line.camera_certainty: not a double", "line.timestamp: not a timestamp_ntz",
    ]


def test_requests_are_told_apart_without_their_ids(spark):
    line = {"id": 1, "product_id": "4", "timestamp": "2024-03-04T09:01:00", "pieces_or_weight": 1.0, "sales_price": 0.0,
            "was_voided": True, "camera_product_similar": False, "camera_certainty": 0.9}
    clean = dict(line, product_id="1", was_voided=False, sales_price=2.0, camera_product_similar=True)
    nameless = json.loads(_doc(0, [clean]))
    del nameless["transaction_id"]
    docs = [_doc(1, [line]), _doc(1, [clean]), json.dumps(nameless), json.dumps(nameless)]
    res, rejects = _stream(spark, docs, spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA), "same")
    assert not rejects and len(res) == 4 and len({r["request_id"] for r in res}) == 4
    assert sorted((r["transaction_id"] or "", r["rule"]) for r in res) == [("", "model"), ("", "model"), ("1", "model"), ("1", "unscanned")]


def test_the_text_of_a_request_is_held_for_rejects_only(spark):
    line = {"id": 1, "product_id": "4", "timestamp": "2024-03-04T09:01:00", "pieces_or_weight": 1.0, "sales_price": 0.0, "was_voided": True}
    docs = [_doc(1, [line, dict(line, id=2)]), _doc(2, [line, dict(line, id="x", sales_price=None), None]), "{not json"]
    parsed = held_requests(parse_requests(spark.createDataFrame([(d,) for d in docs], "payload string").coalesce(1)))
    rows = parsed.select("raw", "reject_reason", "request.transaction_lines").collect()
    assert [r.raw for r in rows] == [None, *docs[1:]] and rows[0].reject_reason is None and rows[2].reject_reason == "malformed JSON"
    missing = [f"line field missing: line.{f}" for f in ("id", "timestamp", "pieces_or_weight", "sales_price", "was_voided")]
    assert rows[1].reject_reason.split(", ") == ["line.id: not a int", missing[3], missing[0], missing[1], missing[2], missing[4]]
    assert [x.id for x in rows[0].transaction_lines] == [1, 2] and [x.id for x in rows[1].transaction_lines] == [1, None, None]


def test_request_files_are_compressed_and_hold_so_many_documents(spark):
    src = scratch_path(spark, "written-requests")
    docs = [_doc(i, []) for i in range(10)]
    write_requests(spark.createDataFrame([(d,) for d in docs], "payload string").coalesce(1), src, per_file=4)
    read = spark.read.text(src)
    assert sorted(r.value for r in read.collect()) == sorted(docs)
    files = read.inputFiles()
    assert len(files) == 3 and all(f.endswith(".gz") for f in files)


def test_a_micro_batch_is_held_compressed_and_goes_with_it(spark, monkeypatch):
    line = {"id": 1, "product_id": "4", "timestamp": "2024-03-04T09:01:00", "pieces_or_weight": 1.0, "sales_price": 0.0, "was_voided": True}
    held, screened = [], screening.screen_requests

    def screen_requests(parsed, *args):
        held.extend(parsed.inputFiles())
        return screened(parsed, *args)

    monkeypatch.setattr(screening, "screen_requests", screen_requests)
    res, rejects = _stream(spark, [_doc(1, [line]), "{not json"], spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA), "held")
    assert [r["transaction_id"] for r in res] == ["1"] and rejects == ["malformed JSON"]
    assert held and all(f.endswith(".zstd.parquet") for f in held)
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in held)
