"""Operators 1 and 3: held-out accuracy and defined cases."""

import pytest
from pyspark.sql import functions as F

from tillsight.llm import quality, queries, toxicity
from tillsight.llm.common import held_out

SF = "/root/testdata/sf0.01"


def checked(spark, name, label):
    rows = queries.QUERIES[name](spark, SF).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count() and rows.where("score is null or score < 0 or score > 1").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = rows.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return [(r[0], r[1]) for r in out]


def test_quality_on_held_out_rows(spark):
    pairs = checked(spark, "op1_rule_ensemble", "quality")
    assert len(pairs) > 50 and sum(p == y for p, y in pairs) / len(pairs) > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and toxic is not null")
    by = {r["lang"]: r for r in rows.groupBy("lang").agg(
        F.sum("toxic").alias("toxic"), F.sum(F.col("toxic") * F.col("predicted")).alias("caught"),
        F.sum((1 - F.col("toxic")) * F.col("predicted")).alias("alarms"), F.sum(1 - F.col("toxic")).alias("clean"),
    ).collect()}
    total = lambda name: sum(r[name] for r in by.values())
    assert total("caught") / total("toxic") >= 0.8 and total("alarms") / total("clean") <= 0.01
    assert all(r["caught"] / r["toxic"] >= 0.5 for r in by.values()), by


def test_toxicity_scores_vary_where_labels_are_few(spark):
    rows = queries.QUERIES["op3_nb_char_ngrams"](spark, "/root/testdata/sf0.001")
    assert rows.select("score").distinct().count() > 50 and rows.where("predicted = 1").count() > 0


def test_feature_counts_and_ratios_are_those_of_the_texts(spark):
    import math
    from collections import Counter

    import numpy as np

    texts = [(f"Bad {w} naïve 日本 {i % 7}" if i % 3 else f"good {w} day {i % 5}", int(i % 3 > 0)) for i, w in enumerate(["ab", "", "zz zz", "ÄB"] * 20)]
    want, sizes = Counter(), np.zeros((toxicity.FOLDS, 2))
    for text, label in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        grams = {low[i : i + n] for n in toxicity.ORDERS for i in range(len(low) - n + 1)}
        features = {int(f) for g in grams for f in toxicity.NGrams().of(g) if len(g) in toxicity.ORDERS}
        assert {int(f) for f in toxicity.NGrams().of(text)} == features  # n-grams of a text are those of its parts
        for f in {*features, -1}:
            want[f, toxicity.fold_of(text), label] += 1
        sizes[toxicity.fold_of(text), label] += 1
    counts = toxicity.feature_counts(spark.createDataFrame(texts, "text string, label int"))
    got = {r["feature"]: r for r in counts.withColumn("ratio", toxicity.log_ratio([0, 1, 2], sizes)).collect()}
    assert {f for f, _, _ in want} == set(got)
    n0, n1 = sizes.sum(axis=0)
    for f, r in got.items():
        by = [sum(want[f, fold, c] for fold in range(3)) for c in (0, 1)]
        assert all(r[f"{'ab'[c]}{fold}"] == want[f, fold, c] for fold in range(3) for c in (0, 1))
        ratio = math.log((by[1] + 30 * n1 / (n0 + n1)) / n1) - math.log((by[0] + 30 * n0 / (n0 + n1)) / n0)
        assert abs(r["ratio"] - (ratio if sum(by) >= 3 and abs(ratio) >= 0.5 else 0)) < 1e-9


def test_held_out_is_the_stated_remainder(spark):
    import zlib

    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_are_never_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"some words number {i} " + ("bad bad bad" if i % 2 else "fine day")) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_a_toxicity_model_does_not_hang_on_the_order_of_its_rows():
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    ratios = SimpleNamespace(value=np.random.default_rng(1).normal(size=(4, 1 << toxicity.HASH_BITS)).astype(np.float32))
    rows = pa.table({"text": [f"some words number {i * i}, {'bad' * (i % 3)}" for i in range(90)], "label": pa.array([i % 2 for i in range(90)], pa.int32())})
    batches = [*toxicity._rows_for_models(ratios)(iter(rows.to_batches(max_chunksize=7)))]
    first, again = ({r["model"][0]: r for r in (b.to_pydict() for b in toxicity._fitted(ratios)(iter(x)))} for x in (batches, batches[::-1]))
    assert len(first) == 4 and first == again


@pytest.mark.parametrize("module", [quality, toxicity])
def test_defined_cases(spark, module):
    label = "quality" if module is quality else "toxic"
    texts = ["", None, " ", "x" * 300000, "same text", "same text", "é ß"] + ["good plain words here"] * 80 + ["@@@ ### !!!"] * 80
    docs = spark.createDataFrame([(i, t, "c", 0.5) for i, t in enumerate(texts)] + [(None, "no id", None, None)], "doc_id long, text string, label string, upper double")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    rows = module.scored(docs, none).collect()
    assert len(rows) == len(texts) + 1 and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(i, int(i < 87)) for i in range(7, 167)] + [(8, None), (None, 1), (9, 0), (999, 1)], f"doc_id long, {label} int")
    rows = module.scored(docs, some).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[0].score == by[1].score and by[4].score == by[5].score and by[10].score > by[100].score
    kept = module.clean(docs, some)
    assert kept.columns == docs.columns
    empty = docs.limit(0)
    assert module.scored(empty, some).count() == 0 and module.clean(empty, none).count() == 0


def test_rules_are_conjunctions_of_bounds(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 400
    for rule, weight in model.rules:
        assert weight != 0 and len({(n, s) for n, s, _ in rule}) == len(rule)
        assert all(n in quality.STATISTICS and s in ("<=", ">") for n, s, _ in rule)
