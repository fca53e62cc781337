"""The registered model queries cover every model, fold and column; the encoder's categories are bounded."""

import duckdb
import pyarrow as pa
import pytest

from tests.conftest import SF_SMALL
from tillsight.operators import encode
from tillsight.operators import models as ML
from tillsight.plans import QUERIES
from tillsight.plans.q_models import MODEL_COLS


def small(spark, n=150):
    rows = [(i, int(i % 5 == 0), float(i % 5 == 0) * (1 + i % 9), float((i % 5 == 0) * 2 + i % 7), float(i % 11)) for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id long, y int, damage double, x double, z double")


def test_comparison_runs_every_model_and_its_metrics_are_those_of_its_scores(spark):
    """The whole factory, fitted side by side; the metrics are recounted from the written scores by DuckDB."""
    scores = ML.cross_validated_scores(small(spark), ["x", "z"], ML.FACTORY, k=2, repeats=1)
    got = {(r.model, r.repeat, r.fold): r for r in ML.fold_table(scores).collect()}
    assert set(got) == {(m, 0, f) for m in ML.FACTORY for f in (0, 1)}
    con = duckdb.connect()
    con.register("scores", pa.Table.from_pylist([r.asDict() for r in scores.collect()]))
    want = con.execute("""
        WITH cut AS (SELECT model, repeat, fold, p, sum(y) AS pos, count(*) AS n FROM scores GROUP BY ALL),
        run AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged FROM cut WINDOW w AS (PARTITION BY model, repeat, fold ORDER BY p DESC)),
        ap AS (SELECT model, repeat, fold, sum(pos * tp / flagged::DOUBLE) / sum(pos) AS auc_pr FROM run GROUP BY ALL)
        SELECT s.model, s.repeat, s.fold, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
          count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn, any_value(auc_pr) AS auc_pr,
          5 * count(*) FILTER (WHERE y = 1 AND yhat = 1) - 10 * count(*) FILTER (WHERE y = 0 AND yhat = 1)
            - coalesce(sum(damage) FILTER (WHERE y = 1 AND yhat = 0), 0) AS value
        FROM scores s JOIN ap USING (model, repeat, fold) GROUP BY s.model, s.repeat, s.fold""").fetchall()
    assert len(want) == len(got)
    for model, repeat, fold, tp, fp, fn, tn, auc_pr, value in want:
        r = got[model, repeat, fold]
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn) and abs(r.auc_pr - auc_pr) < 1e-9 and abs(r.business_value - value) < 1e-9
        assert tp + fp + fn + tn == 75
    table = ML.compare_models(ML.fold_table(scores))
    assert set(table.columns) == {"metric", "statistic", *ML.FACTORY} and table.count() == 4 * len(ML.COMPARED)


def test_forest_keeps_the_nodes_of_its_rows_and_stays_the_same(spark):
    rows = ML.assemble(["x", "z"]).transform(small(spark)).select("y", "features")
    _, kept = ML.make_classifier("random_forest")
    assert kept.getCacheNodeIds()
    walked = kept.copy({kept.cacheNodeIds: False})
    nodes = [[t.toDebugString.split("\n", 1)[1] for t in forest.fit(rows).trees] for forest in (kept, walked)]
    assert len(nodes[0]) == 100 and nodes[0] == nodes[1]


def test_search_begins_its_longest_fits_first_and_keeps_the_order_of_its_settings(spark, monkeypatch):
    settings, begun = [{"maxIter": n, "maxDepth": 2} for n in (1, 3, 2)], []
    fit = ML.Pipeline.fit
    monkeypatch.setattr(ML.Pipeline, "fit", lambda self, rows: begun.append(self.getStages()[-1].getMaxIter()) or fit(self, rows))
    monkeypatch.setattr(ML, "side_by_side", lambda spark, jobs: [job() for job in jobs])
    got = ML.search(small(spark), small(spark, 60), ["x", "z"], "boosted_trees", settings).orderBy("trial").collect()
    assert begun == [3, 3, 2, 2, 1, 1]
    assert [(r.trial, r.params) for r in got] == [(i, str(sorted(x.items()))) for i, x in enumerate(settings)]
    for r, x in zip(got, settings):
        alone = ML.search(small(spark), small(spark, 60), ["x", "z"], "boosted_trees", [x]).first()
        assert tuple(alone)[1:] == tuple(r)[1:]


def test_files_of_one_size_keep_their_order_in_a_training_table(spark):
    orders = {tuple(r.transaction_id for r in ML.training_table(small(spark), "in-order").collect()) for _ in range(6)}
    assert len(orders) == 1


def test_creators_and_ablation(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier

    made = []

    def create():
        made.append(1)
        return Pipeline(stages=[DecisionTreeClassifier(labelCol="y", maxDepth=2)])

    scores = ML.cross_validated_scores(small(spark, 60), ["x", "z"], {"mine": create}, k=3, repeats=2)
    assert len(made) == 6 and scores.groupBy("repeat").count().collect()[0]["count"] == 60 and scores.select("model").distinct().collect()[0][0] == "mine"
    for model in ("decision_tree", "logistic"):
        rows = {r.feature: r for r in ML.ablate(small(spark, 60), ["x", "z"], model, k=2).collect()}
        assert set(rows) == {"x", "z"} and all(r["drop"] == (r.value_without >= r.value_full) for r in rows.values())


def test_cross_validation_gives_a_row_for_each_fold(spark):
    rows = [(i, i % 2, float(i % 2), float(i % 7)) for i in range(60)]
    data = spark.createDataFrame(rows, "transaction_id long, y int, damage double, x double")
    got = ML.cross_validate(data, ["x"], ["decision_tree", "naive_bayes"], k=2, repeats=2).collect()
    assert sorted((r.model, r.repeat, r.fold) for r in got) == [(m, r, f) for m in ("decision_tree", "naive_bayes") for r in (0, 1) for f in (0, 1)]


def test_logit_screen_has_a_row_for_each_column(spark):
    assert sorted(r.feature for r in QUERIES["logit_screen"](spark, SF_SMALL).collect()) == sorted(MODEL_COLS)


def test_a_column_of_ids_is_no_category(spark):
    ids = spark.range(encode.MAX_CATEGORIES + 1).selectExpr("cast(id as string) as a", "cast(id % 3 as string) as b")
    with pytest.raises(ValueError, match="values in a"):
        encode.category_lists(ids, ["a", "b"])
    least = encode.category_lists(ids.where("a != '0'"), ["a", "b"])
    assert len(least["a"]) == encode.MAX_CATEGORIES and least["b"] == ["0", "1", "2"]


def test_final_models_score_raw_rows_after_loading(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(i, int(i % 4 == 0), 3.0 * (i % 4 == 0), float(i % 7) if i % 9 else None, i % 3 == 0, ["it's", "b c", None, "d\\"][i % 4]) for i in range(80)]
    schema = "transaction_id long, y int, damage double, amount double, flag boolean, medium string"
    data = spark.createDataFrame(rows, schema)
    clf, reg = ML.train_final(data, str(tmp_path))
    want = sorted(tuple(r) for r in ML.score(data, clf, reg).collect())
    other = spark.newSession()
    again = [PipelineModel.load(f"{tmp_path}/{name}") for name in ("classifier", "regressor")]
    raw = other.createDataFrame(rows + [(900, 0, 0.0, 1.0, None, "never seen")], schema)
    got = sorted(tuple(r) for r in ML.score(raw, *again).collect())
    assert got[:-1] == want and len(got) == 81
    encoder = encode.BasketEncoder(drop_first=True).fit(data, ("transaction_id", "y", "damage"))
    stage, names = encoder.stage()
    row = stage.transform(data.where("transaction_id = 0")).select(*names).first()
    assert len(names) == len(encoder.columns_) and dict(zip(encoder.columns_, row))["medium_it_s"] == 1.0
