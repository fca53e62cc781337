"""Eliminations and Newton screens against dense solutions of the same problems."""

import math

import numpy as np
import pytest

from tillsight.functions.special import t_two_sided
from tillsight.operators import models as ML
from tillsight.operators import regression as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 600
    x = rng.normal(size=(n, 4)) * [1, 50, 0.1, 1] + [0, 1000, 5, 0]
    y = 2 + 3 * x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=n)
    label = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + 1.2 * x[:, 0])))).astype(float)
    split = np.where(np.arange(n) % 5 == 0, "test", "train")
    rows = [(*map(float, r), 3.0, float(2 * r[0]), float(t), float(b), s, None) for r, t, b, s in zip(x, y, label, split)] + [(None, 1.0, 1.0, 1.0, 3.0, 1.0, 1.0, 1.0, "train", "n")]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, constant double, twice double, y double, label double, split string, extra string")
    return df.repartition(3), x, y, label, split


def dense_ols(x, y):
    z = np.column_stack([np.ones(len(y)), x])
    inverse = np.linalg.inv(z.T @ z)
    beta = inverse @ z.T @ y
    error = ((y - z @ beta) ** 2).sum()
    dof = len(y) - z.shape[1]
    t = beta / np.sqrt(inverse.diagonal() * error / dof)
    return beta, [t_two_sided(float(v), float(dof)) for v in t[1:]], 1 - error / ((y - y.mean()) ** 2).sum()


def test_ols_elimination_equals_refitting(table):
    df, x, y, _, split = table
    steps = R.eliminate_ols(df, ["a", "b", "c", "d", "constant", "twice"], "y")
    left = [0, 1, 2, 3]  # the constant and the collinear column never enter
    train, test = split == "train", split == "test"
    for features, worst, p, r2_train, r2_test in steps:
        assert features == ["abcd"[i] for i in left]
        beta, ps, r2 = dense_ols(x[train][:, left], y[train])
        assert worst == "abcd"[left[int(np.argmax(ps))]] and abs(p - max(ps)) < 1e-7 and abs(r2 - r2_train) < 1e-9
        residual = y[test] - beta[0] - x[test][:, left] @ beta[1:]
        assert abs(r2_test - (1 - (residual**2).sum() / ((y[test] - y[test].mean()) ** 2).sum())) < 1e-9
        left.remove("abcd".index(worst))
    assert steps[-1][0] == ["a", "b"] and steps[-1][2] < 0.05


def test_degree_two_terms(table):
    df, x, y, _, split = table
    names, factors = R.polynomial_terms(["a", "b"], 2)
    assert names == ["a", "b", "a^2", "a b", "b^2"] and R.polynomial_terms(["a", "b"], 2, True)[0] == ["a", "b", "a b"]
    step = R.eliminate_ols(df, ["a", "c"], "y", degree=2)[0]
    train = split == "train"
    a, c = x[train, 0], x[train, 2]
    assert step[0] == ["a", "c", "a^2", "a c", "c^2"]
    assert abs(step[3] - dense_ols(np.column_stack([a, c, a * a, a * c, c * c]), y[train])[2]) < 1e-6


def dense_logit(x, y):
    z = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        h = (z * (p * (1 - p))[:, None]).T @ z
        beta = beta + np.linalg.solve(h, z.T @ (y - p))
    return beta, np.linalg.inv(h)


def test_logit_elimination_and_screen(table):
    df, x, _, label, split = table
    train = split == "train"
    steps = R.eliminate_logit(df, ["a", "c", "d"], "label")
    beta, inverse = dense_logit((x[train][:, [0, 2, 3]] - x[train][:, [0, 2, 3]].mean(0)), label[train])
    z = np.abs(beta[1:]) / np.sqrt(inverse.diagonal()[1:])
    assert steps[0][1] == "acd"[int(np.argmin(z))] and abs(steps[0][2] - math.erfc(z.min() / math.sqrt(2))) < 1e-6
    assert steps[-1][0] == ["a"] and steps[-1][2] < 0.05
    rows = {r.feature: r for r in R.logit_screen(df.withColumn("inside", (df.label > 0.5).cast("int")), ["a", "b", "constant", "inside"], "label").collect()}
    for i, c in enumerate("ab"):
        beta, _ = dense_logit(x[train, i] - x[train, i].mean(), label[train])
        margin = beta[0] + beta[1] * (x[train, i] - x[train, i].mean())
        ll = (label[train] * margin - np.logaddexp(0, margin)).sum()
        p = label[train].mean()
        none = len(margin) * (p * math.log(p) + (1 - p) * math.log(1 - p))
        assert abs(rows[c].coefficient - beta[1]) < 1e-6 and abs(rows[c].pseudo_r2_train - (1 - ll / none)) < 1e-9
    assert not rows["a"].perfect_separation and rows["inside"].perfect_separation and rows["constant"].coefficient is None


def test_side_by_side_keeps_order_and_weights_reach_the_fit(spark):
    assert ML.side_by_side(spark, [lambda i=i: spark.range(i + 1).count() for i in range(12)]) == list(range(1, 13))
    rows = [(i, int(i % 10 == 0), float(i % 10 == 0) * 7, float(i % 7)) for i in range(400)]
    data = spark.createDataFrame(rows, "transaction_id long, y int, damage double, x double")
    mean = lambda w: ML.fit_classifier(data, "logistic", ["x"], weights=w).transform(data).select(ML.proba().alias("p")).agg({"p": "avg"}).first()[0]
    assert abs(mean(None) - 0.1) < 1e-3 and abs(mean("balanced") - 0.5) < 1e-2 and abs(mean("damage") - 5 / 14) < 1e-2


def test_fitted_threshold_is_saved_with_the_model(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(i, int(i % 4 == 0), 20.0 * (i % 4 == 0), float((i % 4 == 0) * 3 + i % 5)) for i in range(400)]
    data = spark.createDataFrame(rows, "transaction_id long, y int, damage double, x double")
    model = ML.fit_classifier(data, "decision_tree", ["x"], threshold=True)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    low, high = again.stages[-1].getThresholds()
    assert abs(low + high - 1) < 1e-9 and 0 < high < 1
    scored = again.transform(data).select("prediction", ML.proba().alias("p")).collect()
    assert all(r.prediction == float(r.p > high) for r in scored if abs(r.p - high) > 1e-9)


def test_random_draws_are_reproducible_and_inside_their_space():
    first, again = ML.draw(ML.SEARCH_SPACE, 20), ML.draw(ML.SEARCH_SPACE, 20)
    assert first == again != ML.draw(ML.SEARCH_SPACE, 20, seed=1) and len({str(x) for x in first}) == 20
    assert all(low <= s[p] <= high for s in first for p, (_, low, high) in ML.SEARCH_SPACE.items())
