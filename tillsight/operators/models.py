"""Spark ML models.

Scores are not expected to equal the reference's libraries (XGBoost,
LightGBM, sklearn); the operators reproduce the *workflow*: classifier
factory, damage regressor, cost-based decision, calibration, parameter search,
repeated stratified cross-validation, ablation and persistence.  Every fit is
a distributed Spark ML job; independent fits run side by side in driver threads
that share the cluster, and their rows are cut from one written frame with
assembled features, so lost executors recompute from that.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.operators import evaluate as V
from tillsight.operators import regression as R
from tillsight.operators import sampling as O
from tillsight.operators.encode import BasketEncoder
from tillsight.operators.rules import decide

FEATURES = "features"


def assemble(cols: Sequence[str], out: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


def model_frame(df: DataFrame, cols: Sequence[str], key: str = "transaction_id", keep: Sequence[str] = ()) -> DataFrame:
    """Numeric model input: nulls -> 0 (trees in Spark ML do not route NaN); the columns ``keep`` go along."""
    return df.select(key, "y", "damage", *keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


# ---------------------------------------------------------------- M1 / M7 / X2
FACTORY = ("logistic", "decision_tree", "random_forest", "boosted_trees", "naive_bayes")


def make_classifier(name: str, seed: int = 42, weight_col: str | None = None):
    """M1 (+M7): classifier factory as (stages before the model, model); every model takes the weight column."""
    if name == "logistic":
        pre, model = [RobustScaler(inputCol=FEATURES, outputCol="scaled")], LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=200, regParam=0.0)
    elif name == "decision_tree":
        pre, model = [], DecisionTreeClassifier(labelCol="y", maxDepth=8, seed=seed)
    elif name == "random_forest":
        # the node of each row in each tree is kept, so a level does not walk 100 trees from their roots; the forest is the same
        pre, model = [], RandomForestClassifier(labelCol="y", numTrees=100, maxDepth=8, seed=seed, cacheNodeIds=True)
    elif name == "boosted_trees":
        pre, model = [], GBTClassifier(labelCol="y", maxIter=100, maxDepth=5, stepSize=0.1, seed=seed)
    elif name == "naive_bayes":
        pre, model = [], NaiveBayes(labelCol="y", modelType="gaussian")
    else:
        raise ValueError(name)
    return pre, model.setWeightCol(weight_col) if weight_col else model


def classifier_pipeline(name: str, cols: Sequence[str], seed: int = 42, weight_col: str | None = None) -> Pipeline:
    pre, model = make_classifier(name, seed, weight_col)
    return Pipeline(stages=[assemble(cols), *pre, model])


#: M4: weightings of the training rows by name; each adds the column ``weight``.
WEIGHTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "balanced": lambda df: V.balanced_weights(df, "y"),
    "damage": lambda df: df.withColumn("weight", V.damage_weights(df)),
}


def fit_classifier(train: DataFrame, name: str, cols: Sequence[str], seed: int = 42, weights: str | None = None,
                   threshold: bool = False) -> PipelineModel:
    """M1 + M4 + M2: a classifier of the factory, weighted and with a fitted threshold if asked for.

    The threshold is the one of V7 with the best business value on the training
    rows; it becomes the model's own ``thresholds``, so it is saved, loaded and
    applied (column ``prediction``) with it.
    """
    rows = WEIGHTS[weights](train) if weights else train
    model = classifier_pipeline(name, cols, seed, "weight" if weights else None).fit(rows)
    if threshold:
        scores = model.transform(train).select("y", "damage", proba().alias("p"))
        t = min(float(V.best(V.threshold_sweep(scores)).first()["threshold"]), 1 - 1e-9)
        model.stages[-1].setThresholds([1 - t, t])
    return model


def proba(col: str = "probability") -> Column:
    return vector_to_array(F.col(col))[1]


# ---------------------------------------------------------------- X1 selectors
def select_all(df: DataFrame) -> DataFrame:
    return df


def select_balanced(df: DataFrame, seed: int = 42) -> DataFrame:
    return O.balanced(df, F.col("damage") > 0, "transaction_id", seed)


def select_damage_only(df: DataFrame) -> DataFrame:
    return O.damage_only(df)


SELECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "all": select_all, "balanced": select_balanced, "damage_only": select_damage_only,
}


# ---------------------------------------------------------------- M3
def fit_regressor(df: DataFrame, cols: Sequence[str], selector: str = "damage_only", seed: int = 42,
                  max_iter: int = 100, max_depth: int = 5) -> PipelineModel:
    """M3: gradient-boosted damage regressor on the selected rows."""
    rows = SELECTORS[selector](df)
    pipe = Pipeline(stages=[assemble(cols), GBTRegressor(labelCol="damage", maxIter=max_iter, maxDepth=max_depth, seed=seed)])
    return pipe.fit(rows)


# ---------------------------------------------------------------- M2
def score(df: DataFrame, clf: PipelineModel, reg: PipelineModel | None = None, cost_fp: float = 10.0, gain_tp: float = 5.0,
          key: str = "transaction_id") -> DataFrame:
    """M2: probability, predicted damage and the M5 cost decision per row."""
    s = clf.transform(df).select(key, "y", "damage", proba().alias("p"), *[c for c in df.columns if c not in (key, "y", "damage")])
    if reg is not None:
        s = reg.transform(s).select(key, "y", "damage", "p", F.col("prediction").alias("damage_pred"))
    else:
        s = s.withColumn("damage_pred", F.lit(0.0))
    return s.select(key, "y", "damage", "p", "damage_pred", decide("p", "damage_pred", cost_fp, gain_tp).cast("int").alias("yhat"))


# ---------------------------------------------------------------- M6
def fit_combined(train: DataFrame, cols: Sequence[str], seed: int = 42, malus_factor: float = 1.3, rows: str = "all"):
    """M6: classifier + damage regressor + fitted malus (best V8 malus on train × factor).

    The regressor learns from ``rows`` of the training set: from all of them
    it predicts the expected damage, from "damage_only" the damage given one.
    """
    clf = classifier_pipeline("decision_tree", cols, seed).fit(train)
    reg = fit_regressor(train, cols, rows, seed)
    s = score(train, clf, reg)
    best = V.best(V.malus_sweep(s)).first()
    return clf, reg, float(best["malus"]) * malus_factor


# ---------------------------------------------------------------- M8
def out_of_fold_scores(train: DataFrame, name: str, cols: Sequence[str], k: int = 3, seed: int = 42, key: str = "transaction_id") -> DataFrame:
    """Scores of every training row by a model fitted on the folds it is not in."""
    from tillsight.session import cut_lineage

    fold = O.folds(train.withColumn("_s", F.col("y")), ["_s"], key, k, 1, seed).select(key, "fold")
    base = cut_lineage(train.join(fold, key))
    out = None
    for f in range(k):
        model = classifier_pipeline(name, cols, seed).fit(base.where(F.col("fold") != f))
        part = score(base.where(F.col("fold") == f), model)
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(fitting: DataFrame, scores: DataFrame, method: str = "sigmoid") -> DataFrame:
    """M8: ``scores`` with calibrated probabilities ('sigmoid', 'isotonic', 'none').

    The map is fitted on ``fitting`` (p, y), out-of-fold scores of the training
    rows, never on the rows it is applied to.  Equal scores are pooled before
    the isotonic fit, whose last step is one task.
    """
    if method == "none":
        return scores.withColumn("p_cal", F.col("p"))
    x = assemble(["p"], "pf").transform(scores)
    fitting = fitting.groupBy("p").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w")) if method == "isotonic" else fitting
    learn = assemble(["p"], "pf").transform(fitting)
    if method == "sigmoid":
        m = LogisticRegression(featuresCol="pf", labelCol="y", regParam=0.0, predictionCol="_pred", probabilityCol="_prob",
                               rawPredictionCol="_raw").fit(learn)
        return m.transform(x).withColumn("p_cal", proba("_prob")).drop("pf", "_pred", "_prob", "_raw")
    if method == "isotonic":
        m = IsotonicRegression(featuresCol="pf", labelCol="y", predictionCol="p_cal", weightCol="w").fit(learn)
        return m.transform(x).drop("pf")
    raise ValueError(method)


# ---------------------------------------------------------------- side by side
#: Rows of a training table per partition: the many short jobs of a fit have no more tasks than the rows fill.
ROWS_PER_TASK = 250_000
THREADS = 8


def side_by_side(spark, jobs: Sequence[Callable], threads: int = THREADS) -> list:
    """Run independent driver calls in threads that keep the session's properties; results in order.

    Under ``spark.scheduler.mode=FAIR`` their jobs share a pool of their own.
    """
    from pyspark import inheritable_thread_target

    sc = spark.sparkContext

    def of(job: Callable) -> Callable:
        def run():
            sc.setLocalProperty("spark.scheduler.pool", "model-fits")
            try:
                return job()
            finally:
                sc.setLocalProperty("spark.scheduler.pool", None)

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        return [f.result() for f in [pool.submit(of(job)) for job in jobs]]


def training_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in as many partitions as its rows fill, for the many passes of model fits.

    Files are read by falling size; those of one size come as the file system
    lists them, so they are put in order: sums of floats hang on it.
    """
    from tillsight.session import cut_lineage

    rows = cut_lineage(df, name)
    parts = 1 + rows.count() // ROWS_PER_TASK
    if rows.rdd.getNumPartitions() <= parts:
        return rows
    place = {f"_{c}": F.col(f"_metadata.{c}") for c in ("file_size", "file_name", "row_index")}
    in_order = rows.withColumns(place).coalesce(parts).sortWithinPartitions(F.desc("_file_size"), "_file_name", "_row_index")
    return cut_lineage(in_order.drop(*place), name)


#: Least rows of a task of a fit over many columns; fewer are not worth one.
LEAST_ROWS = 25_000


def fit_table(df: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` (of ``n`` rows) written for a fit that has the cluster to itself, so that its many passes use every core.

    A file holds a core's share of the rows (a tenth more, so that parts of
    about that size stay whole), at most ``ROWS_PER_TASK``, and is one partition:
    read the session's way, small files are put together, and what is cached of
    a partition grows with the input.
    """
    from tillsight.session import scratch_table

    spark = df.sparkSession
    cores, tasks = spark.sparkContext.defaultParallelism, 1 + n // LEAST_ROWS
    share = max(n // cores, LEAST_ROWS) * 11 // 10
    path = scratch_table(spark, name)
    (df.coalesce(tasks) if tasks < cores else df).write.option("maxRecordsPerFile", min(share, ROWS_PER_TASK)).parquet(path)
    reader = spark.newSession()  # settings of its own
    reader.conf.set("spark.sql.files.openCostInBytes", reader.conf.get("spark.sql.files.maxPartitionBytes"))
    return reader.read.parquet(path)


# ---------------------------------------------------------------- M9
#: Spaces of the random draws: (low, high) of a whole or real number, drawn evenly or by logarithm.
SEARCH_SPACE: dict[str, tuple] = {
    "maxIter": ("whole", 10, 60), "maxDepth": ("whole", 2, 8), "stepSize": ("log", 0.02, 0.5), "subsamplingRate": ("real", 0.5, 1.0),
    "minInstancesPerNode": ("whole", 1, 20), "maxBins": ("whole", 16, 64), "minInfoGain": ("log", 1e-6, 1e-2),
}


def draw(space: Mapping[str, tuple], trials: int, seed: int = 42) -> list[dict]:
    """M9: ``trials`` random settings of a space; the same seed draws the same."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        setting = {}
        for p, (kind, low, high) in space.items():
            if kind == "whole":
                setting[p] = int(rng.integers(low, high + 1))
            else:
                setting[p] = float(np.exp(rng.uniform(np.log(low), np.log(high))) if kind == "log" else rng.uniform(low, high))
        out.append(setting)
    return out


def search(train: DataFrame, valid: DataFrame, cols: Sequence[str], name: str, settings: Sequence[Mapping], seed: int = 42) -> DataFrame:
    """M9: one trial per setting, its classifier scored by business value and the damage regressor of the same setting by R²; a row each.

    Both fits of a setting are jobs of their own; those of the most rounds and
    levels begin first, so that none of these is left to run alone at the end.
    """
    spark = train.sparkSession
    train, valid = training_table(train, "search-train"), training_table(valid, "search-valid")

    def classifier(setting: Mapping) -> Callable:
        def run() -> tuple:
            pre, est = make_classifier(name, seed)
            model = Pipeline(stages=[assemble(cols), *pre, est.copy({est.getParam(p): v for p, v in setting.items() if est.hasParam(p)})]).fit(train)
            m = V.evaluate(score(valid, model)).first()
            return float(m["business_value"]), float(m["precision"]), float(m["recall"])

        return run

    def regressor(setting: Mapping) -> Callable:
        def run() -> tuple:
            reg = GBTRegressor(labelCol="damage", seed=seed)
            reg = reg.copy({reg.getParam(p): v for p, v in setting.items()})
            fitted = Pipeline(stages=[assemble(cols), reg]).fit(select_damage_only(train))
            r2 = V.regression_metrics(fitted.transform(select_damage_only(valid)).withColumnRenamed("prediction", "damage_pred")).first()["r2"]
            return (None if r2 is None else float(r2),)

        return run

    fits = [(i, of) for i in range(len(settings)) for of in (classifier, regressor)]
    fits.sort(key=lambda fit: -settings[fit[0]].get("maxIter", 1) * (1 + settings[fit[0]].get("maxDepth", 1)))
    found = dict(zip(fits, side_by_side(spark, [of(settings[i]) for i, of in fits])))
    rows = [(i, str(sorted(x.items())), *found[i, classifier], *found[i, regressor]) for i, x in enumerate(settings)]
    return spark.createDataFrame(rows, "trial int, params string, business_value double, precision double, recall double, r2 double")


def best_trials(trials: DataFrame) -> DataFrame:
    """M9: the best trial by either objective (ties: the earliest)."""
    best = lambda c: F.max_by(F.struct("trial", c), F.struct(F.col(c), -F.col("trial")))
    wide = trials.agg(best("business_value").alias("b"), best("r2").alias("r"))
    row = lambda name, c, value: F.struct(F.lit(name).alias("objective"), F.col(c)["trial"].alias("trial"), F.col(c)[value].alias("value"))
    return wide.select(F.inline(F.array(row("business_value", "b", "business_value"), row("r2", "r", "r2"))))


# ---------------------------------------------------------------- M10 / M11
def cross_validated_scores(data: DataFrame, cols: Sequence[str], models: Sequence[str] | Mapping[str, Callable[[], Pipeline]], k: int = 5,
                           repeats: int = 1, seed: int = 42, key: str = "transaction_id", threads: int = THREADS) -> DataFrame:
    """M10 + X2: scores of every row by models that have not seen its fold (model, repeat, fold, key, y, damage, p, yhat).

    ``models`` are names of the factory, or names and what creates an unfitted
    pipeline over the assembled column ``features``.  The rows and their folds
    are written once, features assembled; all fits run side by side.
    """
    from tillsight.session import scratch_table

    spark = data.sparkSession
    creators = models if isinstance(models, Mapping) else {m: (lambda m=m: Pipeline(stages=[*(x := make_classifier(m, seed))[0], x[1]])) for m in models}
    folds = O.folds(data.withColumn("_s", F.col("y")), ["_s"], key, k, repeats, seed)
    of_row = folds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("repeat", "fold"))).alias("folds"))  # ``repeats`` entries
    base = training_table(assemble(cols).transform(data.join(of_row, key)).select(key, "y", "damage", FEATURES, "folds.fold"), "folds")
    place = scratch_table(spark, "cv-scores")

    def job(name: str, r: int, f: int) -> Callable:
        def run() -> str:
            own = F.col("fold")[r]
            model = creators[name]().fit(base.where(own != f))
            path = f"{place}/{name}-{r}-{f}"
            out = score(base.where(own == f).select(key, "y", "damage", FEATURES), model)
            out.select(F.lit(name).alias("model"), F.lit(r).alias("repeat"), F.lit(f).alias("fold"), key, "y", "damage", "p", "yhat").write.parquet(path)
            return path

        return run

    order = sorted(creators, key=lambda m: m != "boosted_trees")  # the longest fits begin first
    paths = side_by_side(spark, [job(m, r, f) for m in order for r in range(repeats) for f in range(k)], threads)
    return spark.read.parquet(*paths)


FOLD_KEYS = ("model", "repeat", "fold")


def fold_table(scores: DataFrame) -> DataFrame:
    """The metrics of each (model, repeat, fold), AUC-PR included."""
    return V.evaluate(scores, FOLD_KEYS).join(V.average_precision_by(scores, FOLD_KEYS).withColumnRenamed("average_precision", "auc_pr"), list(FOLD_KEYS))


def cross_validate(data: DataFrame, cols: Sequence[str], models: Sequence[str] | Mapping[str, Callable[[], Pipeline]], k: int = 5, repeats: int = 1,
                   seed: int = 42, key: str = "transaction_id") -> DataFrame:
    """Repeated stratified k-fold CV; per (model, repeat, fold) metrics on the held-out fold."""
    from tillsight.session import cut_lineage

    return cut_lineage(fold_table(cross_validated_scores(data, cols, models, k, repeats, seed, key)), "cv-metrics")


#: The metrics of the comparison table; the last four are the mean confusion matrix.
COMPARED = ("precision", "recall", "f1", "mcc", "auc_pr", "damage_total", "damage_prevented", "damage_missed", "detected_bonus", "fp_penalty",
            "business_value", "tn", "fp", "fn", "tp")


def compare_models(per_fold: DataFrame, metrics: Sequence[str] = COMPARED) -> DataFrame:
    """rows = metric × statistic, columns = model (A34 + pivot)."""
    summ = V.fold_summary(per_fold, ["model"], list(metrics))
    long = summ.unpivot(["model", "metric"], ["mean", "max", "min", "var"], "statistic", "value")
    return long.groupBy("metric", "statistic").pivot("model").agg(F.first("value"))


def ablate(data: DataFrame, cols: Sequence[str], model: str = "decision_tree", k: int = 3, seed: int = 42) -> DataFrame:
    """Leave-one-feature-out CV value vs the full model; drop list = features whose removal does not hurt.

    Each reduced model reads the same assembled vector through a slice, so the
    folds are made and written once and all fits run side by side.
    """
    def without(c: str | None) -> Callable[[], Pipeline]:
        def create() -> Pipeline:
            pre, est = make_classifier(model, seed)
            rest = [i for i, x in enumerate(cols) if x != c]
            first = pre[0].copy({pre[0].inputCol: "kept"}) if pre else None
            return Pipeline(stages=[VectorSlicer(inputCol=FEATURES, outputCol="kept", indices=rest), *([first] if pre else []), est if pre else est.setFeaturesCol("kept")])

        return create

    per_fold = cross_validate(data, cols, {c or "": without(c) for c in (None, *cols)}, k, 1, seed)
    value = per_fold.groupBy("model").agg(F.avg("business_value").alias("value"))
    full = value.where("model = ''").select(F.col("value").alias("value_full"), F.lit(1).alias("_one"))
    reduced = value.where("model != ''").select(F.col("model").alias("feature"), F.col("value").alias("value_without"), F.lit(1).alias("_one"))
    return reduced.join(full, "_one").select("feature", "value_without", "value_full", (F.col("value_without") >= F.col("value_full")).alias("drop"))


# ---------------------------------------------------------------- M13
def train_final(data: DataFrame, path: str, exclude: Sequence[str] = ("transaction_id", "label", "damage", "y"), seed: int = 42,
                rows: str = "all") -> tuple[PipelineModel, PipelineModel]:
    """M13 + S11: fit classifier and regressor on all rows (the latter on ``rows``), encoder included, save and load them again.

    The encoder is fitted on the columns that are not excluded and is the first
    stage of either pipeline, so raw rows can be scored by what is loaded.  Its
    vectors are written once for all passes of both fits.
    """
    encoder = BasketEncoder(drop_first=True).fit(data, exclude)
    encode, names = encoder.stage()
    encoding = [encode, assemble(names)]
    vectors = PipelineModel(encoding).transform(data).select(*[c for c in data.columns if c in exclude], FEATURES)
    table = fit_table(vectors, data.count(), "final-vectors")
    estimators = {
        "classifier": (table, DecisionTreeClassifier(labelCol="y", maxDepth=8, seed=seed)),
        "regressor": (SELECTORS[rows](table), GBTRegressor(labelCol="damage", maxIter=100, maxDepth=5, seed=seed)),
    }

    def job(name: str) -> Callable:
        def run() -> PipelineModel:
            learn, model = estimators[name]
            PipelineModel([*encoding, model.fit(learn)]).write().overwrite().save(f"{path}/{name}")
            return PipelineModel.load(f"{path}/{name}")

        return run

    clf, reg = side_by_side(data.sparkSession, [job("classifier"), job("regressor")])
    return clf, reg


# ---------------------------------------------------------------- T14 / T15 / T16
def reduce_model(rows: DataFrame, target: str, cols: Sequence[str], p_threshold: float = 0.05, family: str = "gaussian", degree: int = 1,
                 interaction_only: bool = False) -> DataFrame:
    """Backward elimination by the largest p-value until all p < threshold (OLS or logit), a row for each step.

    ``rows`` has a column ``split``; the model is fitted on its train rows and
    scored (R² or accuracy) on both.
    """
    gaussian = family == "gaussian"
    steps = (R.eliminate_ols if gaussian else R.eliminate_logit)(rows, cols, target, p_threshold, degree, interaction_only)
    found = [(i, ", ".join(features), worst, p, "r2" if gaussian else "accuracy", *scores) for i, (features, worst, p, *scores) in enumerate(steps)]
    schema = "step int, features string, worst_feature string, worst_p double, score_name string, score_train double, score_test double"
    return rows.sparkSession.createDataFrame(found, schema)


def pca_variance(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Explained variance ratio of k components on standardised columns (population std)."""
    x = assemble(cols, "raw").transform(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]))
    sx = StandardScaler(inputCol="raw", outputCol="std", withMean=True, withStd=True).fit(x).transform(x)
    m = PCA(k=k, inputCol="std", outputCol="pc").fit(sx)
    ev = [float(v) for v in m.explainedVariance]
    return df.sparkSession.createDataFrame([(i + 1, v, float(np.cumsum(ev)[i])) for i, v in enumerate(ev)],
                                           "component int, explained_variance double, cumulative double")


# ---------------------------------------------------------------- X3
def score_external(df: DataFrame, cols: Sequence[str], predict: Callable[[np.ndarray], np.ndarray], key: str = "transaction_id") -> DataFrame:
    """Apply an externally trained model to Arrow batches (mapInPandas), one block per batch."""
    schema = T.StructType([df.schema[key], T.StructField("p", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            x = pdf[list(cols)].astype("float64").fillna(0.0).to_numpy()
            yield pd.DataFrame({key: pdf[key], "p": predict(x)})

    return df.select(key, *cols).mapInPandas(run, schema)
