"""Toxicity: character n-gram linear classifier with naive Bayes log-count ratios (operator 3).

A text's features are its distinct n-grams of ``ORDERS`` characters (A-Z as
a-z), hashed to 2^``HASH_BITS``.  Each is scaled by the log ratio of its share
among toxic and other training texts, both smoothed by ``PRIOR`` texts that
have it as often as training texts are of the class, so an n-gram met once says
little; ratios below ``LEAST_RATIO``, which say nothing yet, count as 0.  A
text's vector is brought to length one, so long texts do not add up noise, and a
logistic regression of balanced classes is fitted on it.

The score is calibrated on the training rows: models fitted without one of
``FOLDS`` folds (ratios included) give its rows a margin; the slope is fitted to
these margins, and the threshold 0.7 is put where ``FALSE_ALARMS`` of the clean
ones lie above it.

Training reads at most ``MAX_TRAINING_ROWS`` labelled rows that are not held
out (smallest id hashes first); the models, one for each fold and the last, are
fitted side by side in one task each, and everything that these and the driver
gather is bounded by that number and that of the features.  Scoring reads every whole text in Arrow batches.

Defined cases: null text counts as empty, and an empty text gets the score of
a text without features; with no labelled row, or one class only, every score
is the (smoothed) share of toxic rows; with fewer than ``FOLDS`` rows of a class
the score is not calibrated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.common import byte_slices, held_out, labelled_sample, written

ORDERS = (3, 4, 5, 6, 7)
HASH_BITS = 19
MAX_TRAINING_ROWS = 10_000
PRIOR = 30.0
LEAST_RATIO = 0.5
#: Features of fewer training texts have no ratio.
LEAST_TEXTS = 3
FOLDS = 3
FALSE_ALARMS = 0.008
THRESHOLD = 0.7
REG = 1e-5
ITERATIONS = 60


class NGrams:
    """Distinct features of texts; the table tells apart what a text has had."""

    def __init__(self):
        self.last = np.empty(1 << HASH_BITS, np.int32)

    def of(self, text: str | None) -> np.ndarray:
        chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.where((chars >= 65) & (chars <= 90), chars + np.uint32(32), chars)
        found, h = [], np.full(len(chars), 0x811C9DC5, np.uint32)
        for n in range(1, ORDERS[-1] + 1):
            size = len(chars) - n + 1
            if size <= 0:
                break
            h = (h[:size] ^ chars[n - 1 :]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
            if n in ORDERS:
                found.append(((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS))
        if not found:
            return np.zeros(0, np.int64)
        feature = np.concatenate(found).astype(np.int64)
        place = np.arange(len(feature), dtype=np.int32)
        self.last[feature] = place
        return feature[self.last[feature] == place]


def hash_of(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 5)


def fold_of(text: str | None) -> int:
    return hash_of(text) % FOLDS


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each fold and class that have a feature, summed over a task's rows; feature -1 counts the texts."""
    counts = np.zeros((FOLDS, 2, (1 << HASH_BITS) + 1), np.int32)
    grams = NGrams()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            own = counts[fold_of(text), label]
            own[grams.of(text)] += 1
            own[-1] += 1
    for fold in range(FOLDS):
        seen = np.flatnonzero(counts[fold].sum(axis=0))
        number = np.where(seen == 1 << HASH_BITS, -1, seen).astype(np.int32)
        n0, n1 = (pa.array(counts[fold][c][seen].astype(np.int64)) for c in (0, 1))
        yield pa.record_batch([pa.array(np.full(len(seen), fold, np.int32)), pa.array(number), n0, n1], names=["fold", "feature", "n0", "n1"])


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, a0, b0, a1, b1, ...): texts of the sample (text, label) without and with the label that have a feature, by fold; -1 counts the texts."""
    counted = sample.mapInArrow(_class_counts, "fold int, feature int, n0 long, n1 long")
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(n))).alias(f"{c}{f}") for f in range(FOLDS) for c, n in (("a", "n0"), ("b", "n1"))]
    return counted.groupBy("feature").agg(*by_fold).fillna(0)


def log_ratio(folds: list[int], sizes: np.ndarray) -> Column:
    """Smoothed log ratio of a feature's shares in some folds of ``sizes`` (fold x class) texts; 0 for features that say nothing yet."""
    n0, n1 = (float(sizes[folds, c].sum()) for c in (0, 1))
    c0, c1 = (sum((F.col(f"{c}{f}") for f in folds), F.lit(0)) for c in ("a", "b"))
    ratio = F.log((c1 + PRIOR * n1 / (n0 + n1)) / n1) - F.log((c0 + PRIOR * n0 / (n0 + n1)) / n0)
    return F.when((c0 + c1 >= LEAST_TEXTS) & (F.abs(ratio) >= LEAST_RATIO), ratio).otherwise(0.0)


class ToxicityModel:
    """``score`` is the probability of label 1: of the calibrated margin of a text's unit vector of ratios."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.ratios, self.weights, self.bias = ratios.astype(np.float32), weights.astype(np.float32), float(bias)
        self.slope, self.shift = float(slope), float(shift)

    def margins(self, text: pa.Array) -> np.ndarray:
        grams = NGrams()
        out = np.full(len(text), self.bias)
        for i, t in enumerate(text.to_pylist()):
            own = grams.of(t)
            ratio = self.ratios[own]
            length = math.sqrt(float(ratio @ ratio))
            if length:
                out[i] += float(ratio @ self.weights[own]) / length
        return out

    def scores(self, text: pa.Array) -> np.ndarray:
        margin = self.slope * self.margins(text) + self.shift
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def score(self, text: Column) -> Column:
        """Score of a string column, for use in select and filter."""
        model = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                table = pa.record_batch([pa.array(texts, pa.large_string(), from_pandas=True)], names=["text"])
                parts = [model.scores(part.column("text")) for part in byte_slices(iter([table]), "text")]
                yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        return F.pandas_udf(run, "double")(text)


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, size: int, train: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the balanced logistic regression on the sparse rows that ``train`` marks, by limited-memory BFGS."""
    ones, zeros = train & (label == 1), train & (label == 0)
    weight = ones * 0.5 / max(1, ones.sum()) + zeros * 0.5 / max(1, zeros.sum())

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.bincount(row, value * x.astype(np.float32)[column], minlength=len(label)) + x[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label)
        gradient = np.append(np.bincount(column, value * error.astype(np.float32)[row], minlength=size) + REG * x[:-1], error.sum())
        return float(weight @ (np.logaddexp(0, margin) - label * margin) + REG / 2 * x[:-1] @ x[:-1]), gradient

    x = np.zeros(size + 1)
    now, gradient = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ITERATIONS):
        direction, back = gradient.copy(), []
        for step, change in reversed(steps):
            back.append((step @ direction) / (step @ change))
            direction -= back[-1] * change
        if steps:
            direction *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (step, change), a in zip(steps, reversed(back)):
            direction += step * (a - (change @ direction) / (step @ change))
        length = 1.0 if steps else 1 / max(1.0, float(np.abs(gradient).sum()))
        while True:
            new, new_gradient = loss(x - length * direction)
            if new <= now - 1e-4 * length * (gradient @ direction) or length < 1e-8:
                break
            length /= 2
        step, change = -length * direction, new_gradient - gradient
        if step @ change > 1e-12:
            steps = [*steps, (step, change)][-10:]
        done = abs(now - new) < 1e-7 * max(1.0, abs(now))
        x, now, gradient = x + step, new, new_gradient
        if done:
            break
    return x[:-1], float(x[-1])


def _rows_for_models(ratios):
    """Each training row for every model: its label, fold, hash and the features that have a ratio in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for batch in byte_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            every = [f.astype(np.int32) for f in map(grams.of, texts)]
            hashes = [hash_of(t) for t in texts]
            folds, place = pa.array([h % FOLDS for h in hashes], pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))
            for model in range(FOLDS + 1):
                useful = ratios.value[model] != 0
                features = [f[useful[f]] for f in every]
                cuts = pa.array(np.cumsum([0, *map(len, features)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(features)))
                number = pa.array(np.full(len(texts), model, np.int32))
                yield pa.record_batch([number, batch.column("label"), folds, place, lists], names=["model", "label", "fold", "place", "features"])

    return run


def _fitted(ratios):
    """One row for each model: its weights, and the margins it gives to the rows of its fold."""

    def fit(model: int, rows: pa.Table) -> pa.RecordBatch:
        # the tasks' rows come in any order, and sums of floats hang on it
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("place", "ascending"), ("label", "ascending")]))
        label, fold = (rows.column(c).to_numpy() for c in ("label", "fold"))
        lists = rows.column("features").combine_chunks()
        feature = lists.values.to_numpy()
        row = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        ratio = ratios.value[model]
        used = np.flatnonzero(ratio)
        place = np.zeros(len(ratio), np.int32)
        place[used] = np.arange(len(used))
        column, value = place[feature], ratio[feature]
        length = np.sqrt(np.bincount(row, value * value, minlength=len(label)))
        value /= length.astype(np.float32)[row]
        train = fold != model  # the last model's number is no fold
        weights, bias = logistic(row, column, value, label, len(used), train)
        margin = (np.bincount(row, value * weights.astype(np.float32)[column], minlength=len(label)) + bias)[~train]
        lists = [used.astype(np.int32), weights, margin, label[~train].astype(np.int32)]
        return pa.record_batch(
            [pa.array([model], pa.int32()), pa.array([bias]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists)],
            names=["model", "bias", "feature", "weight", "margin", "label"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            number = batch.column("model").to_numpy()
            for model in np.unique(number).tolist():
                held.setdefault(model, []).append(batch.filter(pa.array(number == model)))
        for model in [*held]:
            yield fit(model, pa.Table.from_batches(held.pop(model)))

    return run


def _slope(margin: np.ndarray, label: np.ndarray) -> float:
    """Slope of the one-dimensional balanced logistic regression on margins, by Newton's steps; at least a little."""
    weight = np.where(label == 1, len(label) / (2 * label.sum()), len(label) / (2 * (len(label) - label.sum())))
    x, beta = np.stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        gradient = x @ (weight * (label - p)) - 1e-3 * beta
        beta = beta + np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2), gradient)
    return float(np.clip(beta[0], 0.2, 50))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Fit on the labelled rows of ``documents`` that are not held out."""
    sample = written(labelled_sample(documents, labels, label, max_rows).select("text", F.col("label").cast("int").alias("label")), "toxic-sample")
    counts = written(feature_counts(sample), "toxic-counts")
    texts = counts.where("feature = -1").first()
    sizes = np.array([[texts[f"a{f}"], texts[f"b{f}"]] for f in range(FOLDS)]) if texts else np.zeros((FOLDS, 2))
    total = sizes.sum(axis=0)
    if not total.all():
        nothing = np.zeros(1 << HASH_BITS)
        return ToxicityModel(nothing, nothing, math.log((total[1] + 1) / (total[0] + 1)))
    others = [[f for f in range(FOLDS) if f != fold] for fold in range(FOLDS)]
    calibrated = total.min() >= FOLDS and all(sizes[own].sum(axis=0).all() for own in others)
    columns = [log_ratio(own, sizes).alias(f"r{m}") for m, own in enumerate([*others, list(range(FOLDS))]) if calibrated or m == FOLDS]
    names = [f"r{m}" for m in range(FOLDS + 1) if calibrated or m == FOLDS]
    useful = counts.where("feature >= 0").select("feature", *columns).where(" or ".join(f"{n} != 0" for n in names)).toPandas()  # 2^HASH_BITS rows at most
    ratios = np.zeros((FOLDS + 1, 1 << HASH_BITS), np.float32)
    for n in names:
        ratios[int(n[1:]), useful["feature"]] = useful[n]
    shared = sample.sparkSession.sparkContext.broadcast(ratios)
    rows = sample.mapInArrow(_rows_for_models(shared), "model int, label int, fold int, place long, features array<int>")
    schema = "model int, bias double, feature array<int>, weight array<double>, margin array<double>, label array<int>"
    found = {r["model"]: r for r in rows.repartition(FOLDS + 1, "model").mapInArrow(_fitted(shared), schema).collect()}
    weights = np.zeros(1 << HASH_BITS)
    weights[found[FOLDS]["feature"]] = found[FOLDS]["weight"]
    model = ToxicityModel(ratios[-1], weights, found[FOLDS]["bias"])
    if not calibrated:
        return model
    margin, y = (np.concatenate([np.array(found[f][c]) for f in range(FOLDS)]) for c in ("margin", "label"))
    cut = float(np.quantile(margin[y == 0], 1 - FALSE_ALARMS, method="higher"))
    model.slope = _slope(margin, y)
    model.shift = math.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * cut
    return model


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``."""
    model = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(batch.column("text")))], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out().alias("held_out"), "score"
    )
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast(T.IntegerType()))


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not toxic, with all their columns."""
    return documents.where(fit(documents, labels).score(F.col("text")) < THRESHOLD)
