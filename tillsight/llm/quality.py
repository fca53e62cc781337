"""Quality classifier: a sparse rule ensemble over text statistics (operator 1).

Every whole text is described by ``STATISTICS``.  A random forest of shallow
trees is fitted on a labelled sample; each path from a root to a node below it
is one conjunctive rule over the statistics.  A lasso logistic regression
weighs the rules, and those with a weight other than zero are compiled into
one Spark column expression, which is the score.

Training reads at most ``MAX_TRAINING_ROWS`` labelled rows that are not held
out (smallest id hashes first).

Defined cases: null text counts as empty, and every statistic of an empty text
is zero; with no labelled row, or one class only, every score is the (smoothed)
share of rows of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import byte_slices, held_out, labelled_sample, scratch_name, split_text, written

MAX_TRAINING_ROWS = 20_000
TREES = 24
DEPTH = 4
LASSO = 1e-3
#: The fits' many short jobs run over this few partitions of the bounded sample.
FIT_TASKS = 4
THRESHOLD = 0.5

#: Shares of a text's bytes by kind, then shares of its words and lines.
STATISTICS = (
    "upper", "lower", "digit", "space", "line_feed", "stop", "bang", "bar", "mark", "other_sign", "beyond_ascii", "control",
    "word_length", "words_distinct", "words_doubled", "lines_distinct", "log_words",
)
_KINDS = 12


def _kinds() -> np.ndarray:
    kind = np.full(256, 9, np.uint8)
    for i, chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 32), (10,), b".,;:'\"-()", b"!?", b"|", b"#$%&*")):
        kind[list(chars)] = i
    kind[128:] = 10
    kind[:9] = kind[11:32] = kind[127] = 11
    return kind


def _statistics(text: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    kinds = _kinds()
    data, offsets = split_text(text)
    n = len(text)
    kind = kinds[np.frombuffer(data, np.uint8)]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    shares = np.bincount(row * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(STATISTICS)))
    out[:, :_KINDS] = shares / size[:, None]
    for i in range(n):
        own = data[offsets[i] : offsets[i + 1]]
        words = own.split()
        if words:
            count = len(words)
            doubled = sum(map(bytes.__eq__, words, words[1:]))
            lines = own.split(b"\n")
            out[i, _KINDS:] = (
                sum(map(len, words)) / count, len(set(words)) / count, doubled / count,
                len(set(lines)) / len(lines), math.log1p(count),
            )
    return out


def _add_statistics(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            values = _statistics(batch.column("text"))
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.record_batch(
                [batch.column(i) for i in kept] + [pa.array(values[:, k]) for k in range(values.shape[1])],
                names=[batch.schema.names[i] for i in kept] + names,
            )

    return run


def statistics(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and every statistic of ``text``."""
    rows = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    fields = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{s} double" for s in STATISTICS])
    return rows.mapInArrow(_add_statistics(list(STATISTICS)), fields)


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(model) -> list[Rule]:
    """The distinct conjunctions on the paths of the forest's trees; one bound for each statistic and side."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[tuple[str, str], float]) -> None:
        if bounds:
            found.setdefault(tuple((name, side, at) for (name, side), at in sorted(bounds.items())))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, at = STATISTICS[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), bounds | {(name, "<="): min(at, bounds.get((name, "<="), at))})
        walk(node.rightChild(), bounds | {(name, ">"): max(at, bounds.get((name, ">"), at))})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def condition(rule: Rule, struct: str | None = None) -> Column:
    """The rule as a Spark column of 0.0 and 1.0, over statistics that are columns or fields of ``struct``."""
    met = F.lit(True)
    for name, side, at in rule:
        value = F.col(struct)[name] if struct else F.col(name)
        met = met & (value <= at if side == "<=" else value > at)
    return F.when(met, 1.0).otherwise(0.0)


class RuleEnsemble:
    """Weighted rules and a bias; ``score`` is the probability of label 1 as a column over the statistics."""

    def __init__(self, rules: list[tuple[Rule, float]], bias: float):
        self.rules, self.bias = rules, bias

    def score(self, struct: str | None = None) -> Column:
        margin = F.lit(self.bias)
        for rule, weight in self.rules:
            margin = margin + condition(rule, struct) * F.lit(weight)
        return 1 / (1 + F.exp(-margin))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> RuleEnsemble:
    """Fit on the labelled rows of ``documents`` that are not held out."""
    sample = labelled_sample(documents, labels, label, max_rows).withColumn("label", F.col("label").cast("double"))
    sample = written(statistics(sample, ["label"]), "quality-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0.0, 0), sizes.get(1.0, 0)
    if not n0 or not n1:
        return RuleEnsemble([], math.log((n1 + 1) / (n0 + 1)))
    points = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(sample).select("label", "features").coalesce(FIT_TASKS)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="sqrt", seed=7).fit(points)
    rules = tree_rules(forest)
    if not rules:
        return RuleEnsemble([], math.log(n1 / n0))
    met = sample.select("label", F.array(*map(condition, rules)).alias("met"))
    met = written(met, "quality-rules").coalesce(FIT_TASKS).select("label", array_to_vector("met").alias("features"))
    lasso = LogisticRegression(maxIter=100, regParam=LASSO, elasticNetParam=1.0).fit(met)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, weights) if w != 0], float(lasso.intercept))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``."""
    rows = statistics(documents, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), fit(documents, labels).score().alias("score")
    )
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def statistics_struct(text: Column) -> Column:
    """All statistics of a string column as one struct column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [
                _statistics(part.column("text"))
                for part in byte_slices(iter([pa.record_batch([pa.array(texts, pa.large_string(), from_pandas=True)], names=["text"])]), "text")
            ]
            yield pd.DataFrame(np.concatenate(values) if values else np.zeros((0, len(STATISTICS))), columns=list(STATISTICS))

    return F.pandas_udf(run, ", ".join(f"{s} double" for s in STATISTICS))(text)


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` of good quality, with all their columns."""
    all_of = scratch_name("statistics")
    rows = documents.withColumn(all_of, statistics_struct(F.col("text")))
    return rows.where(fit(documents, labels).score(all_of) >= THRESHOLD).drop(all_of)
