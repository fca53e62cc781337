"""Regressions from sums of products: elimination steps without a job each, Newton steps for all columns at once.

Rows are read in Arrow batches; a task sends on sums only, k × k numbers for
k terms, whatever the number of rows, and the driver works on these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.special import t_two_sided

#: A column whose part that the others do not explain is below this share of it is constant or collinear.
TOLERANCE = 1e-9
NEWTON_STEPS = 25
Blocks = Callable[[np.ndarray, np.ndarray, np.ndarray], dict]


def polynomial_terms(cols: Sequence[str], degree: int = 1, interaction_only: bool = False) -> tuple[list[str], list[tuple[int, ...]]]:
    """Names and factors (by number of the column) of the products of up to ``degree`` columns."""
    pick = combinations if interaction_only else combinations_with_replacement
    factors = [t for d in range(1, degree + 1) for t in pick(range(len(cols)), d)]
    names = [" ".join(cols[c] if p == 1 else f"{cols[c]}^{p}" for c, p in Counter(t).items()) for t in factors]
    return names, factors


def sums(rows: DataFrame, cols: Sequence[str], target: str, factors: Sequence[tuple[int, ...]], blocks: Blocks, split: str = "split") -> dict:
    """(split, name, i, j) -> sum over the rows without nulls of what ``blocks`` makes of the terms X, target y and split of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            base = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(len(cols))], axis=1)
            x = np.stack([np.prod(base[:, list(t)], axis=1) for t in factors], axis=1)
            y, side = batch.column(len(cols)).to_numpy(zero_copy_only=False), np.array(batch.column(len(cols) + 1).to_pylist(), object)
            for s in np.unique(side.astype(str)):
                own = side == s
                for name, value in blocks(x[own], y[own], s).items():
                    value = np.atleast_2d(np.asarray(value, float))
                    total[s, name] = total[s, name] + value if (s, name) in total else value
        for (s, name), value in total.items():
            i, j = np.indices(value.shape)
            n = value.size
            yield pa.record_batch(
                [pa.array([s] * n), pa.array([name] * n), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(value.ravel())],
                names=["split", "name", "i", "j", "v"],
            )

    narrow = rows.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)], F.col(target).cast("double").alias("y"), F.col(split).alias("split"))
    parts = narrow.dropna().mapInArrow(run, "split string, name string, i int, j int, v double")
    found: dict = {}
    cells = parts.groupBy("split", "name", "i", "j").agg(F.sum("v").alias("v")).collect()  # k x k of each name and split
    for r in cells:
        found.setdefault((r["split"], r["name"]), {})[r["i"], r["j"]] = r["v"]
    out = {}
    for key, values in found.items():
        shape = tuple(np.array(list(values)).max(axis=0) + 1)
        out[key] = np.zeros(shape)
        for place, v in values.items():
            out[key][place] = v
    return out


def sweep(a: np.ndarray, k: int) -> None:
    """Goodnight's sweep of a matrix on pivot ``k``, in place; a second one undoes it."""
    d = a[k, k]
    row = a[k] / d
    column = a[:, k].copy()
    a -= np.outer(column, row)
    a[k] = row
    a[:, k] = -column / d
    a[k, k] = 1 / d


def gram(rows: DataFrame, cols: Sequence[str], target: str, factors: Sequence[tuple[int, ...]]) -> tuple[dict, np.ndarray]:
    """Sums of products of (1, terms, target) by split, terms and target less their means over the train rows; and these means."""
    first = sums(rows, cols, target, factors, lambda x, y, _: {"n": len(y), "sum": np.append(x.sum(axis=0), y.sum())})
    means = first["train", "sum"][0] / first["train", "n"][0, 0]

    def products(x: np.ndarray, y: np.ndarray, _) -> dict:
        z = np.column_stack([np.ones(len(y)), np.column_stack([x, y]) - means])
        return {"g": z.T @ z}

    return {s: v for (s, _), v in sums(rows, cols, target, factors, products).items()}, means


def eliminate_ols(rows: DataFrame, cols: Sequence[str], target: str, p_threshold: float = 0.05, degree: int = 1, interaction_only: bool = False) -> list[tuple]:
    """OLS backward elimination; (features, worst feature, its p, R² train, R² test) of every step.

    One pass gives the sums of products; each step is one sweep of that matrix.
    """
    names, factors = polynomial_terms(cols, degree, interaction_only)
    g, _ = gram(rows, cols, target, factors)
    a, y = g["train"].copy(), len(names) + 1
    n, total = a[0, 0], a[y, y] - a[0, y] ** 2 / a[0, 0]
    whole = a.diagonal().copy()
    sweep(a, 0)
    active = []
    for i in range(1, y):
        if a[i, i] > TOLERANCE * max(whole[i], 1e-300):
            sweep(a, i)
            active.append(i)
    steps = []
    while active:
        dof = n - 1 - len(active)
        error = max(a[y, y], 0.0) / dof if dof > 0 else math.nan
        p = {i: t_two_sided(float(a[i, y] / math.sqrt(a[i, i] * error)), float(dof)) if error > 0 and a[i, i] > 0 else 0.0 for i in active}
        worst = max(active, key=lambda i: p[i])
        beta = np.zeros(y + 1)
        beta[[0, *active]], beta[y] = -a[[0, *active], y], 1.0
        test = None
        if "test" in g:
            t = g["test"]
            spread = t[y, y] - t[0, y] ** 2 / t[0, 0]
            test = float(1 - beta @ t @ beta / spread) if spread > 0 else None
        steps.append(([names[i - 1] for i in active], names[worst - 1], float(p[worst]), float(1 - a[y, y] / total) if total > 0 else None, test))
        if p[worst] < p_threshold:
            break
        sweep(a, worst)
        active.remove(worst)
    return steps


def eliminate_logit(rows: DataFrame, cols: Sequence[str], target: str, p_threshold: float = 0.05, degree: int = 1, interaction_only: bool = False) -> list[tuple]:
    """Logit backward elimination by Wald's p; (features, worst feature, its p, accuracy train, accuracy test) of every step.

    Each Newton step is one pass; a step of the elimination begins at the
    coefficients that are left.  Without a finite estimate (separation) the
    step has no p and is the last.
    """
    names, factors = polynomial_terms(cols, degree, interaction_only)
    g, means = gram(rows, cols, target, factors)
    n = g["train"][0, 0]
    scale = np.sqrt(np.maximum(g["train"].diagonal()[1:-1] / n, 0))
    a = g["train"].copy()
    sweep(a, 0)
    active = []
    for i in range(1, len(names) + 1):
        if a[i, i] > TOLERANCE * max(g["train"][i, i], 1e-300):
            sweep(a, i)
            active.append(i - 1)
    share = means[-1]
    beta = np.append(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), np.zeros(len(active)))
    steps = []
    while active:
        own = list(active)
        converged, inverse, hits = False, None, {}
        for _ in range(NEWTON_STEPS):
            def step(x: np.ndarray, y: np.ndarray, side: str, own=own, beta=beta) -> dict:
                z = np.column_stack([np.ones(len(y)), (x[:, own] - means[own]) / scale[own]])
                margin = z @ beta
                p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                out = {"hits": [((p > 0.5) == (y > 0.5)).sum(), len(y)]}
                if side == "train":
                    out |= {"h": (z * (p * (1 - p))[:, None]).T @ z, "g": z.T @ (y - p)}
                return out

            found = sums(rows, cols, target, factors, step)
            hits = {s: found[s, "hits"][0] for s in ("train", "test") if (s, "hits") in found}
            try:
                inverse = np.linalg.inv(found["train", "h"])
            except np.linalg.LinAlgError:
                break
            change = inverse @ found["train", "g"][0]
            if np.abs(change).max() < 1e-8:
                converged = True
                break
            beta = beta + np.clip(change, -5, 5)
        score = [float(hits[s][0] / hits[s][1]) if s in hits else None for s in ("train", "test")]
        features = [names[i] for i in active]
        if not converged:
            steps.append((features, None, None, *score))
            break
        z = np.abs(beta[1:]) / np.sqrt(inverse.diagonal()[1:])
        worst = int(np.argmin(z))
        p = math.erfc(z[worst] / math.sqrt(2))
        steps.append((features, features[worst], p, *score))
        if p < p_threshold:
            break
        active.pop(worst)
        beta = np.delete(beta, worst + 1)
    return steps


def logit_screen(rows: DataFrame, cols: Sequence[str], target: str = "y") -> DataFrame:
    """T14 (+F26): univariate logit of every column: coefficient, McFadden's pseudo-R² and accuracy on train and test rows, relevance.

    A Newton step of all columns is one pass and k × 5 sums.  A column that has
    no finite estimate (it separates the classes, wholly or in a value, or is
    constant) is marked and has nulls.
    """
    from tillsight.functions.scalar import relevance

    factors = [(i,) for i in range(len(cols))]
    first = sums(rows, cols, target, factors, lambda x, y, _: {"n": len(y), "y": y.sum(), "x": x.sum(axis=0), "xx": (x * x).sum(axis=0)})
    n = first["train", "n"][0, 0]
    mean = first["train", "x"][0] / n
    spread = np.sqrt(np.maximum(first["train", "xx"][0] / n - mean * mean, 0))
    constant = spread <= 1e-9 * np.maximum(1, np.abs(mean))
    scale = np.where(constant, 1.0, spread)
    share = first["train", "y"][0, 0] / n
    beta = np.stack([np.full(len(cols), math.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(len(cols))])
    done = constant.copy()
    for _ in range(NEWTON_STEPS):
        def step(x: np.ndarray, y: np.ndarray, side: str, beta=beta) -> dict:
            if side != "train":
                return {}
            z = (x - mean) / scale
            p = 1 / (1 + np.exp(-np.clip(beta[0] + z * beta[1], -500, 500)))
            w, error = p * (1 - p), y[:, None] - p
            return {"h": [w.sum(0), (w * z).sum(0), (w * z * z).sum(0)], "g": [error.sum(0), (error * z).sum(0)]}

        found = sums(rows, cols, target, factors, step)
        (w, wz, wzz), (g0, g1) = found["train", "h"], found["train", "g"]
        det = w * wzz - wz * wz
        good = (det > 1e-12 * np.maximum(w * wzz, 1e-300)) & (w > 1e-12)
        safe = np.where(good, det, 1.0)
        change = np.where(good, np.stack([wzz * g0 - wz * g1, w * g1 - wz * g0]) / safe, 0.0)
        done = constant | (good & (np.abs(change).max(axis=0) < 1e-8))
        if done.all():
            break
        beta = beta + np.clip(change, -5, 5)
    finite = done & ~constant

    def likelihood(x: np.ndarray, y: np.ndarray, _) -> dict:
        margin = beta[0] + (x - mean) / scale * beta[1]
        return {"ll": (y[:, None] * margin - np.logaddexp(0, margin)).sum(0), "hits": ((margin > 0) == (y[:, None] > 0.5)).sum(0)}

    last = sums(rows, cols, target, factors, likelihood)
    out = []
    for i, c in enumerate(cols):
        row = [c, float(beta[1, i] / scale[i]) if finite[i] else None]
        for s in ("train", "test"):
            size, ones = (first[s, k][0, 0] if (s, k) in first else 0 for k in ("n", "y"))
            none = ones * math.log(ones / size) + (size - ones) * math.log(1 - ones / size) if size and 0 < ones < size else 0.0
            row += [float(1 - last[s, "ll"][0, i] / none) if finite[i] and none else None, float(last[s, "hits"][0, i] / size) if finite[i] and size else None]
        out.append((*row, not finite[i]))
    schema = "feature string, coefficient double, pseudo_r2_train double, accuracy_train double, pseudo_r2_test double, accuracy_test double, perfect_separation boolean"
    return rows.sparkSession.createDataFrame(out, schema).withColumn("relevance", relevance("pseudo_r2_train", True))
