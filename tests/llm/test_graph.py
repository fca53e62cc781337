"""Operator 8 against comparing all pairs."""

import numpy as np
import pytest

from tillsight.llm import graph_dedup, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    parent, count = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[i] = x / np.linalg.norm(x)
    for i in unit:
        for j in unit:
            if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                count[i] += 1
                count[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (vec, *_) in enumerate(rows):
        if vec is not None:
            least[root(i)] = min(vec, least.get(root(i), vec))
    out = []
    for i, (vec, *_) in enumerate(rows):
        component = least.get(root(i)) if i in unit else vec
        out.append((vec, count[i], component, vec is not None and vec == component))
    return sorted(map(str, out))


def got(df, **sizes):
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in graph_dedup.near_duplicates(df, **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"region": 60, "shard": 40}, {"region": 500, "shard": 50}])
def test_links_of_dense_spots_copies_and_odd_vectors(spark, sizes):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for _ in range(150):
            rows.append((rng.standard_normal(16), label))
        for size, spread in ((90, 0.02), (40, 0.04), (12, 0.1)):
            centre = rng.standard_normal(16)
            rows += [(centre + spread * rng.standard_normal(16), label) for _ in range(size)]
        rows += [(rows[0][0], label)] * 7
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    nan = float("nan")
    rows += [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [nan] + [1.0] * 15, 0), (9003, [None] * 16, 0), (9004, rows[0][1], None),
             (9005, [], 0), (9006, rows[0][1][:8], 0), (9007, rows[0][1][:8], 0), (None, rows[0][1], 0), (5, rows[5][1], 1), (9008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, 3) for r in rows], VECTORS + ", node int")
    assert got(df, **sizes) == plain(rows)


def test_op8_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = queries.QUERIES["op8_robust_pruned_graph"](spark, sf).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in out) == plain(rows)
    assert all(r.audit_recall >= 0.9 for r in out)


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([], VECTORS)
    assert graph_dedup.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(3, [1.0, 2.0], 1), (4, None, None)], VECTORS)
    assert got(one) == [str((3, 0, 3, True)), str((4, 0, 4, True))]


def test_pruned_lists_are_short_and_searchable():
    rng = np.random.default_rng(0)
    v = graph_dedup.unit(rng.standard_normal((700, 12)))
    lists, medoid = graph_dedup.build_graph(v)
    assert lists.shape == (700, 2 * graph_dedup.DEGREE) and (lists < 700).all()
    found, _ = graph_dedup.greedy_search(v, lists, v, np.array([medoid]), graph_dedup.BEAM)
    assert (found[:, 0] == np.arange(700)).mean() > 0.95
