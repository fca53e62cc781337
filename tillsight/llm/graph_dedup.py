"""Embedding near-dedup over a robust-pruned flat graph (operator 8).

Vectors are compared only with vectors of their label and length.  Equal
vectors are one node.  The nodes of a label lie in regions of about ``REGION``
(nearest of centroids fitted on a bounded sample, the two nearest where there
are several), and an overfull region is cut into blocks.  In each block:

1. k-means shards it; every node goes to its two nearest shards.
2. Each shard builds its graph in a task of its own: batches of nodes search
   from the medoid, robust pruning keeps near neighbours that no kept one
   covers, reverse edges are added and pruned.
3. Adjacency lists of a node from its shards are united.
4. Every node is searched for from the shards' medoids; what lies in range is
   expanded along the united lists, both ways, until nothing new is in range.
   Pairs are verified in double precision.

Nodes of one block of a region are searched for in all its blocks, in groups of
two blocks.  Recall is audited on ``AUDIT`` nodes against all others; while it
is below ``RECALL``, the search is repeated with twice the beam, at most
``TRIES`` times.

Defined cases: a vector that is null, empty, zero or has null or non-finite
components, or whose label is null, has no links and is its own component;
repeated rows are vectors of their own; a null id takes part but never names a
component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import scratch_name, written
from tillsight.llm.components import components

COSINE = 0.98
REGION = 20_000
SHARD = 400
DEGREE = 24
BEAM = 40
ALPHA = 1.2
CENTROID_SAMPLE = 20_000
MAX_CENTROIDS = 1_000
AUDIT = 500
RECALL = 0.97
TRIES = 3
BATCH = 256
_PLACE = ["label", "dim", "region", "block"]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    v = np.asarray(v, np.float64)
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def kmeans(v: np.ndarray, k: int, seed: int = 7, rounds: int = 6) -> np.ndarray:
    """Unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    centroids = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = (v @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, v)
        size = np.sqrt((total**2).sum(axis=1, keepdims=True))
        centroids = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centroids)
    return centroids


def nearest_two(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the two nearest centroids of each row (the same twice if there is one only)."""
    out = np.zeros((len(v), 2), np.int64)
    for at in range(0, len(v), 4096):
        near = v[at : at + 4096] @ centroids.T
        out[at : at + 4096, 0] = near.argmax(axis=1)
        if len(centroids) > 1:
            near[np.arange(len(near)), out[at : at + 4096, 0]] = -2
            out[at : at + 4096, 1] = near.argmax(axis=1)
        else:
            out[at : at + 4096, 1] = out[at : at + 4096, 0]
    return out


def greedy_search(v: np.ndarray, lists: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries side by side over adjacency lists (-1 is none): ids and cosines, nearest first."""
    m, n = len(queries), len(v)
    rows = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # the place of "none"
    seen[:, starts] = True
    ids = np.broadcast_to(starts, (m, len(starts))).copy()
    near = np.einsum("sd,md->ms", v[starts], queries)
    order = np.argsort(-near, axis=1)[:, :beam]
    ids, near = ids[rows, order], near[rows, order]
    done = np.zeros(ids.shape, bool)
    live = np.arange(m)
    while len(live):
        pick = (~done[live]).argmax(axis=1)
        open_ = ~done[live, pick] & (near[live, pick] > -2)
        live, pick = live[open_], pick[open_]
        if not len(live):
            break
        done[live, pick] = True
        new = lists[ids[live, pick]]
        new = np.where(new < 0, n, new)
        fresh = ~seen[live[:, None], new]
        seen[live[:, None], new] = True
        cosine = np.where(fresh, np.einsum("brd,bd->br", v[np.minimum(new, n - 1)], queries[live]), -3)
        all_ids = np.concatenate((ids[live], new), axis=1)
        all_near = np.concatenate((near[live], cosine), axis=1)
        all_done = np.concatenate((done[live], ~fresh), axis=1)
        keep = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        local = np.arange(len(live))[:, None]
        if ids.shape[1] < keep.shape[1]:
            grow = keep.shape[1] - ids.shape[1]
            ids = np.concatenate((ids, np.full((m, grow), n)), axis=1)
            near = np.concatenate((near, np.full((m, grow), -3.0)), axis=1)
            done = np.concatenate((done, np.ones((m, grow), bool)), axis=1)
        ids[live], near[live], done[live] = all_ids[local, keep], all_near[local, keep], all_done[local, keep]
    return np.where(near > -2, ids, -1), near


def robust_prune(v: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point up to ``degree`` of its candidates (-1 is none), none of which a nearer kept one covers by ``alpha``."""
    m, c = candidates.shape
    ids = np.sort(candidates, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    ids[ids == points[:, None]] = -1
    x = v[np.maximum(ids, 0)]
    gap = lambda cosine: np.sqrt(np.maximum(0, 2 - 2 * cosine))
    own = np.where(ids >= 0, gap(np.einsum("mcd,md->mc", x, v[points])), np.inf)
    alive, kept, rows = own.copy(), np.full((m, degree), -1), np.arange(m)
    for k in range(degree):
        best = alive.argmin(axis=1)
        some = np.isfinite(alive[rows, best])
        if not some.any():
            break
        kept[some, k] = ids[rows, best][some]
        between = gap(np.einsum("mcd,md->mc", x, x[rows, best]))
        alive[alpha * between <= own] = np.inf
        alive[rows, best] = np.inf
    return kept


def build_graph(v: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """Adjacency lists (n x 2 degree, -1 is none) of unit rows, and their medoid."""
    n = len(v)
    medoid = int((v @ v.mean(axis=0)).argmax())
    lists = np.full((n, 2 * degree), -1)
    if n == 1:
        return lists, medoid
    rng = np.random.default_rng(seed)
    lists[:, :degree] = rng.integers(0, n, (n, degree))
    for a in (1.0, alpha):
        for at in range(0, n, BATCH):
            points = np.arange(at, min(n, at + BATCH))
            found, _ = greedy_search(v, lists, v[points], np.array([medoid]), beam)
            kept = robust_prune(v, points, np.concatenate((found, lists[points]), axis=1), degree, a)
            lists[points] = -1
            lists[points, :degree] = kept
            # reverse edges: into free places, pruning the lists that have too few
            target, source = kept.ravel(), np.repeat(points, degree)
            target, source = target[target >= 0], source[target >= 0]
            present = (lists[target] == source[:, None]).any(axis=1)
            target, source = target[~present], source[~present]
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            heads, first, count = np.unique(target, return_index=True, return_counts=True)
            extra = np.full((len(heads), count.max(initial=1)), -1)
            extra[np.repeat(np.arange(len(heads)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            merged = np.concatenate((lists[heads], extra), axis=1)
            full = (merged >= 0).sum(axis=1) > 2 * degree
            merged = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), axis=1)
            lists[heads[~full]] = merged[~full][:, : 2 * degree]
            if full.any():
                lists[heads[full]] = -1
                lists[heads[full], :degree] = robust_prune(v, heads[full], merged[full], degree, a)
    return lists, medoid


def both_ways(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of adjacency lists and their reverses: where each row's targets start, and the targets."""
    n = len(lists)
    source, slot = np.nonzero(lists >= 0)
    target = lists[source, slot]
    key = np.unique(np.concatenate((source * np.int64(n) + target, target * np.int64(n) + source)))
    return np.searchsorted(key, np.arange(n + 1) * np.int64(n)), key % n


def _cosines(v: np.ndarray, queries: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Cosine of each (query, row) pair, coded as query * len(v) + row."""
    n, step = len(v), 1 << 15
    parts = [np.einsum("pd,pd->p", v[key[k : k + step] % n], queries[key[k : k + step] // n]) for k in range(0, len(key), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def range_search(v: np.ndarray, lists: np.ndarray, starts: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with at least ``cosine``: greedy search, then expansion of what is in range.

    The greedy search walks the lists; expansion takes their edges both ways,
    as a pruned list holds the hub of a dense spot but not the spot's other
    members.  ``own`` is the query's row here or -1; expansion starts there too.
    """
    n = len(v)
    begin, targets = both_ways(lists)
    pairs: list[np.ndarray] = []
    for at in range(0, len(queries), BATCH):
        q = queries[at : at + BATCH]
        found, near = greedy_search(v, lists, q, starts, beam)
        query, slot = np.nonzero(near >= cosine - 1e-6)
        mine = own[at : at + BATCH]
        frontier = np.unique(np.concatenate((query * np.int64(n) + found[query, slot], np.flatnonzero(mine >= 0) * np.int64(n) + mine[mine >= 0])))
        met, good = frontier, [frontier]
        while len(frontier):
            query, row = frontier // n, frontier % n
            degree = begin[row + 1] - begin[row]
            place = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree, degree) + np.repeat(begin[row], degree)
            key = np.unique(np.repeat(query, degree) * np.int64(n) + targets[place])
            key = key[~np.isin(key, met, assume_unique=True)]
            met = np.concatenate((met, key))
            frontier = key[_cosines(v, q, key) >= cosine - 1e-6]
            good.append(frontier)
        key = np.concatenate(good)
        pairs.append(key[_cosines(v, q, key) >= cosine] + np.int64(at) * n)
    key = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    return key // n, key % n


def nodes(embeddings: DataFrame) -> DataFrame:
    """One row per distinct comparable vector: (label, dim, node, v, copies, first_id)."""
    v = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.col("label").isNotNull() & F.coalesce((F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"), good.alias("good"))
    grouped = rows.where("good").groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    return grouped.select("label", F.size("v").alias("dim"), F.xxhash64("label", "v").alias("node"), "v", "copies", "first_id")


def _placed(found: DataFrame, region: int) -> DataFrame:
    """Nodes with region and block; a node lies in the two nearest regions of a label that has several."""
    sizes = found.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > region)
    if large.isEmpty():
        dealt = found.withColumn("region", F.lit(0))
    else:
        sample = found.join(large, ["label", "dim"]).orderBy(F.xxhash64("node"), "node").limit(CENTROID_SAMPLE).select("label", "dim", "size", "v").toPandas()
        room = MAX_CENTROIDS / max(1, sample.groupby(["label", "dim"])["size"].first().sum() / region)
        centroids = {}
        for (label, dim), own in sample.groupby(["label", "dim"]):
            k = int(np.ceil(own["size"].iloc[0] / region * min(1.0, room)))
            if k > 1:
                centroids[(label, dim)] = kmeans(unit(np.stack(own["v"])), k)

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for (label, dim), own in frame.groupby(["label", "dim"]):
                    if (label, dim) in centroids:
                        near = nearest_two(unit(np.stack(own["v"])), centroids[(label, dim)])
                        yield pd.concat([own.assign(region=near[:, 0]), own.assign(region=near[:, 1])])
                    else:
                        yield own.assign(region=0)

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
        dealt = found.mapInPandas(deal, f"{fields}, region int").dropDuplicates(["label", "dim", "region", "node"])
    counts = dealt.groupBy("label", "dim", "region").agg(F.ceil(F.count(F.lit(1)) / (2.0 * region)).cast("int").alias("blocks"))
    return dealt.join(counts, ["label", "dim", "region"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"))


def _shards(size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = unit(np.stack(frame["v"]))
        k = -(-len(v) // size)
        near = nearest_two(v, kmeans(v[: 20 * size], k)) if k > 1 else np.zeros((len(v), 2), np.int64)
        parts = [frame.assign(shard=near[:, 0]), frame.assign(shard=near[:, 1])[near[:, 0] != near[:, 1]]]
        return pd.concat(parts)[[*_PLACE, "shard", "node", "v"]]

    return run


def _graph(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node")
    ids = frame["node"].to_numpy()
    lists, medoid = build_graph(unit(np.stack(frame["v"])))
    return pd.DataFrame(
        {c: frame[c] for c in _PLACE} | {"node": ids, "near": [ids[x[x >= 0]] for x in lists], "medoid": np.arange(len(ids)) == medoid}
    )


def _search(cosine: float, beam: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        base = frame[frame["near"].notna()].sort_values("node").reset_index(drop=True)
        if not len(base):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        ids = base["node"].to_numpy()
        v = unit(np.stack(base["v"]))
        width = max(1, max(map(len, base["near"])))
        lists = np.full((len(ids), width), -1)
        for i, near in enumerate(base["near"]):
            lists[i, : len(near)] = np.searchsorted(ids, near)
        starts = np.flatnonzero(base["medoid"].to_numpy(bool))
        asked = base if (frame["qblock"] == frame["block"]).all() else frame[frame["near"].isna()]
        queries = asked["node"].to_numpy()
        at = np.minimum(np.searchsorted(ids, queries), len(ids) - 1)
        own = np.where(ids[at] == queries, at, -1)
        out = []
        for k in range(0, len(asked), 4096):
            q, row = range_search(v, lists, starts, unit(np.stack(asked["v"].iloc[k : k + 4096])), own[k : k + 4096], cosine, beam) if len(asked) else ([], [])
            out.append((queries[k : k + 4096][q], ids[row]))
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()

    return run


def links(found: DataFrame, cosine: float = COSINE, region: int = REGION, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(a, b), a < b: nodes of ``found`` that the graph search links."""
    placed = written(_placed(found, region).select(*_PLACE, "blocks", "node", "v"), "vectors")
    place = "label long, dim int, region int, block int"
    sharded = placed.groupBy(*_PLACE).applyInPandas(_shards(shard), f"{place}, shard int, node long, v array<double>")
    graphs = sharded.groupBy(*_PLACE, "shard").applyInPandas(_graph, f"{place}, node long, near array<long>, medoid boolean")
    united = graphs.groupBy(*_PLACE, "node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))
    united = written(placed.join(united, [*_PLACE, "node"]), "graph")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    base = united.withColumn("qblock", F.explode(every))
    others = (
        united.where("blocks > 1")
        .withColumn("qblock", F.col("block"))
        .withColumn("block", F.explode(F.filter(every, lambda b: b != F.col("qblock"))))
        .withColumns({"near": F.lit(None).cast("array<long>"), "medoid": F.lit(False)})
    )
    columns = [*_PLACE, "qblock", "node", "v", "near", "medoid"]
    groups = base.select(*columns).unionByName(others.select(*columns)).groupBy(*_PLACE, "qblock")
    return groups.applyInPandas(_search(cosine, beam), "a long, b long").distinct()


def audit(found: DataFrame, linked: DataFrame, cosine: float = COSINE, size: int = AUDIT) -> float:
    """Share of the links of ``size`` nodes (smallest hashes) that ``linked`` holds, by comparing them with every node."""
    asked = found.orderBy(F.xxhash64(F.lit(2), "node"), "node").limit(size).select("label", "dim", "node", "v").toPandas()
    if not len(asked):
        return 1.0
    by_kind = {k: (g["node"].to_numpy(), unit(np.stack(g["v"]))) for k, g in asked.groupby(["label", "dim"])}

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, own in frame.groupby(["label", "dim"]):
                if kind in by_kind:
                    ids, v = by_kind[kind]
                    i, j = np.nonzero(v @ unit(np.stack(own["v"])).T >= cosine)
                    a, b = ids[i], own["node"].to_numpy()[j]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b]

    true = found.select("label", "dim", "node", "v").mapInPandas(compare, "a long, b long").distinct()
    have = linked.withColumn("have", F.lit(1))
    total, hit = true.join(have, ["a", "b"], "left").agg(F.count(F.lit(1)), F.count("have")).first()
    return hit / total if total else 1.0


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, region: int = REGION, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row."""
    found = written(nodes(embeddings), "nodes")
    for _ in range(TRIES):
        linked = written(links(found, cosine, region, shard, beam), "pairs")
        recall = audit(found, linked, cosine)
        if recall >= RECALL:
            break
        beam *= 2
    both = linked.union(linked.select("b", "a")).toDF("node", "other")
    sizes = found.select(F.col("node").alias("other"), "copies")
    counts = both.join(sizes, "other").groupBy("node").agg(F.sum("copies").alias("others"))
    roots = found.select("node", "copies", "first_id").join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component"))
    known = roots.join(least, "root").join(counts, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component"
    )
    node, label, v = scratch_name("node"), F.col("label").cast("long"), F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select("vec_id", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), F.xxhash64(label, v)).alias(node))
    rows = rows.join(known, F.col(node) == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        F.lit(float(recall)).alias("audit_recall"),
    )
