"""Operator 7 against counting every window, and its sorting."""

import hashlib
import random

import numpy as np
import pytest

from tillsight.llm import queries, suffix_dedup
from tillsight.llm.deepshallow import blind_trie_order, sort_groups

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def plain_removals(texts, width=200):
    times = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for j in range(len(b) - width + 1):
            times[b[j : j + width]] = times.get(b[j : j + width], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - width + 1):
            if times[b[j : j + width]] > 1:
                gone[j] += 1
                gone[j + width] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))


def test_deep_shallow_order_and_prefixes():
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(90))
    rows = [base[: rng.randrange(90)] for _ in range(200)] + [base] * 3 + [bytes(90)] * 2
    rows = [(r + bytes(rng.choice(b"abc") for _ in range(3))).ljust(93, b"\0") for r in rows]
    group = np.array([rng.randrange(3) for _ in rows])
    order, prefix = sort_groups(group, np.array([list(r) for r in rows], np.uint8))
    key = [(group[i], rows[i]) for i in order]
    assert key == sorted(key)
    for k in range(1, len(order)):
        same = key[k - 1][0] == key[k][0]
        assert prefix[k] == (common(key[k - 1][1], key[k][1]) if same else 0)
    order, prefix = blind_trie_order(rows)
    assert [rows[i] for i in order] == sorted(rows)
    assert prefix[1:] == [common(rows[a], rows[b]) for a, b in zip(order, order[1:])]


def planted():
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    base = noise(900)
    out = [base + noise(100) for _ in range(30)]
    out += [noise(rng.randrange(80)) + base[i * 7 : i * 7 + 190 + i] for i in range(60)]
    out += ["abab" * 700, "z" * 1000, "z" * 199, "", None, "é" * 300, base, base, noise(150), noise(5000)]
    out.append(out[-1][1000:3000] + noise(30) + out[-1][:500])
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_removals_are_those_of_every_window(spark, hot):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(planted())]
    df = spark.createDataFrame([(*r, b"x") for r in rows], DOCS + ", spans binary")
    want = sorted((d, *w[:4]) for (d, _), w in zip(rows, plain_removals([t for _, t in rows])))
    assert sorted(tuple(r) for r in suffix_dedup.removals(df, hot).collect()) == want


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(suffix_dedup.CHUNK * 2 + 1300))
    part = long[suffix_dedup.CHUNK - 400 : suffix_dedup.CHUNK + 400]
    df = spark.createDataFrame([(1, long), (2, "q" * 50 + part + "r" * 20), (3, "z" * 400)], DOCS)
    got = {r.doc_id: r for r in suffix_dedup.removals(df).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (800, 1) and got[2].n_removed == 800 and got[3].n_removed == 400
    assert got[1].kept_sha256 == hashlib.sha256(long.replace(part, "").encode()).hexdigest()


def test_rows_that_repeat_and_empty_tables(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(250))
    df = spark.createDataFrame([(1, text), (1, text), (None, "short"), (None, "short")], DOCS)
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removals(df).collect()) == [
        (False, 250, 250, 1), (False, 250, 250, 1), (True, 5, 0, 0), (True, 5, 0, 0),
    ]
    assert suffix_dedup.removals(df.limit(0)).count() == 0 and suffix_dedup.without_repeats(df.limit(0)).count() == 0


def test_cut_texts_keep_all_columns(spark):
    texts = planted()
    rows = [(i, t, 0, "k") for i, t in enumerate(texts)] + [(None, "no id", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, k1 string")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    want = [w[4].decode("utf-8", "ignore") for w in plain_removals([r[1] for r in rows])]
    assert [got[r[0]].text for r in rows] == want
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[None].k1 is None and got[0].k1 == "k"


def test_op7_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, *w[:4]) for (d, _), w in zip(docs, plain_removals([t for _, t in docs])))
    assert sorted(tuple(r) for r in queries.QUERIES["op7_deep_shallow_suffixes"](spark, SF).collect()) == want


def test_windows_of_hot_anchors_do_not_go_by_way_of_the_driver(spark):
    kinds = "gram long, kind long, least int, largest int, around binary, copies long"
    around = spark.createDataFrame([(1, k, 0, 3, bytes(range(k, k + suffix_dedup.WIDTH + 3)), 1) for k in (1, 2)], kinds)
    plan = suffix_dedup._hot_offsets(around)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
