"""Operator 13 against a plain evaluation of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
from tillsight.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    read = [(d, terms(t)) for d, t in docs]
    read = [(d, Counter(w), len(w)) for d, w in read if w]
    n_docs, n_terms = len(read), sum(n for _, _, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in read:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_whole_table_against_plain_evaluation(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = queries.QUERIES["op13_presence_masks"](spark, sf)
    assert dict(rows.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert got(rows) == plain(docs, items)


def test_defined_cases_and_blocks(spark):
    rnd = random.Random(5)
    words = ["a", "B", "c9", "été", "ÉTÉ", "x_y", "naïve", "日本", "zz", *[f"w{i}" for i in range(150)]]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "\x00", "-"]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(300)] + [(None, text(30)), (None, None), (7, "same words"), (8, "same words"), (8, "same words"), (500, ""), (501, "w1 " * 30000)]
    items = [(i, text(rnd.choice([1, 5, 90, 200]))) for i in range(25)] + [(90, None), (91, ""), (92, "unknown"), (93, "SAME same"), (None, "zz w3"), (93, "w1")]
    left = spark.createDataFrame([(*d, 1.5, "t") for d in docs], "doc_id long, text string, score double, term string").repartition(3)
    right = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    want = plain(docs, items)
    assert got(search.search(left, right)) == want
    assert got(search.search(left, right, block_bytes=400)) == want  # several blocks of items
    assert got(search.search(left, right, top=3)) == plain(docs, items, 3)
    assert search.search(left.limit(0), right).count() == 0 and search.search(left, right.limit(0)).count() == 0


def test_groups_below_the_bound_are_not_scored():
    # documents of 70 terms each hold one rare term or a common one; only the group with the best bound needs scoring
    n = 400
    term, row = np.zeros(n, np.int64), np.arange(n)
    term[:40] = 1
    order = np.lexsort((row, term))
    term, row = term[order], row[order]
    part = np.where(term == 1, 900, 100)
    bits = np.zeros((2, n // 8), np.uint8)
    np.bitwise_or.at(bits, (term, row >> 3), (128 >> (row & 7)).astype(np.uint8))
    best = search.BestOf(20)
    scored = search._search_slice(np.array([0, 1]), np.array([2, 5]), np.searchsorted(term, np.arange(3)), row, part, best, bits, n, np.arange(n), np.zeros(n, bool))
    assert best.score.tolist() == [4500] * 20 and best.doc.tolist() == list(range(20))
    assert scored == n  # both groups fit into the first round
    again = search._search_slice(np.array([0, 1]), np.array([2, 5]), np.searchsorted(term, np.arange(3)), row, part, best, bits, n, np.arange(n) + n, np.zeros(n, bool))
    assert again == 40  # the list's least score rules the other group out


def test_masks_of_more_than_64_terms():
    rnd = np.random.default_rng(1)
    present = rnd.random((130, 50)) < 0.5
    present[:, 25:] = present[:, :25]
    masks, group = search._groups(present)
    assert len(masks) == 25 and (masks[group] == present.T).all()
