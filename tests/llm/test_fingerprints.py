"""Operators 2 and 10 against brute force."""

import hashlib
import random
import re

import pytest
import xxhash

from tillsight.llm import minhash, queries, simhash
from tillsight.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (doc_id, fingerprint) rows; smallest reachable id by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(doc)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(prints))]


def test_near_pairs_find_every_pair_of_two_bits(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            changed = base
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                changed ^= 1 << bit
            prints.add(changed)
    signed = sorted(simhash._signed(p) for p in prints)
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and len(want) > 50


def test_dealt_fingerprints_do_not_go_by_way_of_the_driver(spark):
    prints = spark.createDataFrame([(i * 977,) for i in range(50)], "fp long")
    plan = simhash.near_pairs(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_rows_and_defined_cases(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    base = [word() for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(8):
        near = list(base)
        near[rng.randrange(400)] = word()
        texts.append("\t".join(near))
    texts += ["", None, " \n ", "One", "one", "two words", "É É É", "x " * 30000, texts[0], " ".join(word() for _ in range(50))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "two words"), (None, "alone here")]
    df = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", fingerprint int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted((d is None, d or 0, f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints)))
    assert got == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for *_, c in want if c is not None}) and ids.count(None) == 1  # the other one has a copy with an id
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_op2_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d, plain_fingerprint(t)) for d, t in docs]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op2_simhash_pivots"](spark, SF).collect()}
    assert got == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, None), (1003, 4000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in [*range(1000, 1050), 4000])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("buckets", [1, 7])
def test_minhash_against_true_likeness(spark, buckets):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a"), (10**6 + 3, "one two three")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], DOCS + ", near_next double")
    got = {r.doc_id: r for r in minhash.edited_fingerprints(df, buckets).collect()}
    docs.sort(key=lambda d: -d[0])
    off = []
    prints = {}
    for i, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[doc]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [abs(row.near_edited - likeness(text, edited)), abs(row.near_next - likeness(text, after))]
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        assert prints.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint
    assert len(got) == len(docs) and max(off) < 0.25 and sum(off) / len(off) < 0.03


def test_minhash_edges(spark):
    one = minhash.edited_fingerprints(spark.createDataFrame([(1, "alone in the table with some words")], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert minhash.edited_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    same = minhash.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], DOCS)).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1 and all(r.near_next == 1.0 for r in same)
    long = minhash.with_fingerprint(spark.createDataFrame([(1, "w " * 50000)], DOCS)).first()
    assert len(long.fingerprint) == 2 << minhash.BIN_BITS


def test_native_plan_of_op10(spark):
    plan = minhash.edited_fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop|SinglePartition", plan)


def test_one_of_each_decides_by_row(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300))
    x, y, z = text(), text(), text()
    near = x.upper()
    rows = [(3, x), (5, near), (5, y), (5, y), (None, z), (None, z.upper()), (None, z)]
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.text) for r in simhash.one_of_each(spark.createDataFrame(order, DOCS)).collect()]
        assert sorted(r for r in got if r[0] is not None) == [(3, x), (5, y)]
        assert [r[0] for r in got].count(None) == 1
