"""Operator 11 against counting every window."""

import hashlib
import random
import re
from collections import Counter

from tillsight.llm import phrases, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts, width):
    """(n_words, n_removed, kept words) of each text."""
    read = [WORD.findall(t or "") for t in texts]
    times = Counter(tuple(w[i : i + width]) for w in read for i in range(len(w) - width + 1))
    out = []
    for w in read:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if times[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def digests(rows, width):
    return sorted(((d, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for (d, _), (n, g, k) in zip(rows, plain([t for _, t in rows], width))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table_against_counting(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = digests(docs, phrases.WIDTH)
    assert got(queries.QUERIES["op11_phrase_automata"](spark, sf)) == want
    assert sum(1 for w in want if 0 < w[2] < w[1]) > 20


def messy(seed):
    """Few words, so that windows, anchors and passages recur in many ways."""
    rnd = random.Random(seed)
    words = ["a", "b", "ab", "é", "日本", "x."]
    pool = [[rnd.choice(words) for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(150):
        own = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(pool)
            a = rnd.randint(0, 30)
            own += p[a : a + rnd.randint(1, 25)] + [rnd.choice(words + [f"u{i}"])]
        rows.append((i, "".join(w + rnd.choice([" ", "\n", "\t ", "\x0b"]) for w in own)))
    rows += [(None, rows[3][1]), (7, rows[7][1]), (200, None), (201, " \t"), (202, "a " * 5000), (203, "q r s t u v w " * 3), (None, None)]
    return rows


def test_defined_cases_at_every_limit(spark):
    rows = messy(3)
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id long, text string, k1 int, copies int, around string").repartition(3)
    for width, limits in ((12, {}), (12, {"hot": 3}), (9, {"block_rows": 40, "shard_words": 100}), (35, {"hot": 1})):
        assert got(phrases.removals(df, width, **limits)) == digests(rows, width), (width, limits)
    kept = phrases.without_repeats(df, 12)
    assert kept.columns == df.columns
    want = {d: " ".join(k) for (d, t), (n, g, k) in zip(rows, plain([t for _, t in rows], 12)) if g and d is not None}
    by_id = {r.doc_id: r.text for r in kept.collect() if r.doc_id in want}
    assert {d: by_id[d] for d in want if d != 7} == {d: w for d, w in want.items() if d != 7}
    assert phrases.removals(df.limit(0)).count() == 0 and phrases.without_repeats(df.limit(0)).count() == 0


def test_spans_are_those_of_the_input(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"one two {shared} three"), (2, f"{shared} four")], "doc_id long, text string")
    rows = {r.kept: [(s.start, s.end) for s in r.spans] for r in phrases.cut_texts(df).collect()}
    assert rows == {"one two three": [(2, 42)], "four": [(0, 40)]}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_phrases")]  # nothing stays in the catalog


def test_a_passage_is_found_wherever_it_occurs():
    passages = [("a", "b", "c"), ("b", "c", "d", "e"), ("x",)]
    text = "a b c d e x b c d e".split()
    for shard in (1, 100):
        found = [(e + 1 - n, e + 1) for auto, num in phrases.automata(passages, shard) for e, n in auto.iter(tuple(num.get(w, 0) for w in text))]
        assert sorted(found) == [(0, 3), (1, 5), (5, 6), (6, 10)]
    assert phrases.merged([(6, 10), (0, 3), (1, 5), (5, 6)]) == [(0, 10)]
