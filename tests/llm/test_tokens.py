"""Operators 4, 6 and 9: exact round trips and SQL."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tillsight.llm import backoff, bpe, packing, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "a" * 5000, " " * 30000 + "x", "\t\n\x1c\x85  é", "日本語 عربى 😀😀", "<|endoftext|> it's we'll 123 4٤", "same", "same"]


def texts(spark):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(ODD)] + [(5, "five again"), (None, "no id")]
    return rows + [(10**7 + i, "".join(rng.choice("ab \n'tsé1.! ") for _ in range(rng.randrange(40)))) for i in range(100)]


def test_bpe_is_what_the_library_gives(spark):
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = texts(spark)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted(
        (str(d), len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
        for d, t in rows
        for ids in [library.encode_ordinary(t or "")]
    )
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_tokens int")
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trips(df).collect()) == want
    back = bpe.decoded(bpe.encoded(df)).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(d), (t or "").encode()) for d, t in rows)
    assert bpe.round_trips(df.limit(0)).count() == 0


def test_single_and_side_by_side_trees_agree():
    model = bpe.Bpe()
    rng = random.Random(8)
    pieces = ["".join(rng.choice("abehinrst ") for _ in range(rng.randrange(2, 100))).encode() for _ in range(300)]
    for piece in pieces:
        leaves = 1 << (len(piece) - 1).bit_length()
        assert model.merge_rows([piece, piece[::-1]], leaves)[0].tolist() == model.merge_one(piece)


def test_hilbert_curve_steps_to_a_neighbour():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side**dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing_places_every_id_once(spark):
    rows = [r for r in texts(spark) if r[0] != 5] + [(5, "five")]
    df = spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", start string")
    pieces = packing.packed(df).collect()
    encode = packing.encoder("byte_bpe_50k.json")
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {d for d, _ in rows}
    for doc, text in rows:
        ids, at = np.append(encode(text or ""), 0).astype("<u4"), 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded
    assert packing.packed(df.limit(0)).count() == 0


def test_packing_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], DOCS)
    assert sum(p.length for p in packing.packed(df).collect()) == 3 * (packing.encoder(packing.VOCABULARY)("a b c").size + 1)


def test_backoff_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(backoff.ORACLE).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op9_stupid_backoff"](spark, SF).collect()) == want


def test_backoff_defined_cases(spark):
    rows = [(1, "a b a b"), (2, "A B c"), (3, None), (4, " \n"), (5, "zz"), (None, "a b"), (6, "a"), (6, "b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", n int")
    got = {r.doc_id: r for r in backoff.scores(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    assert got[3].n_words == 0 and got[3].score is None and got[4].score is None
    # "a b" occurs in three documents, "b a" in the first alone
    assert (got[1].n_seen, got[2].n_seen, got[None].n_seen, got[6].n_words) == (2, 1, 1, 2)
    n, a, b = 12, 5, 5
    want = [np.log(a / n), np.log(2 / a), np.log(0.4 * a / n), np.log(2 / a)]
    assert abs(got[1].score - np.mean(want)) < 1e-12
    assert backoff.scores(df.limit(0)).count() == 0


def plain_backoff(rows):
    """Scores by counting every word and bigram in dictionaries; ids are unique."""
    words = {d: t.lower().encode().split() for d, t in rows}
    uni, big = Counter(), Counter()
    for w in words.values():
        uni.update(w)
        big.update(zip(w, w[1:]))
    total = sum(uni.values())
    out = {}
    for d, w in words.items():
        own, seen, logs = Counter(zip(w, w[1:])), 0, [np.log(uni[x] / total) for x in w[:1]]
        for pair in zip(w, w[1:]):
            left = big[pair] - own[pair]
            seen += left > 0
            logs.append(np.log(left / uni[pair[0]]) if left else np.log(0.4 * uni[pair[1]] / total))
        out[d] = (len(w), seen, float(np.mean(logs)))
    return out


def test_backoff_counts_every_word_of_a_large_vocabulary(spark):
    # 205,000 words of two documents each and a filler that puts them below one in 200,000
    rows = [(i, " ".join(f"w{j}é" for j in range(50 * i, 50 * i + 50))) for i in range(4100)]
    rows += [(10_000 + i, t + " end") for i, t in rows]
    rows += [(20_000 + i, "the of the of " * 20) for i in range(1000)] + [(30_000 + i, "the of w1é w2é x") for i in range(20)]
    want = plain_backoff(rows)
    got = {r.doc_id: r for r in backoff.scores(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got) == set(want)
    for d, (n, seen, score) in want.items():
        assert (got[d].n_words, got[d].n_seen) == (n, seen) and abs(got[d].score - score) < 1e-9


def test_backoff_does_not_depend_on_shards(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"v{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    rows.append((999, "v1 v2 " * 60_000))  # a very long text
    want = plain_backoff(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for shard_bytes in (1, 500, 1 << 24):
        got = {r.doc_id: r for r in backoff.scores(df, shard_bytes=shard_bytes).collect()}
        assert set(got) == set(want)
        assert all((got[d].n_words, got[d].n_seen) == v[:2] and abs(got[d].score - v[2]) < 1e-9 for d, v in want.items())


def test_packing_gives_the_tokenizer_files_ids_for_added_tokens():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(packing.VOCABULARY)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "plain it's we'll 123", "<|endoftext| >", ""):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
