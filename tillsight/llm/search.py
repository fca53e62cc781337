"""Ranked lexical search: documents grouped by the mask of the query terms they hold (operator 13).

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, only
A-Z lower-cased.  With N documents that hold a term, L terms in all, n terms of
a document, df documents that hold a term and tf its occurrences in one:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))     m = 75 + (25 n N) div L
    score = sum over the query's terms, repeats included, of w ((10^9 tf) div (1000 tf + 12 m))

The queries are the stated set; they are taken in blocks of about
``BLOCK_BYTES`` of text, whose terms are broadcast.  For a block, one scan
counts N, L and df, a second one ranks.  There, each slice of documents gets a
bitmap per term of the documents that hold it.  An item's bitmaps, laid side by
side, give every document the mask of the item's terms it holds; documents of
equal mask are one group, whose score cannot exceed the sum, over the mask, of
w times the term's best quotient in the slice.  Groups are scored from the
highest bound down until the bound falls below the least score on the item's
list; a task keeps one list of the best ``TOP`` for each item, so later slices
stop sooner.  The lists of all tasks are ranked in two steps.

Terms are compared by a 64-bit hash that includes their length.  Defined cases:
null text holds no term; an item without terms, or with none that any document
holds, gets no row; equal scores by ascending doc_id, null ids last; repeated
rows are documents, and items, of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import byte_slices, hashed_runs, split_text

TOP = 20
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 22
#: Groups of the first round of scoring; each further round takes twice as many.
FIRST_GROUPS = 32


def _term_bytes() -> np.ndarray:
    byte = np.arange(256)
    return (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))


def terms_of(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the terms of texts laid end to end, in order."""
    starts, _, hashes = hashed_runs(data, _term_bytes()[np.frombuffer(data, np.uint8)], offsets, lower=True)
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


class Queries:
    """A block of items: its terms' hashes in order, and each item's (terms, occurrences)."""

    def __init__(self, hashes: np.ndarray, ids: list, terms: list[tuple[np.ndarray, np.ndarray]]):
        self.hashes, self.ids, self.terms = hashes, ids, terms

    @staticmethod
    def read(items: list[tuple[int | None, str | None]]) -> tuple:
        """The arguments of ``Queries``, plain so that they can be broadcast."""
        row, h = terms_of(*split_text(pa.array([text for _, text in items], pa.string())))
        hashes, term = np.unique(h, return_inverse=True)
        cuts = np.searchsorted(row, np.arange(len(items) + 1))
        return hashes, [item for item, _ in items], [np.unique(term[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:])]

    def postings(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text; (term, text, tf) of the block's terms, in this order."""
        row, h = terms_of(*split_text(text))
        n = np.bincount(row, minlength=len(text))
        if not len(self.hashes):
            return n, *(np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        keys, tf = np.unique(at[hit] * len(text) + row[hit], return_counts=True)
        return n, keys // max(1, len(text)), keys % max(1, len(text)), tf


def _counts(queries):
    """(term, df) of a task's documents; N under term -1, L under -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Queries(*queries.value)
        df = np.zeros(len(block.hashes) + 2, np.int64)
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            n, term, _, _ = block.postings(batch.column("text"))
            df[:-2] += np.bincount(term, minlength=len(block.hashes))
            df[-2:] += int(n.sum()), int((n > 0).sum())
        found = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.where(found >= len(df) - 2, found - len(df), found)), pa.array(df[found])], names=["term", "df"])

    return run


def _groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks (mask x term) of a (term x document) matrix, and each document's."""
    packed = np.packbits(present, axis=0)
    words = np.zeros((present.shape[1], -(-len(packed) // 8) * 8), np.uint8)
    words[:, : len(packed)] = packed.T
    words = words.view(np.uint64)
    if words.shape[1] == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return present[:, first].T, group.ravel()


class BestOf:
    """The best ``top`` of an item's documents so far: score descending, id ascending, null ids last."""

    def __init__(self, top: int):
        self.top = top
        self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def least(self) -> int:
        """Below this no document gets onto the list any more."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least()
        score, doc, null = (np.append(a, b[good]) for a, b in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def _search_slice(terms, weights, cuts, docs, part, best, bitmaps, n_docs, ids, null) -> int:
    """Put a slice's documents onto one item's list; returns how many had to be scored.

    ``cuts`` delimits each term's postings in ``docs`` and ``part``.
    """
    held = cuts[terms + 1] > cuts[terms]
    terms, weights = terms[held], weights[held]
    if not len(terms):
        return 0
    present = np.unpackbits(bitmaps[terms], axis=1, count=n_docs).astype(bool)
    some = np.flatnonzero(present.any(axis=0))
    masks, group = _groups(present[:, some])
    most = np.array([part[cuts[t] : cuts[t + 1]].max() for t in terms]) * weights
    bound = masks.astype(np.int64) @ most
    by_group = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(masks)))
    order = np.argsort(-bound, kind="stable")
    at, step, scored = 0, FIRST_GROUPS, 0
    while at < len(order) and bound[order[at]] >= best.least():
        chosen = order[at : at + step]
        chosen = chosen[bound[chosen] >= best.least()]
        rows = np.sort(np.concatenate([by_group[(ends[g - 1] if g else 0) : ends[g]] for g in chosen]))
        own, score = some[rows], np.zeros(len(rows), np.int64)
        for j in np.flatnonzero(masks[chosen].any(axis=0)):
            a, b = cuts[terms[j]], cuts[terms[j] + 1]
            with_term = np.flatnonzero(present[j, own])
            score[with_term] += weights[j] * part[a + np.searchsorted(docs[a:b], own[with_term])]
        best.add(score, ids[own], null[own])
        scored += len(own)
        at, step = at + step, step * 2
    return scored


def _ranked(queries, weights, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Queries(*queries.value)
        best = [BestOf(top) for _ in block.ids]
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            n, term, row, tf = block.postings(batch.column("text"))
            m = 75 + 25 * n * n_docs // max(1, n_terms)
            part = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
            cuts = np.searchsorted(term, np.arange(len(block.hashes) + 1))
            width = -(-len(batch) // 8)
            bit = np.bincount(term * width + (row >> 3), (128 >> (row & 7)), minlength=len(block.hashes) * width)
            bitmaps = bit.astype(np.uint8).reshape(len(block.hashes), width)
            column = batch.column("doc_id")
            null = column.is_null().to_numpy(zero_copy_only=False)
            ids = column.fill_null(0).to_numpy()
            for (terms, times), list_ in zip(block.terms, best):
                _search_slice(terms, weights[terms] * times, cuts, row, part, list_, bitmaps, len(batch), ids, null)
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        joined = lambda name, kind: np.concatenate([getattr(b, name) for b in best]) if best else np.zeros(0, kind)
        yield pa.record_batch(
            [
                pa.array(item.astype(np.int64)), pa.array([block.ids[i] for i in item], pa.int64()),
                pa.array(joined("doc", np.int64), mask=joined("null", bool)), pa.array(joined("score", np.int64)),
            ],
            names=["item", "item_id", "doc_id", "score"],
        )

    return run


def search(documents: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    lists = None
    for b in range(blocks):
        # about block_bytes of query text, the bound of what the driver gathers and broadcasts
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        queries = spark.sparkContext.broadcast(Queries.read([(r["item_id"], r["text"]) for r in rows]))
        sums = docs.select("text").mapInArrow(_counts(queries), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = {r["term"]: r["df"] for r in sums.collect()}  # a row per term of the block
        n_docs, n_terms = df.get(-1, 0), df.get(-2, 0)
        weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))
        weights = np.array([weight(t) for t in range(len(queries.value[0]))], np.int64)
        found = docs.mapInArrow(
            _ranked(queries, weights, n_docs, n_terms, top), "item long, item_id long, doc_id long, score long"
        )
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        part = found.select("item_id", "rank", "doc_id", "score")
        lists = part if lists is None else lists.union(part)
    return lists


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH tok AS (
  SELECT doc_id, {_TOKENS} AS w FROM documents
), doc AS (
  SELECT doc_id, w, len(w) AS n FROM tok WHERE len(w) > 0
), tot AS (
  SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM doc
), post AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM doc) GROUP BY ALL
), freq AS (
  SELECT term, count(*) AS df FROM post GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL
), part AS (
  SELECT a.item_id, p.doc_id,
    a.q * floor(1000 * ln((2 * t.nn + 2) / (2 * f.df + 1)))::BIGINT
        * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * t.nn) // t.ll))) AS s
  FROM asked a JOIN post p ON a.term = p.term JOIN freq f ON a.term = f.term, tot t
), total AS (
  SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM part GROUP BY ALL HAVING sum(s) > 0
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM total
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
