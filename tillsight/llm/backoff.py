"""LM scoring by stupid backoff over word bigrams of the corpus itself (operator 9).

Words are lower-cased and split at ASCII white space.  Every word and every
bigram of the corpus counts, however rare.  With c the count over all texts,
N the number of words, and c' the count over all texts but the scored one:

    S(w2 | w1) = c'(w1 w2) / c(w1)     where c'(w1 w2) > 0
    S(w2 | w1) = ALPHA * c(w2) / N     otherwise
    S(w)       = c(w) / N              for the first word

A document's score is the mean of ln S over its words.  The counts are a table
partitioned by n-gram hash, joined to the n-grams that the documents are
exploded to; both sides travel as sorted blocks instead of rows:

1. Texts are dealt into shards of about ``SHARD_BYTES`` as they are read, each
   written with its number.
2. A shard's n-grams, explode and summed, are cut by hash into ranges.  A range
   gets every shard's block of distinct hashes and counts, adds them up, and
   gives each shard the totals of its hashes, in their order.
3. A shard's texts and totals meet by its number; the shard's distinct hashes,
   in order, are those the totals belong to.  Looking them up gives each text
   the sum of its logarithms, and texts of one id are added.

A frequent n-gram is one entry of a shard's block, however often it occurs, so
no n-gram is a hot key; a shard and a range are what a task holds.

N-grams are told apart by 64-bit hashes.  Defined cases: null text is empty; a
document without words has n_words 0 and a null score; the texts of rows that
share an id (null included) are scored each by itself and make one result; a
very long text is a shard of its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import byte_slices, hashed_runs, mixed, split_text, written

ALPHA = 0.4
SHARD_BYTES = 8 << 20
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the text each is of, and the words of each text."""
    data, offsets = split_text(text)
    starts, _, hashes = hashed_runs(data, ~_SPACE[np.frombuffer(data, np.uint8)], offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, row, np.bincount(row, minlength=len(text))


def _sharded(shard_bytes: int):
    """Numbers the texts of a task by shards; ``part`` is the task's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = 0, 0
        for batch in byte_slices(batches, "text", max(1, shard_bytes // 4)):
            size = len(split_text(batch.column("text"))[0])
            if held and held + size > shard_bytes:
                shard, held = shard + 1, 0
            held += size
            number = pa.array((batch.column("part").to_numpy().astype(np.int64) << 32) + shard)
            columns = [number, batch.column("doc_id"), batch.column("text"), pa.array(_words(batch.column("text"))[2])]
            yield pa.record_batch(columns, names=["shard", "doc_id", "text", "n_words"])

    return run


class Grams:
    """The words and bigrams of texts: hashes, and the text each is of."""

    def __init__(self, texts: list[pa.Array]):
        words, rows, base = [], [], 0
        for text in texts:
            hashes, row, _ = _words(text)
            words.append(hashes)
            rows.append(row + base)
            base += len(text)
        self.n_texts = base
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.second = np.flatnonzero(self.row[1:] == self.row[:-1]) + 1  # words with one before them in their text
        self.pairs = mixed(self.words[self.second - 1] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.second])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes, of words and of pairs, and their counts."""
        keys = np.concatenate((self.words, self.pairs))
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.diff(np.append(first, len(keys)))


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, the low bytes of all first, so that a shuffle's compression folds what is zero."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows of one shard."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if shard[a] != now and held:
                yield now, held
                held = []
            now = int(shard[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def _blocks(ranges: int):
    """A shard's distinct hashes, as differences, and counts, a row for each range of hashes."""
    bounds = np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            keys, times = Grams([x.column("text") for x in rows]).counts()
            cuts = np.append(np.searchsorted(keys, bounds), len(keys))
            own = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
            blocks = [(_packed(np.diff(keys[cuts[r] : cuts[r + 1]], prepend=np.uint64(0))), _packed(times[cuts[r] : cuts[r + 1]])) for r in own]
            yield pa.record_batch(
                [pa.array(own, pa.int32()), pa.array([shard] * len(own), pa.int64()), *(pa.array([x[k] for x in blocks], pa.binary()) for k in (0, 1))],
                names=["range", "shard", "keys", "times"],
            )

    return run


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and shard: gives each shard the totals of its hashes of the range."""

    def given(r: int, blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, times = _summed([b[1] for b in blocks], [b[2] for b in blocks])
        shards, out, at = [], [], 0
        while at < len(blocks):
            end = at + 1
            while end < len(blocks) and blocks[end][0] == blocks[at][0]:
                end += 1  # a shard whose rows were read by several tasks
            own = blocks[at][1] if end == at + 1 else np.unique(np.concatenate([b[1] for b in blocks[at:end]]))
            shards.append(blocks[at][0])
            out.append(_packed(times[np.searchsorted(keys, own)]))
            at = end
        return pa.record_batch([pa.array([r] * len(shards), pa.int32()), pa.array(shards, pa.int64()), pa.array(out, pa.binary())], names=["range", "shard", "totals"])

    now, held = None, []
    for batch in batches:
        for r, shard, keys, times in zip(*(batch.column(c).to_pylist() for c in ("range", "shard", "keys", "times"))):
            if r != now and held:
                yield given(now, held)
                held = []
            now = r
            held.append((shard, np.cumsum(_unpacked(keys, np.uint64), dtype=np.uint64), _unpacked(times, np.int64)))
    if held:
        yield given(now, held)


def _scored(total: int, alpha: float):
    """Rows come sorted by shard, its totals first, in order of their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            totals = np.concatenate([np.zeros(0, np.int64), *(_unpacked(t, np.int64) for x in rows for t in x.column("totals").to_pylist() if t is not None)])
            rows = [x.filter(x.column("range").is_null()) for x in rows]
            grams = Grams([x.column("text") for x in rows])
            keys, _ = grams.counts()
            assert len(keys) == len(totals), "a shard's totals are not those of its texts"
            n_words = len(grams.words)
            logs = np.log(totals[np.searchsorted(keys, grams.words)])
            pair = np.searchsorted(keys, grams.pairs)
            value = logs + (math.log(alpha) - math.log(total) if total else 0.0)
            first = np.ones(n_words, bool)
            first[grams.second] = False
            value[first] -= math.log(alpha)
            own, at, times = np.unique(grams.row[grams.second] * np.int64(len(keys) + 1) + pair, return_inverse=True, return_counts=True)
            others = (totals[own % (len(keys) + 1)] - times)[at]  # of each pair, without its own text
            seen = others > 0
            value[grams.second[seen]] = np.log(others[seen]) - logs[grams.second[seen] - 1]
            count = lambda row, weights=None: np.bincount(row, weights, minlength=grams.n_texts)
            yield pa.record_batch(
                [
                    pa.concat_arrays([x.column("doc_id") for x in rows]), pa.array(count(grams.row)),
                    pa.array(count(grams.row[grams.second[seen]])), pa.array(count(grams.row, value), pa.float64()),
                ],
                names=["doc_id", "n_words", "n_seen", "part"],
            )

    return run


def scores(documents: DataFrame, alpha: float = ALPHA, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_seen, score): n_seen of its bigrams also occur in other documents."""
    spark = documents.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(
        F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")
    )
    docs = written(texts.mapInArrow(_sharded(shard_bytes), "shard long, doc_id long, text string, n_words long"), "shards", compression="zstd")
    total = docs.agg(F.sum("n_words")).first()[0] or 0
    blocks = docs.select("shard", "text").mapInArrow(_blocks(ranges), "range int, shard long, keys binary, times binary")
    totals = blocks.repartition(ranges, "range").sortWithinPartitions("range", "shard").mapInArrow(_totals, "range int, shard long, totals binary")
    both = docs.select("shard", F.lit(None).cast("int").alias("range"), "doc_id", "text", F.lit(None).cast("binary").alias("totals")).union(
        totals.select("shard", "range", F.lit(None).cast("long"), F.lit(None).cast("string"), "totals")
    )
    met = both.repartition(ranges, "shard").sortWithinPartitions("shard", F.asc_nulls_last("range"))
    parts = met.mapInArrow(_scored(total, alpha), "doc_id long, n_words long, n_seen long, part double")
    whole = parts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_seen").alias("n_seen"), F.sum("part").alias("part"))
    return whole.select("doc_id", "n_words", "n_seen", F.when(F.col("n_words") > 0, F.col("part") / F.col("n_words")).alias("score"))


#: The same scores by joins of the count tables.
ORACLE = f"""
WITH tok AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda x: x != '') AS w
  FROM documents
), pos AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tok
), uni AS (
  SELECT word, count(*) AS n FROM pos GROUP BY word
), tot AS (
  SELECT count(*) AS total FROM pos
), seq AS (
  SELECT p.r, p.i, p.word, u.n AS c, lag(p.word) OVER d AS prev, lag(u.n) OVER d AS prev_c
  FROM pos p JOIN uni u ON p.word = u.word WINDOW d AS (PARTITION BY p.r ORDER BY p.i)
), big AS (
  SELECT prev, word, r, count(*) AS n FROM seq WHERE prev IS NOT NULL GROUP BY ALL
), oth AS (
  SELECT prev, word, r, sum(n) OVER (PARTITION BY prev, word) - n AS others FROM big
), val AS (
  SELECT s.r,
    CASE WHEN s.i = 1 THEN ln(s.c / (SELECT total FROM tot))
         WHEN o.others > 0 THEN ln(o.others / s.prev_c)
         ELSE ln({ALPHA} * s.c / (SELECT total FROM tot)) END AS v,
    CASE WHEN o.others > 0 THEN 1 ELSE 0 END AS seen
  FROM seq s LEFT JOIN oth o ON s.r = o.r AND s.prev = o.prev AND s.word = o.word
)
SELECT t.doc_id, count(v.v)::BIGINT AS n_words, coalesce(sum(v.seen), 0)::BIGINT AS n_seen, round(avg(v.v), 6) AS score
FROM tok t LEFT JOIN val v ON t.r = v.r GROUP BY t.doc_id
"""
