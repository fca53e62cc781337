"""Substring dedup by repeated-phrase automata: words covered by a 35-word window that also starts elsewhere (operator 11).

Words are maximal runs without ASCII white space, unchanged; a text counts as
its words, joined by one space.  Steps:

1. Equal texts are counted; one of each goes on (a text that occurs twice is
   covered whole).
2. Each window of ``WIDTH`` words names the run of ``GRAM`` words in it whose
   hash is least (the first of equals): its anchor.  Equal windows have equal
   anchors at equal places, so only windows whose anchor recurs can recur.
3. The surroundings of recurring anchors (at most 2 ``WIDTH`` words), equal ones
   summed, are dealt out by anchor and taken in blocks of whole anchors.  In a
   block the windows are counted word by word; those met twice confirm a
   recurring passage: the union of such windows around one anchor.
4. The block's distinct passages are compiled into Aho-Corasick automata over
   word numbers, sharded by ``SHARD_WORDS``, and all surroundings are streamed
   through them.  A passage is covered wherever it occurs, because each of its
   words lies in a recurring window; and every recurring window lies in a
   passage of its own text.  So the matches are exactly what is covered.
5. A text's matches are merged and cut out.

An anchor of more than ``HOT`` occurrences does not meet in one task: its
windows are dealt out and counted by themselves, with the same result (tested).

Defined cases: null text has no words; matches never cross texts; texts under
``WIDTH`` words lose nothing; repeated rows count as other documents, null ids
included; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import byte_slices, hashed_runs, mixed, scratch_name, split_text, written, written_in_buckets

WIDTH = 35
GRAM = 8
HOT = 4_000
BLOCK_ROWS = 8_000
#: Words of the passages of one automaton.
SHARD_WORDS = 400_000
#: Windows of a very long text that are looked at together; places fit into 24 bits.
CHUNK = 1 << 22
KEYS = ["k1", "k2"]


def normal(text: str | Column) -> Column:
    """The words of a text, joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def count_words(words: Column) -> Column:
    """Number of words of a text that ``normal`` returned."""
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.translate(words, " ", "")) + 1).cast("long")


def find_anchors(words: np.ndarray, row: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(place, hash, least and largest offset of its windows) of the anchors of word hashes in a row.

    ``row`` numbers the texts the words are of.
    """
    n = len(words) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    h = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)]
    h = mixed(h)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = width - gram + 1  # grams in a window
    padded = np.full(-(-len(key) // span) * span, ~np.uint64(0))
    padded[: len(key)] = key
    square = padded.reshape(-1, span)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = (np.minimum(after[:n], before[span - 1 : span - 1 + n]) & low).astype(np.int64)
    window = np.flatnonzero(row[:n] == row[width - 1 :])
    if not len(window):
        return none, none, none, none
    owner = owner[window]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    return at, h[at].view(np.int64), at - window[last], at - window[first]


def _anchor_batches(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            data, offsets = split_text(batch.column("text"))
            starts, _, words = hashed_runs(data, np.frombuffer(data, np.uint8) != 32, offsets)
            row = np.searchsorted(offsets, starts, side="right") - 1
            begin = np.searchsorted(row, np.arange(len(batch)))
            for c in range(0, len(words), CHUNK):
                end = c + CHUNK + width - 1
                at, hashes, least, largest = find_anchors(words[c:end], row[c:end], width, gram)
                own = row[c + at]
                yield pa.record_batch(
                    [batch.column(k).take(pa.array(own)) for k in KEYS]
                    + [pa.array(hashes), pa.array((c + at - begin[own]).astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(largest.astype(np.int32))],
                    names=[*KEYS, "gram", "pos", "least", "largest"],
                )

    return run


_PLACES = "gram long, kind long, k1 long, k2 long, pos int, n long, largest int, around string, copies long"


def _place_batches(width: int):
    """Occurrences of recurring anchors; the first of each kind in a slice carries the surroundings and how often the slice has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary())
            k1, k2 = (batch.column(k).to_pylist() for k in KEYS)
            first: dict[tuple[int, int], int] = {}
            out: list[list] = []
            for i, anchors in enumerate(batch.column("anchors").to_pylist()):
                text = texts[i].as_py()
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                starts, ends = np.append(0, spaces + 1).tolist(), np.append(spaces, len(text)).tolist()
                for a in anchors:
                    pos, largest = a["pos"], a["largest"]
                    around = text[starts[pos - largest] : ends[pos + width - a["least"] - 1]]
                    kind = xxhash.xxh64_intdigest(around, largest) - (1 << 63)
                    met = first.setdefault((a["gram"], kind), len(out))
                    out.append([a["gram"], kind, k1[i], k2[i], pos, a["n"], largest, around if met == len(out) else None, 0])
                    out[met][-1] += 1
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
                names = [f.split()[0] for f in _PLACES.split(", ")]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def confirmed(around: list[list[str]], copies: list[int], width: int) -> list[tuple[int, int]]:
    """For each surroundings, the bounds of the union of its windows that recur among all of them; (0, 0) if none does."""
    windows = [[" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] for words in around]
    times: Counter[str] = Counter()
    for own, n in zip(windows, copies):
        for window in own:
            times[window] += n
    out = []
    for own in windows:
        again = [i for i, window in enumerate(own) if times[window] > 1]
        out.append((again[0], again[-1] + width) if again else (0, 0))
    return out


def automata(passages: list[tuple[str, ...]], shard_words: int) -> Iterator[tuple[ahocorasick.Automaton, dict[str, int]]]:
    """Automata over the distinct passages, and the numbers of their words; each matches with the passage's length."""
    at = 0
    while at < len(passages):
        numbers: dict[str, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        held = 0
        while at < len(passages) and (not held or held + len(passages[at]) <= shard_words):
            automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in passages[at]), len(passages[at]))
            held += len(passages[at])
            at += 1
        automaton.make_automaton()
        yield automaton, numbers


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, with the same cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _located_batches(width: int, block_rows: int, shard_words: int):
    """Rows come sorted by anchor; whole anchors are gathered to blocks."""

    def locate(block: pa.Table) -> pa.RecordBatch:
        rows = block.group_by(["gram", "kind"]).aggregate([("copies", "sum"), ("largest", "min"), ("around", "min")])
        around = [text.split(" ") for text in rows.column("around_min").to_pylist()]
        spans = confirmed(around, rows.column("copies_sum").to_pylist(), width)
        passages = list(dict.fromkeys(tuple(words[a:b]) for words, (a, b) in zip(around, spans) if b))
        found: list[list[tuple[int, int]]] = [[] for _ in around]
        for automaton, numbers in automata(passages, shard_words):
            for words, own in zip(around, found):
                for end, length in automaton.iter(tuple(numbers.get(w, 0) for w in words)):
                    own.append((end + 1 - length, end + 1))
        largest = rows.column("largest_min").to_pylist()
        out = [(i, a - largest[i], b - largest[i]) for i, own in enumerate(found) for a, b in merged(own)]
        row = pa.array([x[0] for x in out], pa.int64())
        return pa.record_batch(
            [rows.column("gram").combine_chunks().take(row), rows.column("kind").combine_chunks().take(row)]
            + [pa.array([x[k] for x in out], pa.int32()) for k in (1, 2)],
            names=["gram", "kind", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            count += len(batch)
            if count < block_rows:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            other = np.flatnonzero(gram != gram[-1])
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield locate(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
            count = sum(map(len, held))
        if count:
            yield locate(pa.Table.from_batches(held))

    return run


def _hot_located(around: DataFrame, width: int) -> DataFrame:
    """The same as ``_located_batches`` for anchors of any number of occurrences, by counting their windows."""
    rows = around.groupBy("gram", "kind", "largest", "around").agg(F.sum("copies").alias("copies"))
    words = F.split("around", " ", -1)
    windows = rows.withColumn("words", words).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - width))).select(
        "gram", "kind", "largest", "copies", "at", F.md5(F.array_join(F.slice("words", F.col("at") + 1, width), " ").cast("binary")).alias("window")
    )
    again = windows.groupBy("gram", "window").agg(F.sum("copies").alias("times")).where("times > 1").drop("times")
    found = windows.join(again, ["gram", "window"], "left_semi").groupBy("gram", "kind").agg(
        F.min(F.col("at") - F.col("largest")).cast("int").alias("start"), F.max(F.col("at") - F.col("largest") + width).cast("int").alias("end")
    )
    return found.select("gram", "kind", "start", "end")


def spans(texts: DataFrame, width: int = WIDTH, hot: int = HOT, block_rows: int = BLOCK_ROWS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(k1, k2, spans) of the distinct texts that have words covered by a recurring window; spans may overlap."""
    anchors = written(
        texts.mapInArrow(_anchor_batches(width, min(GRAM, width)), "k1 long, k2 long, gram long, pos int, least int, largest int"), "phrase-anchors"
    )
    # written, so that the join below meets plain shuffles, whose hot partitions Spark splits
    again = written(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "phrase-recurring")
    of_text = anchors.join(again, "gram").groupBy(*KEYS).agg(
        F.collect_list(F.struct("gram", "pos", "least", "largest", "n")).alias("anchors")  # a text's own anchors
    )
    places = written(texts.join(of_text, KEYS).select(*KEYS, "text", "anchors").mapInArrow(_place_batches(width), _PLACES), "phrase-places")
    around = places.where("around is not null").select("gram", "kind", "largest", "around", "copies", "n")
    cool = around.where(F.col("n") <= hot).drop("n").repartition("gram").sortWithinPartitions("gram")
    located = cool.mapInArrow(_located_batches(width, block_rows, shard_words), "gram long, kind long, start int, end int")
    located = written(located.union(_hot_located(around.where(F.col("n") > hot), width)), "phrase-spans")
    span = F.struct((F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"))
    return places.select("gram", "kind", *KEYS, "pos").join(located, ["gram", "kind"]).groupBy(*KEYS).agg(F.collect_list(span).alias("spans"))


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text"):
        kept, counts, covered = [], [], []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words, left, at = text.split(" "), [], 0
            cover = merged([(s["start"], s["end"]) for s in own])
            for start, end in cover:
                left += words[at:start]
                at = end
            left += words[at:]
            kept.append(" ".join(left))
            counts.append(len(left))
            covered.append([{"start": a, "end": b} for a, b in cover])
        yield pa.record_batch(
            [
                batch.column("k1"), batch.column("k2"), pa.array(kept, pa.string()), pa.array(counts, pa.int64()),
                pa.array(covered, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            names=["k1", "k2", "kept", "n_kept", "spans"],
        )


def _keyed(text: str) -> tuple[Column, Column, Column]:
    """The normal text and two hashes that name it."""
    words = normal(text)
    return words, F.xxhash64(words), F.xxhash64(F.lit(1), words)


def cut_texts(documents: DataFrame, width: int = WIDTH, **limits: int) -> DataFrame:
    """(k1, k2, kept, n_kept, spans) of each distinct text of ``width`` words or more that loses words; spans are disjoint [start, end) in words.

    Texts that occur more than once lose all; their spans are one.
    """
    words, k1, k2 = _keyed("text")
    rows = documents.select(k1.alias("k1"), k2.alias("k2"), words.alias("text")).where(count_words(F.col("text")) >= width)
    texts = written_in_buckets(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), KEYS, "llm_phrases")
    cut = texts.where("copies = 1").join(spans(texts, width, **limits), KEYS).select(*KEYS, "text", "spans")
    schema = "k1 long, k2 long, kept string, n_kept long, spans array<struct<start:int,end:int>>"
    whole = F.array(F.struct(F.lit(0).alias("start"), count_words(F.col("text")).cast("int").alias("end")))
    copied = texts.where("copies > 1").select(*KEYS, F.lit("").alias("kept"), F.lit(0).cast("long").alias("n_kept"), whole.alias("spans"))
    return cut.mapInArrow(_kept_batches, schema).union(copied)


def removals(documents: DataFrame, width: int = WIDTH, **limits: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    words, k1, k2 = _keyed("text")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    cut = written(cut_texts(documents, width, **limits).select(*KEYS, "n_kept", sha("kept").alias("sha")), "phrase-cuts")
    slim = documents.select("doc_id", k1.alias("k1"), k2.alias("k2"), words.alias("text")).select(
        "doc_id", *KEYS, count_words(F.col("text")).alias("n_words"), sha("text").alias("whole")
    )
    return slim.join(cut, KEYS, "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.col("n_words") - F.col("n_kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, width: int = WIDTH, **limits: int) -> DataFrame:
    """``documents`` with the covered words cut out of ``text``; a text that loses words keeps the others joined by one space."""
    k1, k2, kept = scratch_name("k1"), scratch_name("k2"), scratch_name("kept")
    cut = written(cut_texts(documents.select("text"), width, **limits).select("k1", "k2", "kept"), "phrase-kept").toDF(k1, k2, kept)
    _, first, second = _keyed("text")
    out = documents.withColumns({k1: first, k2: second}).join(cut, [k1, k2], "left").withColumn("text", F.coalesce(kept, "text"))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])



ORACLE = rf"""
WITH tok AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w
  FROM documents
), starts AS (
  SELECT r, w, unnest(generate_series(1, len(w) - {WIDTH - 1})) AS i FROM tok WHERE len(w) >= {WIDTH}
), win AS (
  SELECT r, i, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS s FROM starts
), again AS (
  SELECT s FROM win GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + {WIDTH - 1})) AS p FROM win SEMI JOIN again USING (s)
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM tok
), kept AS (
  SELECT x.r, string_agg(x.word, ' ' ORDER BY x.p) AS text, count(*) AS n FROM words x ANTI JOIN gone g ON x.r = g.r AND x.p = g.p GROUP BY x.r
)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM tok t LEFT JOIN kept k ON t.r = k.r
"""
