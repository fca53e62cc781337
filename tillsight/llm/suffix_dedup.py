"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere (operator 7).

Suffixes are not sorted where every byte starts one.  Each window of ``WIDTH``
bytes names one of the ``GRAM``-byte strings in it, the one whose hash is least
(the first of equals): its anchor.  Equal windows have equal anchors at equal
offsets, so a window can recur only if its anchor's string recurs.  Steps:

1. Equal texts are counted by a 128-bit hash; one of each goes on (a text that
   occurs twice is covered whole).
2. Anchors of every text, each with the range of offsets its windows have.
   Anchors whose string occurs once are done with.
3. The others' surroundings (at most 2 ``WIDTH`` bytes) meet by anchor.  There,
   the suffixes that start at the anchors are sorted deep-shallow, and so are
   the reversed prefixes that end at them.  From the two orders and their
   common prefixes follow, for every offset, the classes of equal windows.
4. The union of an anchor's recurring windows is one span; a text's spans are
   cut out of it.

An anchor of more than ``HOT`` occurrences does not meet in one task: its
windows are dealt out and counted by themselves, with the same result.

Defined cases: null text is empty; matches never cross texts; texts under
``WIDTH`` bytes lose nothing; repeated rows count as other documents, null ids
included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import byte_slices, scratch_name, split_text, written, written_in_buckets
from tillsight.llm.deepshallow import sort_groups

WIDTH = 200
GRAM = 40
HOT = 150_000
#: Starts of a very long text that are looked at together; positions fit into 20 bits.
CHUNK = 1 << 19
BLOCK_ROWS = 30_000
KEYS = ["k1", "k2"]


def _powers() -> tuple[np.ndarray, np.ndarray]:
    factor = 0x9E3779B97F4A7C15
    inverse = pow(factor, -1, 1 << 64)
    n = CHUNK + 2 * WIDTH + (1 << 20)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(np.full(n - 1, factor, np.uint64), out=up[1:])
    np.multiply.accumulate(np.full(n - 1, inverse, np.uint64), out=down[1:])
    return up, down


def find_anchors(data: np.ndarray, offsets: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(position, hash, least and largest offset of its windows) of the anchors of texts laid end to end."""
    up, down = powers
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(data * down[:n], out=total[1:])  # modulo 2^64
    h = (total[GRAM:] - total[: n + 1 - GRAM]) * up[: n + 1 - GRAM]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 20) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = WIDTH - GRAM + 1  # grams in a window
    blocks = -(-len(key) // span)
    padded = np.full(blocks * span, ~np.uint64(0))
    padded[: len(key)] = key
    square = padded.reshape(blocks, span)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WIDTH + 1
    owner = (np.minimum(after[:windows], before[span - 1 : span - 1 + windows]) & low).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:windows]
    window = np.flatnonzero(np.arange(WIDTH, windows + WIDTH) <= ends)
    if not len(window):
        return none, none, none, none
    owner = owner[window]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    return at, h[at].view(np.int64), at - window[last], at - window[first]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _powers()
    for batch in byte_slices(batches, "text"):
        data, offsets = split_text(batch.column("text"))
        raw = np.frombuffer(data, np.uint8).astype(np.uint64)
        if len(raw) <= CHUNK + (1 << 19):
            parts = [(0, *find_anchors(raw, offsets, powers))]
        else:  # one long text
            parts = [
                (c, *find_anchors(raw[c : c + CHUNK + WIDTH - 1], np.array([0, len(raw[c : c + CHUNK + WIDTH - 1])]), powers))
                for c in range(0, max(1, len(raw) - WIDTH + 1), CHUNK)
            ]
        for base, at, hashes, least, largest in parts:
            row = np.searchsorted(offsets, at + base, side="right") - 1
            yield pa.record_batch(
                [batch.column(k).take(pa.array(row)) for k in KEYS]
                + [pa.array(hashes), pa.array((at + base - offsets[row]).astype(np.int32)), pa.array(least.astype(np.int16)), pa.array(largest.astype(np.int16))],
                names=[*KEYS, "gram", "pos", "least", "largest"],
            )


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key this task has not met; two longs are kept for each distinct text of the task's partition."""
    met: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
        new = []
        for i, key in enumerate(keys):
            if key not in met:
                met.add(key)
                new.append(i)
        if new:
            yield batch.take(pa.array(new))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row (k1, k2, text) per distinct text, written once in buckets by key, so later joins by key move no text.

    Copies are dropped in the tasks that read them before texts are dealt out.
    """
    spark = rows.sparkSession
    schema = "k1 long, k2 long, text string"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(*KEYS, "text").mapInArrow(_first_of_each, schema).repartition(buckets, *KEYS).mapInArrow(_first_of_each, schema)
    return written_in_buckets(found, KEYS, "llm_texts", dealt=True)


def _context_batches(with_bytes: bool):
    """Occurrences of recurring anchors: with their surroundings, once for each kind of them in a task, or with their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple, int] = {}
        for batch in byte_slices(batches, "text"):
            out: list[tuple] = []
            texts = batch.column("text").cast(pa.binary())
            for i in range(len(batch)):
                text = texts[i].as_py()
                for a in batch.column("anchors")[i].as_py():
                    pos, least, largest = a["pos"], a["least"], a["largest"]
                    around = text[pos - largest : pos + WIDTH - least]
                    kind = xxhash.xxh64_intdigest(around, least << 8 | largest) - (1 << 63)
                    if with_bytes:
                        out.append((a["gram"], kind, least, largest, around, a["n"]))
                    else:
                        out.append((a["gram"], kind, batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py(), pos))
            if not out:
                continue
            if with_bytes:
                counts: dict[tuple, list] = {}
                for row in out:
                    counts.setdefault(row[:2], [*row, 0])[-1] += 1
                out = [tuple(row) for row in counts.values()]
                names = ["gram", "kind", "least", "largest", "around", "n", "copies"]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            else:
                names = ["gram", "kind", *KEYS, "pos"]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        met.clear()

    return run


def recurring_offsets(gram: np.ndarray, least: np.ndarray, largest: np.ndarray, around: list[bytes], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of surroundings the least and largest offset of a window that recurs in its group; (1, 0) if none does."""
    n = len(gram)
    right, left = np.zeros((n, WIDTH), np.uint8), np.zeros((n, WIDTH - GRAM), np.uint8)
    for i, (data, cut) in enumerate(zip(around, largest.tolist())):
        raw = np.frombuffer(data, np.uint8)
        right[i, : len(raw) - cut] = raw[cut:]
        left[i, :cut] = raw[:cut][::-1]
    _, group = np.unique(gram, return_inverse=True)

    def classes(rows: np.ndarray):
        order, prefix = sort_groups(group, rows)
        prefix[np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))] = -1
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        return prefix, place

    after, after_place = classes(right)
    before, before_place = classes(left)
    first, last = np.full(n, 1 << 20), np.full(n, -1)
    for offset in range(WIDTH - GRAM + 1):
        own = np.flatnonzero((least <= offset) & (offset <= largest))
        if not len(own):
            continue
        # rows of one class agree in the bytes from the anchor on, and in those before it
        a = np.cumsum(after < WIDTH - offset)[after_place[own]]
        b = np.cumsum(before < offset)[before_place[own]] if offset else group[own]
        _, window = np.unique(a * np.int64(n + 1) + b, return_inverse=True)
        again = np.bincount(window, copies[own])[window] >= 2
        first[own[again]] = np.minimum(first[own[again]], offset)
        last[own[again]] = offset
    none = last < 0
    return np.where(none, 1, first), np.where(none, 0, last)


def _solved_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole groups are gathered to blocks of about ``BLOCK_ROWS``."""

    def solve(block: pa.Table) -> pa.RecordBatch | None:
        merged = block.group_by(["gram", "kind"]).aggregate([("copies", "sum"), ("least", "min"), ("largest", "min"), ("around", "min")])
        column = lambda name: merged.column(name).to_numpy()
        first, last = recurring_offsets(
            column("gram"), column("least_min"), column("largest_min"), merged.column("around_min").to_pylist(), column("copies_sum")
        )
        found = pa.array(np.flatnonzero(first <= last))
        return pa.record_batch(
            [merged.column("gram").combine_chunks().take(found), merged.column("kind").combine_chunks().take(found)]
            + [pa.array(x.astype(np.int32)).take(found) for x in (first, last)],
            names=["gram", "kind", "first", "last"],
        )

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        gram = table.column("gram").to_numpy()
        whole = int(np.searchsorted(gram != gram[-1], False)) if gram[0] == gram[-1] else int(np.flatnonzero(gram != gram[-1])[-1]) + 1
        if whole:
            yield solve(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
        count = sum(map(len, held))
    if count:
        yield solve(pa.Table.from_batches(held))


def _hot_offsets(around: DataFrame) -> DataFrame:
    """The same as ``_solved_batches`` for anchors of any number of occurrences, by counting their windows."""
    rows = around.groupBy("gram", "kind", "least", "largest", "around").agg(F.sum("copies").alias("copies"))
    windows = rows.withColumn("offset", F.explode(F.sequence("least", "largest"))).select(
        "gram", "kind", "copies", "offset", F.md5(F.substring("around", F.col("largest") - F.col("offset") + 1, F.lit(WIDTH))).alias("window")
    )
    again = windows.groupBy("gram", "offset", "window").agg(F.sum("copies").alias("times")).where("times >= 2").drop("times")
    # merged, as the planner sizes a table without its explode and might send it by way of the driver
    found = windows.join(again.hint("merge"), ["gram", "offset", "window"], "left_semi")
    return found.groupBy("gram", "kind").agg(F.min("offset").cast("int").alias("first"), F.max("offset").cast("int").alias("last"))


def spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans) of the distinct texts that have bytes covered by a recurring window; spans may overlap."""
    anchors = written(
        texts.mapInArrow(_anchor_batches, "k1 long, k2 long, gram long, pos int, least smallint, largest smallint"), "anchors"
    )
    # written, so that the join below meets plain shuffles, whose hot partitions Spark splits
    again = written(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "recurring")
    place = F.struct("gram", "pos", F.col("least").cast("int").alias("least"), F.col("largest").cast("int").alias("largest"), "n")
    of_text = anchors.join(again, "gram").groupBy(*KEYS).agg(F.collect_list(place).alias("anchors"))  # a text's own anchors
    met = texts.join(of_text, KEYS)
    around = met.mapInArrow(
        _context_batches(True), "gram long, kind long, least int, largest int, around binary, n long, copies long"
    )
    cool = around.where(F.col("n") <= hot).repartition("gram").sortWithinPartitions("gram")
    solved = cool.select("gram", "kind", "least", "largest", "around", "copies").mapInArrow(
        _solved_batches, "gram long, kind long, first int, last int"
    )
    solved = written(solved, "offsets")
    if not again.where(F.col("n") > hot).isEmpty():
        solved = solved.union(written(_hot_offsets(written(around.where(F.col("n") > hot), "hot")), "offsets-hot"))
    placed = met.mapInArrow(_context_batches(False), "gram long, kind long, k1 long, k2 long, pos int").join(solved, ["gram", "kind"])
    span = F.struct((F.col("pos") - F.col("last")).alias("start"), (F.col("pos") - F.col("first") + WIDTH).alias("end"))
    return placed.groupBy(*KEYS).agg(F.collect_list(span).alias("spans"))


def _cut(text: bytes, parts: list) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs removed."""
    kept, runs, at = [], 0, 0
    for part in sorted((p["start"], p["end"]) for p in parts):
        if part[0] > at or not runs:
            kept.append(text[at : part[0]])
            runs += 1
        at = max(at, part[1])
    return b"".join(kept) + text[at:], runs


def cut_text(text: Column, parts: Column) -> Column:
    """Struct (kept binary, n_spans) of a text column and its spans."""

    def run(text: pd.Series, parts: pd.Series) -> pd.DataFrame:
        done = [_cut(t.encode(), list(p)) for t, p in zip(text, parts)]
        return pd.DataFrame({"kept": [d[0] for d in done], "n_spans": [d[1] for d in done]})

    return F.pandas_udf(run, "kept binary, n_spans long")(text, parts)


def keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with null text empty and two hashes of the text that name it."""
    rows = documents.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def removals(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = keyed(documents.select("doc_id", "text"))
    texts = distinct_texts(rows)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    slim = rows.select("doc_id", *KEYS, F.octet_length("text").cast("long").alias("n_bytes"), sha(F.col("text")).alias("whole"))
    cut = texts.join(spans(texts, hot), KEYS).select(*KEYS, cut_text(F.col("text"), F.col("spans")).alias("cut"))
    cut = written(
        cut.select(*KEYS, F.octet_length("cut.kept").alias("left"), "cut.n_spans", F.sha2("cut.kept", 256).alias("sha")), "cuts"
    )
    copies = slim.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"))
    found = slim.join(copies, KEYS).join(cut, KEYS, "left")
    twice = (F.col("copies") > 1) & (F.col("n_bytes") >= WIDTH)
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("left"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(twice, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """``documents`` with the covered bytes cut out of ``text`` and ``n_chars`` counted anew.

    A cut may fall inside a character; what is left of that character goes too.
    """
    k1, k2, copies = scratch_name("k1"), scratch_name("k2"), scratch_name("copies")
    short, kept = scratch_name("short"), scratch_name("kept")
    rows = keyed(documents.select("text"))
    texts = distinct_texts(rows)

    def run(text: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else _cut(t.encode(), list(p))[0].decode("utf-8", "ignore") for t, p in zip(text, parts)])

    kept_texts = texts.join(spans(texts, hot), KEYS, "left").select(
        F.col("k1").alias(k1), F.col("k2").alias(k2), F.pandas_udf(run, "string")("text", "spans").alias(kept)
    )
    counts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(copies)).select(F.col("k1").alias(k1), F.col("k2").alias(k2), copies)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.withColumns(
        {k1: F.xxhash64(text), k2: F.xxhash64(F.lit(1), text), short: F.when(F.octet_length(text) < WIDTH, text)}
    ).drop("text")
    # texts of several copies are cut whole, and short ones carried along, so every key that meets its text does so once
    joined = slim.join(counts, [k1, k2])
    lone = joined.where(F.col(short).isNull() & (F.col(copies) == 1)).join(kept_texts, [k1, k2])
    rest = joined.where(F.col(short).isNotNull() | (F.col(copies) > 1)).withColumn(kept, F.coalesce(short, F.lit("")))
    out = lone.unionByName(rest).withColumn("text", F.col(kept))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])
