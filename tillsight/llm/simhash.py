"""SimHash near-dedup with pivot distance tables (operator 2).

Every text gets a 64-bit fingerprint: ASCII letters lower-cased, words split
at ASCII white space, 3-word shingles with repeats, XXH64 with seed 42 of
each; a bit is set where more than half of the hashes have it.  Fingerprints
that differ in at most ``max_bits`` bits are linked, and links are closed to
components.

Links are searched over distinct fingerprints.  A table holds each
fingerprint's Hamming distances to reference fingerprints (pivots) of two
kinds.  Band pivots differ from the base pivot inside one of eight bands, so
their distances, less the base's, depend on that band alone; two fingerprints
that differ in two bits leave six bands untouched, and there all coordinates
differ by zero.  Each fingerprint is therefore dealt out under the coordinates
of every choice of six bands, and only fingerprints that meet in one are
compared: at most 2^16 can, however many documents there are.  Of such pairs,
those are discarded whose distances to any of the full-width pivots differ by
more than ``max_bits`` (triangle inequality); the rest are verified bit by bit.

Defined cases: null, empty and blank texts have fingerprint zero, linked like
any other; repeated rows stay rows; documents without an id take part and get
the smallest id of their component (null if it has none).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import byte_slices, scratch_name, written
from tillsight.llm.components import components

SHINGLE = 3
MAX_BITS = 2
BANDS = 8
FULL_PIVOTS = 16
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 14):
        spans = zip(starts[at : min(n, at + (1 << 14))].tolist(), ends[at + size - 1 : at + size - 1 + (1 << 14)].tolist())
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _prints(batch: pa.RecordBatch) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text"):
        yield pa.record_batch([batch.column("doc_id"), _prints(batch)], names=["doc_id", "fp"])


def _marked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text"):
        yield pa.record_batch([batch.column("doc_id"), _prints(batch), batch.column("mark")], names=["doc_id", "fp", "mark"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _fingerprint_batches, "doc_id long, fp long"
    )


def pivots(bands: int = BANDS, full: int = FULL_PIVOTS) -> tuple[int, list[list[int]], list[int]]:
    """Base pivot, the pivots of each band, and the full-width pivots; the same on every call."""
    rng = random.Random(42)
    base = rng.getrandbits(64)
    width = 64 // bands
    by_band = [[base ^ (1 << bit) for bit in range(b * width, 64 if b == bands - 1 else (b + 1) * width)] for b in range(bands)]
    return base, by_band, [rng.getrandbits(64) for _ in range(full)]


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)).cast("long")))


def distance_table(prints: DataFrame, bands: int = BANDS, full: int = FULL_PIVOTS) -> DataFrame:
    """``prints`` (fp) with its coordinates: ``bands``, the band pivots' distances less the base's, and ``full``, packed by bytes."""
    base, by_band, whole = pivots(bands, full)
    to_base = _distance(F.col("fp"), base)
    coordinates = F.array(
        *[F.concat(*[F.char(_distance(F.col("fp"), p) - to_base + 66) for p in band]) for band in by_band]
    )
    packed = [
        sum((F.shiftleft(_distance(F.col("fp"), p).cast("long"), 7 * i) for i, p in enumerate(whole[k : k + 9])), F.lit(0).cast("long"))
        for k in range(0, len(whole), 9)
    ]
    return prints.select("fp", coordinates.alias("bands"), F.array(*packed).alias("full"))


def _largest_difference(full: int = FULL_PIVOTS) -> str:
    """SQL: the largest difference between the full-width coordinates of sides a and b."""
    at = lambda side, i: f"((shiftright({side}.full[{i // 9}], {7 * (i % 9)})) & 127)"
    return "greatest(" + ", ".join(f"abs({at('a', i)} - {at('b', i)})" for i in range(full)) + ")"


def near_pairs(prints: DataFrame, max_bits: int = MAX_BITS, bands: int = BANDS) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints of ``prints`` (fp, distinct) at most ``max_bits`` bits apart."""
    if max_bits >= bands:
        raise ValueError("max_bits must be below the number of bands")
    table = distance_table(prints, bands)
    choices = [
        F.xxhash64(F.lit(k), *[F.col("bands")[i] for i in kept])
        for k, kept in enumerate(combinations(range(bands), bands - max_bits))
    ]
    dealt = table.select("fp", "full", F.explode(F.array(*choices)).alias("key"))
    # the planner sizes a table without its explode, and would send all of a small one's 28 rows a fingerprint by way of the driver
    met = (
        dealt.alias("a")
        .join(dealt.alias("b").hint("merge"), F.expr("a.key = b.key and a.fp < b.fp"))
        .where(F.expr(f"{_largest_difference()} <= {max_bits}"))
        .where(F.expr(f"bit_count(a.fp ^ b.fp) <= {max_bits}"))
    )
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def _grouped(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first_id, root) of each distinct fingerprint of ``prints`` (doc_id, fp): its smallest id and its component."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_pairs(distinct.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(documents: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = written(fingerprints(documents), "fingerprints")
    grouped = _grouped(prints, max_bits)
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(found, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(documents: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``documents`` that stay: of each component one row, that with the smallest id.

    Rows are told apart by id and text, so rows of one id may go or stay each
    by itself; of equal id in a component, the smallest (fingerprint, XXH64 of
    the text) stays.  A row without an id stays only where its component has
    none with one.
    """
    key, mark = scratch_name("key"), scratch_name("mark")
    rows = documents.withColumn(key, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64("text"))
    prints = written(
        rows.select(F.col(key).alias("doc_id"), "text", F.col(mark).alias("mark")).mapInArrow(_marked_batches, "doc_id long, fp long, mark long"),
        "fingerprints",
    )
    root = _grouped(prints, max_bits).select("fp", "root")
    kept = (
        prints.join(root, "fp")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "mark")).alias("row"))
        .select(F.col("row.doc_id").alias("a"), F.col("row.mark").alias("b"))
    )
    stay = rows.join(kept, rows[key].eqNullSafe(kept["a"]) & (rows[mark] == kept["b"]), "left_semi")
    return stay.dropDuplicates([key, mark]).drop(key, mark)
