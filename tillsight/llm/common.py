"""Helpers shared by the operators: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the plan runs once and lineage is cut."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, keys: list[str], name: str, dealt: bool = False) -> DataFrame:
    """Like ``written``, in buckets by ``keys``, so that later joins by them leave its rows where they are.

    With ``dealt``, its rows are repartitioned by ``keys`` already.  Buckets need a table of the catalog to be
    written; it is dropped at once, and the files are read without it.
    """
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}"
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def scratch_name(prefix: str) -> str:
    """A column name that clashes with no column of the input."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 3 is 1: rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``doc_id``-free training rows (text, label): at most ``max_rows`` labelled rows that are not held out.

    The rows are those with the smallest hash of their id, so the sample does
    not depend on file layout.  ``max_rows`` bounds the broadcast side and
    what the driver or one fitting job gets to see; a label that contradicts
    another label of the same id is left out.
    """
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(wanted), "doc_id")
        .select("text", "label")
    )


def split_text(text: pa.Array | pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of all texts of a string array in a row, and the n + 1 offsets (nulls are empty)."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    start, end = int(offsets[0]), int(offsets[-1])
    return (data.slice(start, end - start).to_pybytes() if data is not None and end > start else b""), offsets - start


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` holds about ``max_bytes``, or one row if that is longer."""
    for batch in batches:
        n = len(batch)
        if n == 0:
            continue
        lengths = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        sizes = np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + n + 1])
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start] - sizes[start]
            end = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def hashed_runs(data: bytes, inside: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of the maximal runs of bytes that ``inside`` marks in texts laid end to end.

    ``offsets`` are the texts' n + 1 bounds; a run ends with its text.  The hash includes the run's length;
    with ``lower``, A-Z count as a-z.
    """
    raw = np.frombuffer(data, np.uint8)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(True, inside)[:-1]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside, False)[1:])) + 1
    hashes = np.zeros(len(starts), np.uint64)
    longest = int((ends - starts).max()) if len(starts) else 0
    powers = np.append(np.uint64(1), np.multiply.accumulate(np.full(longest, 0x9E3779B97F4A7C15, np.uint64)))
    first = 0
    while first < len(starts):  # about 2^20 bytes at a time, or one run
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 20), side="right")))
        base = starts[first]
        own = raw[base : ends[last - 1]]
        if lower:
            own = np.where((own >= 65) & (own <= 90), own + 32, own)
        begin, length = starts[first:last] - base, ends[first:last] - starts[first:last]
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        value = (own.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, longest)]
        value[~inside[base : base + len(own)]] = 0
        hashes[first:last] = np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = last
    return starts, ends, mixed(hashes)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
