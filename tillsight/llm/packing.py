"""Packing along a space-filling curve (operator 4).

Every text becomes a vector of signed hashed byte n-gram counts, is projected
by a fixed random matrix to ``DIMENSIONS`` coordinates, and gets the Hilbert key
of their grid cell.  Documents are range-partitioned and sorted by (key, id),
which splits ties by id, then tokenised where they lie and laid end to end:
neighbours on the curve share sequences.  A sequence holds ``LENGTH`` ids;
what is left at the end of a range is cut into sequences whose lengths are
powers of two, so nothing is padded.

Each range is packed by itself while its rows stream past; a task holds one
batch of texts and one open sequence.  Only texts are shuffled, once.

Defined cases: null text is empty, and an empty text is the lone end id;
repeated rows are packed as often as they occur; null ids are packed too; an
empty table gives no piece.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillsight.llm.common import byte_slices, split_text

LENGTH = 1024
END_ID = 0
DIMENSIONS = 3
GRID_BITS = 10
BUCKETS = 256
GRAM = 4
LONG_RUN = 20_000
#: The ranks of the vocabulary of byte_bpe_50k.json, whose ids are the same.
VOCABULARY = "byte_bpe_50k.tiktoken"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates below 2^bits."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level
        low = q - 1
        for i in range(len(axes)):
            high = (axes[i] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
        q >>= 1
    for i in range(1, len(axes)):  # Gray code
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((axes[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> b) & 1)
    return key


def _vectors(text: pa.Array) -> np.ndarray:
    """Unit vectors of signed hashed byte n-gram counts, one row a text; zero where a text is shorter than a gram."""
    data, offsets = split_text(text)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    n, size = len(text), len(raw) - GRAM + 1
    if size <= 0:
        return np.zeros((n, BUCKETS))
    h = np.zeros(size, np.uint32)
    for k in range(GRAM):
        h = (h ^ raw[k : k + size]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))[:size]
    inside = np.arange(GRAM, size + GRAM) <= offsets[1:][row]
    cell = row * BUCKETS + (h >> np.uint32(24))
    sign = np.where((h >> np.uint32(8)) & np.uint32(1), 1.0, -1.0) * inside
    counts = np.bincount(cell, sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    norm = np.sqrt((counts**2).sum(axis=1, keepdims=True))
    return counts / np.maximum(norm, 1e-12)


def curve_keys(text: pa.Array) -> np.ndarray:
    """Hilbert key of each text."""
    matrix = np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))
    top = (1 << GRID_BITS) - 1
    cells = np.clip((_vectors(text) @ matrix + 4) / 8 * top, 0, top).astype(np.int64)
    return hilbert_keys(cells, GRID_BITS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text"):
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("text"), pa.array(curve_keys(batch.column("text")))], names=["doc_id", "text", "key"]
        )


def encoder(vocabulary: str):
    """text -> array of ids by a public vocabulary file: a rank file (tiktoken) or a tokenizer file (tokenizers)."""
    if vocabulary.endswith(".json"):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    name = vocabulary.rsplit(".", 1)[0] + ".json"
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        added = [t["content"] for t in json.load(file).get("added_tokens") or []]
    slow: list = []

    def encode(text: str) -> np.ndarray:
        # added tokens are the tokenizer file's alone; a long run is more than the pattern's recursion bears
        if any(t in text for t in added) or len(text) >= LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text):
            slow[:] = slow or [encoder(name)]
            return slow[0](text)
        return np.array(own.encode_ordinary(text), np.uint32)

    return encode


class _Packer:
    """Lays documents end to end; ``rows`` collects the pieces of closed sequences."""

    def __init__(self, first_sequence: int, length: int):
        self.sequence, self.length = first_sequence, length
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the sequence that is not full yet
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            take = min(self.length - self.filled, total - start)
            self.open.append((doc_id, start, ids[start : start + take], total))
            self.filled += take
            start += take
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """Close what is left as sequences whose lengths are powers of two, the longest first."""
        pieces, left = self.open, self.filled
        while left:
            size = 1 << (left.bit_length() - 1)
            own, room = [], size
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                own.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._close(own)
            left -= size
        self.open, self.filled = [], 0

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        return pa.record_batch(
            [pa.array(c, pa.int64()) for c in columns],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def _pack_range(vocabulary: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], np.uint32)
        packer = _Packer(TaskContext.get().partitionId() << 32, length)
        for batch in byte_slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                packer.add(doc_id, np.concatenate((encode(text), end)))
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return run


def packed(documents: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.mapInArrow(_keyed, "doc_id long, text string, key long")
    ordered = keyed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", F.xxhash64("text"))
    return ordered.select("doc_id", "text").mapInArrow(_pack_range(vocabulary, end_id, length), PIECES)
