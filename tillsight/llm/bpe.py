"""Byte-level BPE encoding and decoding with segment trees (operator 6).

A text is split by the vocabulary's pattern and every match is merged by
itself.  The leaves of a match's segment tree are its byte positions; a leaf
holds the rank of the pair that starts there, and each inner node the least
(rank, position) below it, so the root names the leftmost pair of minimum
rank.  A merge changes three leaves (the position that starts the new token,
its live neighbour to the left, and the swallowed one), each a point update
along one path to the root.  Short matches of equal tree size run through
their merges side by side as rows of one array; long ones run singly.

Matches recur, so a task keeps the ids of those it has met, up to
``CACHE_ENTRIES``; then it starts afresh.

Defined cases: null text counts as empty and has no ids; no special token is
recognised, their spelling is ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import byte_slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_ENTRIES = 400_000
#: Trees with more leaves than this run singly.
SIDE_BY_SIDE = 128
_NONE = np.int64(1) << 62
_SHIFT = 40  # a node is rank << _SHIFT | position


class Bpe:
    """Ranks and the table of pairs; ids are ranks."""

    def __init__(self, vocabulary: str = VOCABULARY):
        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        order = sorted(self.pairs)
        self.pair_keys = np.array(order, np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in order], np.int64)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(public_tokenizers.PATTERN.replace(r"\S", r"[^\p{White_Space}]").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))

    def _leaves(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (left, right); a negative token stands for none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_ranks[at] << _SHIFT | position, _NONE)

    def merge_rows(self, pieces: list[bytes], leaves: int) -> list[np.ndarray]:
        """Ids of pieces of 2 to ``leaves`` bytes; every piece is a row, and each step merges one pair in each row."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        inside = np.arange(leaves) < sizes[:, None]
        # a last column of -1 stands for "no neighbour" on either side
        token = np.full((n, leaves + 1), -1, np.int64)
        token[:, :leaves] = np.where(inside, self.byte_ids[raw], -1)
        after = np.arange(1, leaves + 2)
        after = np.where(after < sizes[:, None], after, leaves)
        before = np.tile(np.append(np.arange(-1, leaves - 1), leaves), (n, 1))
        before[:, 0] = leaves
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        position = np.broadcast_to(np.arange(leaves), (n, leaves))
        tree[:, leaves:] = self._leaves(token[:, :leaves], token[:, 1:], position)
        width = leaves >> 1
        while width:
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
            width >>= 1

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[rows, node] = value
            node = node >> 1
            for _ in range(leaves.bit_length() - 1):
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root & ((1 << _SHIFT) - 1), root >> _SHIFT
            gone = after[rows, at]
            right, left = after[rows, gone], before[rows, at]
            token[rows, at] = rank
            token[rows, gone] = -1
            after[rows, at] = right
            linked = right < leaves
            before[rows[linked], right[linked]] = at[linked]
            update(rows, gone, np.full(len(rows), _NONE))
            update(rows, at, self._leaves(rank, token[rows, right], at))
            has = left < leaves
            update(rows[has], left[has], self._leaves(token[rows[has], left[has]], rank[has], left[has]))
            rows = rows[tree[rows, 1] < _NONE]
        live = token[:, :leaves] >= 0
        ends = np.cumsum(live.sum(axis=1))
        return np.split(token[:, :leaves][live], ends[:-1])

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one long piece, by the same tree in plain lists."""
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        none, pairs = int(_NONE), self.pairs
        token = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = pairs.get(token[i] << 20 | token[i + 1])
            if rank is not None:
                tree[leaves + i] = rank << _SHIFT | i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            at, rank = tree[1] & ((1 << _SHIFT) - 1), tree[1] >> _SHIFT
            gone = after[at]
            right, left = after[gone], before[at]
            token[at], token[gone], after[at] = rank, -1, right
            update(gone, none)
            if right < n:
                before[right] = at
                pair = pairs.get(rank << 20 | token[right])
                update(at, none if pair is None else pair << _SHIFT | at)
            else:
                update(at, none)
            if left >= 0:
                pair = pairs.get(token[left] << 20 | rank)
                update(left, none if pair is None else pair << _SHIFT | left)
        return [t for t in token if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, packed as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for leaves, where in by_size.items():
            if leaves > SIDE_BY_SIDE:
                for i in where:
                    out[i] = np.array(self.merge_one(pieces[i]), "<u4").tobytes()
                continue
            step = max(1, (1 << 20) // leaves)
            for k in range(0, len(where), step):
                part = where[k : k + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], leaves)):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def encode_texts(self, texts: list[str], met: dict[str, bytes]) -> list[bytes]:
        """Packed ids of each text; ``met`` keeps the ids of matches."""
        split = [self.split.findall(t) for t in texts]
        new = list(set().union(*split).difference(met))
        if len(met) + len(new) > CACHE_ENTRIES:
            met.clear()
            new = list(set().union(*split))
        met.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        return [b"".join(map(met.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coded(vocabulary: str, outputs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, met = Bpe(vocabulary), {}
        for batch in byte_slices(batches, "text"):
            ids = bpe.encode_texts([t or "" for t in batch.column("text").to_pylist()], met)
            yield pa.record_batch([batch.column("doc_id"), *outputs(bpe, ids)], names=["doc_id", *outputs.names])

    return run


def _digest_columns(bpe: Bpe, ids: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
    ]


_digest_columns.names = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _id_columns(bpe: Bpe, ids: list[bytes]) -> list[pa.Array]:
    return [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))]


_id_columns.names = ["ids"]


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row."""
    return documents.select("doc_id", "text").mapInArrow(
        _coded(vocabulary, _id_columns), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    )


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, bytes) of a table (doc_id, ids); null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocabulary)
        for batch in batches:
            data = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trips(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of every text's ids and of the bytes decoded from them."""
    return documents.select(F.col("doc_id"), "text").mapInArrow(
        _coded(vocabulary, _digest_columns),
        f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
