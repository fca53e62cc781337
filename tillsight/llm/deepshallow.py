"""Deep-shallow string sorting: multikey by words to a shallow depth, blind tries for what is still equal there."""

from __future__ import annotations

import numpy as np

#: Words of eight bytes that all strings are sorted by before the tries take over.
SHALLOW_WORDS = 6


def _leading_equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers (8 for zero)."""
    return sum(((x >> np.uint64(56 - 8 * k)) == 0).astype(np.int64) for k in range(8))


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of strings of one length, and the common prefix of each with the one before it (0 for the first).

    An inner node is [depth, children by the byte there], a leaf the number of
    a string.  A search looks only at branching bytes and is blind to those
    between; one comparison with the leaf it ends at settles the prefix.
    """
    equal: dict[bytes, list[int]] = {}
    for i, string in enumerate(strings):
        equal.setdefault(string, []).append(i)
    numbers: dict[int, int] = {}
    width, root = 8 * len(strings[0]), None
    for string, (leaf, *_) in equal.items():
        number = numbers[leaf] = int.from_bytes(string, "big")
        if root is None:
            root = leaf
            continue
        node = root
        while type(node) is list:
            child = node[1].get(string[node[0]])
            node = next(iter(node[1].values())) if child is None else child
        near, common = strings[node], (width - (number ^ numbers[node]).bit_length()) // 8
        above, node = None, root
        while type(node) is list and node[0] < common:
            above, node = node, node[1][string[node[0]]]
        if type(node) is list and node[0] == common:
            node[1][string[common]] = leaf
            continue
        split = [common, {near[common]: node, string[common]: leaf}]
        if above is None:
            root = split
        else:
            above[1][string[above[0]]] = split
    order: list[int] = []
    prefix: list[int] = []
    stack = [(root, 0)]
    while stack:
        node, common = stack.pop()
        if type(node) is list:
            children = [child for _, child in sorted(node[1].items())]
            stack.extend((child, node[0]) for child in reversed(children[1:]))
            stack.append((children[0], common))
        else:
            same = equal[strings[node]]
            order += same
            prefix += [common] + [width // 8] * (len(same) - 1)
    return order, prefix


def sort_groups(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the byte strings ``rows`` (one row of a matrix each) within their groups.

    Returns the order and, for each place in it, the common prefix with the
    place before (0 where a group starts).
    """
    n, width = rows.shape
    words = -(-width // 8)
    padded = np.zeros((n, 8 * words), np.uint8)
    padded[:, :width] = rows
    word = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    start = np.ones(n, bool)
    start[1:] = group[order][1:] != group[order][:-1]
    prefix = np.zeros(n, np.int64)
    shallow = min(SHALLOW_WORDS, words)
    for w in range(shallow):
        segment = np.cumsum(start)
        order = order[np.lexsort((word[order, w], segment))]
        value = word[order, w]
        new = np.zeros(n, bool)
        new[1:] = ~start[1:] & (value[1:] != value[:-1])
        at = np.flatnonzero(new)
        prefix[at] = 8 * w + _leading_equal_bytes(value[at] ^ value[at - 1])
        start |= new
    heads = np.flatnonzero(start)
    sizes = np.diff(np.append(heads, n))
    deep = 8 * shallow
    for head, size in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        own = order[head : head + size]
        if deep >= width:
            prefix[head + 1 : head + size] = width
            continue
        within, common = blind_trie_order([row.tobytes() for row in rows[own, deep:]])
        order[head : head + size] = own[within]
        prefix[head + 1 : head + size] = np.array(common[1:]) + deep
    return order, prefix
