"""Deep-shallow sorting of byte strings, vectorised over many small groups.

Strings are rows of a byte matrix, padded with zeros. The shallow phase is a
multikey quicksort by 8-byte words whose rounds run for all groups at once; what
still shares its first ``shallow`` words goes to the deep phase, where a blind trie
(which holds branching depths only and compares each string with one other)
orders each group.
"""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 4


def sorted_rows(matrix: np.ndarray, group: np.ndarray, first_word: int = 0, shallow: int = SHALLOW_WORDS) -> np.ndarray:
    """Row numbers in the order of (group, bytes from ``first_word`` on); the width must be a multiple of 8.

    The quicksort holds segments of rows that share their words up to a depth.
    In each round every segment splits by a pivot of its own into the rows with
    a smaller word, with the same word, which go one word deeper, and with a
    larger one.
    """
    words = np.ascontiguousarray(matrix).view(">u8")
    last = min(first_word + shallow, words.shape[1])
    order = np.argsort(group, kind="stable")
    segment = np.unique(group[order], return_inverse=True)[1].astype(np.int64)
    depth = np.full(len(order), first_word)
    active, used = _in_shared(segment), len(order)
    deep = []
    while len(active):
        done = depth[active] >= last
        if done.any():
            deep.append(active[done])
        active = active[~done]
        if not len(active):
            break
        rows, seg = order[active], segment[active]
        word = words[rows, depth[active]].astype(np.uint64)
        cut = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        size = np.diff(np.append(cut, len(seg)))
        low, middle, high = word[cut], word[cut + size // 2], word[cut + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high)), size)
        side = (word > pivot).astype(np.int64) - (word < pivot) + 1 + 3 * np.repeat(np.arange(len(cut)), size)
        by = np.argsort(side, kind="stable")
        side = side[by]
        order[active] = rows[by]
        depth[active] = depth[active][by] + (side % 3 == 1)
        segment[active] = used + np.cumsum(np.append(True, side[1:] != side[:-1]))
        used += len(active) + 1
        active = active[_in_shared(segment[active])]
    for places in deep:
        seg = segment[places]
        cuts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        for a, z in zip(cuts, np.append(cuts[1:], len(places)), strict=True):
            part = places[a:z]
            rows = order[part]
            order[part] = rows[blind_trie_order([matrix[i].tobytes() for i in rows])]
    return order


def _in_shared(segment: np.ndarray) -> np.ndarray:
    """Positions whose neighbour has the same segment."""
    same = segment[1:] == segment[:-1]
    return np.flatnonzero(np.append(same, False) | np.append(False, same))


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The order of strings of equal length. Inner nodes are [depth, {byte: child}], leaves [-1, [string numbers]]."""
    numbers = [int.from_bytes(s) for s in strings]
    bits = 8 * len(strings[0])
    root: list = [-1, [0]]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] >= 0:  # blindly to some leaf
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[1][0]
        if differing := numbers[i] ^ numbers[other]:
            depth = (bits - differing.bit_length()) // 8
            parent, node = None, root
            while 0 <= node[0] < depth:
                parent, node = node, node[1][s[node[0]]]
            if node[0] == depth:
                node[1][s[depth]] = [-1, [i]]
            else:
                branch = [depth, {strings[other][depth]: node, s[depth]: [-1, [i]]}]
                if parent is None:
                    root = branch
                else:
                    parent[1][s[parent[0]]] = branch
        else:
            node[1].append(i)
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out.extend(node[1])
        else:
            stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
    return out


def common_prefixes(matrix: np.ndarray, length: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each place in ``order`` the prefix that its string shares with the one before; -1 at the start of a group."""
    out = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 8192):
        at = np.arange(a, min(a + 8192, len(order)))
        x, y = order[at], order[at - 1]
        differ = matrix[x] != matrix[y]
        first = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
        out[at] = np.where(group[x] == group[y], np.minimum(first, np.minimum(length[x], length[y])), -1)
    return out
