"""BagMinHash signatures of weighted sets, vectorised over many documents.

Every element runs a Poisson process over its weight: levels 0 < 1 < 2 < 4 < 8
... bound the nodes of a hierarchy, and a node as wide as r has points at rate
r. A point has a time, a slot of the signature, and a place inside its node,
found by halving; it counts where that place is within the element's weight. A
slot keeps its earliest point, so that two documents agree in a slot with a
probability that is their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

#: Expected points for each slot in the first try; documents with slots left empty try twice as long.
POINTS = 8.0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def weighted(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, owner, weight): the distinct values of each owner with how often they occur; owners ascend."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    start = np.flatnonzero(new)
    return v[start], o[start], np.diff(np.append(start, len(v)))


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_owners: int, slots: int) -> np.ndarray:
    """(owners x slots) hashes of the winning points; 0 in the rows of owners without elements."""
    out = np.zeros((n_owners, slots), np.uint64)
    total = np.bincount(owner, weight, n_owners)
    open_owners, points = np.flatnonzero(total > 0), POINTS
    while len(open_owners):
        chosen = np.zeros(n_owners, bool)
        chosen[open_owners] = True
        mine = chosen[owner]
        until = np.zeros(n_owners)
        until[open_owners] = points * slots / total[open_owners]
        best, win = _race(element[mine], owner[mine], weight[mine], until, n_owners, slots)
        full = np.isfinite(best[open_owners]).all(1)
        out[open_owners[full]] = win[open_owners[full]]
        open_owners, points = open_owners[~full], 2 * points
    return out


def _race(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, until: np.ndarray, n_owners: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    best, win = np.full(n_owners * slots, np.inf), np.zeros(n_owners * slots, np.uint64)
    level = 0
    while len(element):
        low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
        rate, room = float(high - low), np.minimum(weight, high) - low
        state = mixed(element + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        at, mine, time, inside = np.arange(len(element)), owner, np.zeros(len(element)), room / rate
        while len(at):
            state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(uniform(state)) / rate
            go = time <= until[mine]
            at, mine, time, state, inside = at[go], mine[go], time[go], state[go], inside[go]
            if not len(at):
                break
            pick = mixed(state ^ np.uint64(0xD1B54A32D192ED03))
            slot = mine * slots + ((pick >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            ok = slice(None) if rate == 1 else uniform(mixed(pick)) <= inside
            s, t, x = slot[ok], time[ok], state[ok]
            np.minimum.at(best, s, t)
            won = t == best[s]
            win[s[won]] = x[won]
        more = weight > high
        element, owner, weight = element[more], owner[more], weight[more]
        level += 1
    return best.reshape(n_owners, slots), win.reshape(n_owners, slots)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """(owners x bands) hashes of ``rows`` slots each, another hash for each band."""
    n, slots = signature.shape
    parts = signature.reshape(n, slots // rows, rows)
    out = np.broadcast_to(np.arange(1, slots // rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), parts.shape[:2]).copy()
    for k in range(rows):
        out = mixed(out * np.uint64(3) + parts[:, :, k])
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller by the sum of the larger counts of two arrays of values."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = np.minimum(n, m[at])[y[at] == x].sum()
    return float(shared / (len(a) + len(b) - shared))
