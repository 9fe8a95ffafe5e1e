"""A node of bounded size grown to its leaves within one task: splits at midpoints of sorted values, without bins."""

from __future__ import annotations

import hashlib

import numpy as np

#: A split has to gain more than this.
LEAST_GAIN = 0.01
#: The root is 1 and the children of k are 2k and 2k + 1, so ids of 64 bits name this many levels; nodes there are leaves.
MOST_DEPTH = 61
#: Cuts that are weighed at once.
AT_ONCE = 1 << 16


def in_order(tree: int, node: int, features: list[int], seed: int) -> list[int]:
    """The features in the order in which a node looks at them: the draw of ``sampling.draw``, ties to the smaller feature."""
    return sorted(features, key=lambda f: (int(hashlib.md5(f"{tree},{node},{f},{seed}".encode()).hexdigest()[:8], 16), f))


def entropy(counts: np.ndarray) -> np.ndarray:
    """Weight times entropy of each row of class weights."""

    def part(n):
        return np.where(n > 1e-12, n * np.log2(np.maximum(n, 1e-12)), 0.0)

    return part(counts.sum(axis=-1)) - part(counts).sum(axis=-1)


def best_cut(values: np.ndarray, own: np.ndarray) -> tuple[float, float, float, float] | None:
    """(entropy after it, split, share of the weight to the left, gain) of the best midpoint between two values, ties to the
    smaller; ``own``: the class weights of each row. Rows without a value count for nothing; None if all values are alike."""
    known = np.flatnonzero(~np.isnan(values))
    order = known[np.argsort(values[known], kind="stable")]
    values = values[order]
    ends = np.flatnonzero(values[1:] != values[:-1])
    if not len(ends):
        return None
    total, left = np.zeros(own.shape[1]), np.zeros((len(ends), own.shape[1]))
    for c in range(own.shape[1]):
        run = np.cumsum(own[order, c])
        total[c], left[:, c] = run[-1], run[ends]
    whole = total.sum()
    after = np.concatenate([np.round((entropy(part) + entropy(np.maximum(total - part, 0))) / whole, 9) for part in np.split(left, range(AT_ONCE, len(left), AT_ONCE))])
    i = int(np.argmin(after))
    low, high = float(values[ends[i]]), float(values[ends[i] + 1])
    middle = low / 2 + high / 2
    split = middle if low <= middle < high else low
    return float(after[i]), split, float(left[i].sum() / whole), float(np.round(entropy(total) / whole - after[i], 9))


def chosen_cut(x: np.ndarray, at: np.ndarray, own: np.ndarray, columns: list[int], k: int):
    """(after, column, split, share, gain) for the rows ``at`` of least ``after`` among the first ``k`` columns that can be cut at all, and
    further ones as long as none gains over LEAST_GAIN; None if that gain is not reached."""
    best, good, place = None, False, 0
    for f in columns:
        cut = best_cut(x[at, f], own)
        if cut is None:
            continue
        place += 1
        after, split, share, gain = cut
        if best is None or (after, f) < best[:2]:
            best = (after, f, split, share, gain)
        good |= gain > LEAST_GAIN
        if place >= k and good:
            break
    return best if best and best[4] > LEAST_GAIN else None


def grown(x: np.ndarray, class_id: np.ndarray, weight: np.ndarray, tree: int, node: int, classes: int, features: list[int], k: int, depth: int, seed: int) -> list[tuple]:
    """(node_id, feature, split, share_left, n, probs) of ``node`` and all below it; column i of ``x`` is feature ``features[i]``. A node is a leaf if it is pure, no split
    gains enough, or it lies at ``depth``. Rows without the value of a split go to both sides with its shares."""
    column = {f: i for i, f in enumerate(features)}
    found, stack = [], [(node, np.arange(len(x)), weight)]
    while stack:
        node, at, w = stack.pop()
        own = np.zeros((len(at), classes))
        own[np.arange(len(at)), class_id[at]] = w
        mass = own.sum(axis=0)
        probs = mass / mass.sum()
        cut = None
        if node.bit_length() - 1 < depth and (mass > 0).sum() > 1:
            cut = chosen_cut(x, at, own, [column[f] for f in in_order(tree, node, features, seed)], k)
        if cut is None:
            found.append((node, None, None, None, len(at), probs))
            continue
        _, f, split, share, _ = cut
        found.append((node, features[f], split, share, len(at), probs))
        v = x[at, f]
        gone = np.isnan(v)
        for side, there, part in ((0, v <= split, share), (1, v > split, 1 - share)):
            take = there | gone
            stack.append((2 * node + side, at[take], w[take] * np.where(gone[take], part, 1.0)))
    return found
