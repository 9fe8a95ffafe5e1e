"""The lowest rounds of recompression, inside a task: runs and pairs of words get names that equal word sequences share.

Names are 64-bit hashes of what they stand for, so every task gives the same name to the same run or pair with no
table of names between them; from 8 words on, names are counted over all documents (``substrings.named_rounds``). All arrays cover many documents at once; nothing is merged over a document's edge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: Rounds of pairing, and the length in words from which a symbol is left as it is.
ROUNDS, FREEZE = 9, 8
FAR = np.int64(1) << 40

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + _A) * np.uint64(3) + mix(b ^ _C))


@dataclass
class Words:
    """Words of several documents in a row: their hashes, and each document's first and last place."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray  # one after

    @classmethod
    def of(cls, split: list[list[bytes]]) -> Words:
        h = xxhash.xxh3_64_intdigest
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        hashes = np.fromiter((h(w) for own in split for w in own), np.uint64, int(sizes.sum()))
        last = np.cumsum(sizes)
        return cls(hashes, last - sizes, last)

    def edges(self) -> np.ndarray:
        """True where a document begins."""
        out = np.zeros(len(self.hashes) + 1, bool)
        out[self.first] = True
        out[-1] = True
        return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive entries (also over document edges: the caller leaves those out)."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    base = np.uint64(0xD1342543DE82EF95)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(base), -1, 1 << 64))))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers[:n], dtype=np.uint64)))
    return mix((sums[size:] - sums[:-size]) * back[: n - size + 1])


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frozen symbols: name, and the range [left, right) of words that fixes the symbol wherever that range occurs.

    The range grows as a symbol's fate hangs on a neighbour: a run ends where its neighbours differ; a symbol stays
    unpaired because of the one beside it; a pair hangs on nothing but its two parts. What hangs on a document's edge
    gets a range that reaches FAR, so it never lies within a window.
    """
    n = len(words.hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = words.edges()

    # Runs of one word. start[i]: a run begins at word i.
    start = edge[:-1].copy()
    start[1:] |= words.hashes[1:] != words.hashes[:-1]
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    size = end - at
    name = np.where(size > 1, pair_name(words.hashes[at], size.astype(np.uint64)), words.hashes[at])
    left = np.where(edge[at], -FAR, at - 1)
    right = np.where(edge[end], FAR, end + 1)
    head = edge[at]  # the symbol begins a document

    for r in range(ROUNDS):
        loose = size < FREEZE
        bit = (name >> np.uint64(r + 7)) & np.uint64(1) == 0
        opens, closes = loose & bit, loose & ~bit
        tail = np.append(head[1:], True)  # the symbol ends a document
        pair = np.zeros(len(name), bool)
        pair[:-1] = opens[:-1] & closes[1:] & ~tail[:-1]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # An opening symbol that stays hangs on the next one; a closing one on the one before.
        stays_open, stays_close = opens & ~pair, closes & ~second
        next_right = np.append(right[1:], FAR)
        prev_left = np.append(-FAR, left[:-1])
        right = np.where(stays_open, np.where(tail, FAR, np.maximum(right, next_right)), right)
        left = np.where(stays_close, np.where(head, -FAR, np.minimum(left, prev_left)), left)
        k = np.flatnonzero(pair)
        name[k] = pair_name(name[k], name[k + 1])
        size[k] += size[k + 1]
        left[k] = np.minimum(left[k], left[k + 1])
        right[k] = np.maximum(right[k], right[k + 1])
        keep = ~second
        name, size, left, right, head = name[keep], size[keep], left[keep], right[keep], head[keep]

    done = (size >= FREEZE) & (left > -FAR) & (right < FAR)
    return name[done], left[done], right[done]


def contained(left: np.ndarray, right: np.ndarray, window: int, n: int) -> np.ndarray:
    """For each of the window starts 0..n-window: does the window contain one of the ranges?"""
    count = np.zeros(max(n - window + 1, 0) + 1, np.int64)
    if len(count) > 1 and len(left):
        a, b = np.maximum(right - window, 0), np.minimum(left, n - window)
        fits = a <= b
        np.add.at(count, a[fits], 1)
        np.add.at(count, b[fits] + 1, -1)
    return np.cumsum(count)[:-1] > 0


def whole_windows(words: Words, window: int) -> np.ndarray:
    """For each of the window starts 0..n-window: does the window lie within one document?"""
    n = len(words.hashes)
    ok = np.zeros(max(n - window + 1, 0) + 1, np.int64)
    long = words.last - words.first >= window
    np.add.at(ok, words.first[long], 1)
    np.add.at(ok, words.last[long] - window + 1, -1)
    return np.cumsum(ok)[:-1] > 0


def index(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with their ranges, so that every window of a document contains a range.

    Beside the frozen symbols whose range fits in a window, each window that contains none of those is a symbol itself.
    """
    name, left, right = symbols(words)
    fits = right - left <= window
    name, left, right = name[fits], left[fits], right[fits]
    bare = np.flatnonzero(whole_windows(words, window) & ~contained(left, right, window, len(words.hashes)))
    own = window_hashes(words.hashes, window)[bare] if len(bare) else np.zeros(0, np.uint64)
    return np.concatenate([name, own]), np.concatenate([left, bare]), np.concatenate([right, bare + window])
