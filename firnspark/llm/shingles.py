"""Sets of word shingles of many texts at once, as sorted hashes."""

from __future__ import annotations

import numpy as np

from firnspark.llm.chunks import MOST_DOCS
from firnspark.llm.rolling import Rolling, U, mix

#: Bits of a shingle's hash; the rest of a word holds the document's place in its chunk.
HASH_BITS = 64 - (MOST_DOCS - 1).bit_length()
HASH = (U(1) << U(HASH_BITS)) - U(1)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word: a run of bytes other than the six ASCII blanks, A-Z lower-cased."""
    if not len(data):
        return np.empty(0, U), np.empty(0, np.int64)
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Rolling(_LOWER[data], 0).spans(lo, hi), np.searchsorted(ends, lo, side="right")


def _shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, first: int) -> np.ndarray:
    """Distinct shingles of some documents, the first of which is number `first` of its chunk."""
    word, doc = words(data, starts, ends)
    n = np.bincount(doc, minlength=len(starts)) if len(doc) else np.zeros(len(starts), np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    place = (np.arange(first, first + len(starts), dtype=U)) << U(HASH_BITS)
    keys = np.empty(0, U)
    if len(word) >= size:
        h = np.full(len(word) - size + 1, size, U)
        for j in range(size):
            h = mix(h * U(0x9E3779B97F4A7C15) + word[j : len(word) - size + 1 + j])
        at = np.flatnonzero(doc[: len(h)] == doc[size - 1 :])
        keys = place[doc[at]] | (h[at] & HASH)
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        h = n[few].astype(U)
        for j in range(size - 1):
            on = n[few] > j
            h[on] = mix(h[on] * U(0x9E3779B97F4A7C15) + word[begin[few[on]] + j])
        keys = np.concatenate([keys, place[few] | (h & HASH)])
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all documents, by document and then by hash, and where each document's begin.

    A shingle is `size` words in a row; a document with fewer words, but at least one, has the
    whole sequence as its only one. Documents are taken `block` bytes at a time to bound memory.
    """
    found, lo = [np.empty(0, U)], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, side="right")))
        found.append(_shingles(data[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo], size, lo))
        lo = hi
    keys = np.concatenate(found)
    edges = np.searchsorted(keys, np.arange(len(starts), dtype=U) << U(HASH_BITS)) if len(starts) else np.empty(0, np.int64)
    return keys, np.append(edges, len(keys))


def set_hashes(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each document's set, equal for equal sets."""
    out = []
    for seed in (1, 2):
        sums = np.concatenate([[U(0)], np.cumsum(mix((keys & HASH) + (U(seed) << U(HASH_BITS))), dtype=U)])
        out.append(sums[edges[1:]] - sums[edges[:-1]])
    return out[0], out[1]


def width(n: int, per: float) -> int:
    """Bits of the signature of a set of n shingles: a power of two, `per` to twice as many for each."""
    return max(128, 1 << max(0, int(per * n) - 1).bit_length())


def signature(hashes: np.ndarray, per: float) -> bytes:
    """Each bit is the parity of the shingles hashed to it."""
    bits = width(len(hashes), per)
    odd = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_differences(signatures: list[bytes]) -> np.ndarray:
    """For every two sets, at least how many shingles are in just one of them.

    Every bit in which two signatures differ takes one such shingle. The wider of two is folded
    to the other's width, which is the signature it would have had there.
    """
    out = np.zeros((len(signatures), len(signatures)), np.int32)
    sizes = np.array([len(s) // 8 for s in signatures])
    for w in sorted(set(sizes.tolist())):
        own = np.flatnonzero(sizes == w)
        wider = np.flatnonzero(sizes >= w)
        folded = np.empty((len(wider), w), U)
        for row, k in enumerate(wider.tolist()):
            folded[row] = np.bitwise_xor.reduce(np.frombuffer(signatures[k], U).reshape(-1, w), axis=0)
        for k in own.tolist():
            out[k, wider] = out[wider, k] = np.bitwise_count(folded ^ folded[np.searchsorted(wider, k)]).sum(axis=1)
    return out


def common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements the sorted array `one` shares with each of the others."""
    found = np.searchsorted(one, each := np.concatenate(others))
    hit = one[np.minimum(found, len(one) - 1)] == each
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]))


def joined(sets: list[np.ndarray], may: np.ndarray, label: np.ndarray, linked, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Links that join all sets that links join: a spanning forest, by exact intersection of sorted arrays.

    Only pairs that `may` be linked are intersected, and only while nothing joins them yet; equal labels are
    joined from the start. linked(n, m, common) judges; arrays are taken `most` elements at a time.
    """
    root = np.unique(label, return_inverse=True)[1]
    size, out = np.array([len(x) for x in sets]), []
    for i in range(len(sets)):
        others = np.flatnonzero(may[i])
        others = others[(others > i) & (root[others] != root[i])]
        while len(others):
            n = max(1, int(np.searchsorted(np.cumsum(size[others]), most, side="right")))
            part, others = others[:n], others[n:]
            for j in part[linked(size[i], size[part], common(sets[i], [sets[k] for k in part]))].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((i, j))
            others = others[root[others] != root[i]]
    return out


def forest(cost: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a least spanning forest (Prim's): cost below 0 marks no edge, 0 one that is there already."""
    n = len(cost)
    far = np.where(cost < 0, np.iinfo(np.int32).max, cost).astype(np.int64)
    open_, best, frm, out = np.ones(n, bool), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), []
    for _ in range(n):
        at = int(np.argmin(np.where(open_, best, np.iinfo(np.int64).max)))
        if not open_[at] or best[at] >= np.iinfo(np.int32).max:
            at = int(np.argmax(open_))  # nothing reaches the rest: a new tree
        elif best[at] > 0:
            out.append((int(frm[at]), at))
        open_[at] = False
        nearer = open_ & (far[at] < best)
        best[nearer], frm[nearer] = far[at][nearer], at
    return out
