"""Sets of word shingles of whole texts, many documents at once, and keys that near sets share."""

from __future__ import annotations

import numpy as np

from tessella.llm.bytehash import hash_ranges, mix

_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the document of each."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ink = ~_WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begin, end = ink & edge[:-1], ink & edge[1:]
    begin[1:] |= ink[1:] & ~ink[:-1]
    end[:-1] |= ink[:-1] & ~ink[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return hash_ranges(buf, starts, ends, _LOWER), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, ascending, and the documents' offsets in them.

    A document with fewer words has its whole sequence as one shingle, one without words
    has none.
    """
    n = len(offsets) - 1
    key, doc = word_hashes(buf, offsets)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    whole = len(key) - words + 1
    if whole > 0:
        runs = np.zeros(whole, np.uint64)
        for k in range(words):
            runs += mix(key[k : k + whole]) * factors[k]
        good = doc[:whole] == doc[words - 1 :]
        found, owner = [mix(runs[good])], [doc[:whole][good]]
    else:
        found, owner = [], []
    for k in range(1, words):
        short = np.flatnonzero(count == k)
        if len(short):
            runs = np.full(len(short), k, np.uint64) * _ODD
            for j in range(k):
                runs += mix(key[first[short] + j]) * factors[j]
            found.append(mix(runs))
            owner.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h, d = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))])


def set_hashes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its members; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _ODD))])
    size = np.diff(offsets).astype(np.uint64)
    out = mix(sums[offsets[1:]] - sums[offsets[:-1]] + size * _ODD)
    return np.where(size > 0, out, np.uint64(0))


class Prefixes:
    """Keys of which two sets share at least one if their Jaccard similarity is high enough.

    With 100 * |A & B| >= percent * |A | B|, the sets share at least percent / 100 of the
    larger one.  Put all shingles in one order, whatever it is; then the first
    n - ceil(percent * n / 100) + 1 members of each set have one in common.  The order here
    puts shingles that a sample of documents has often last, so that a passage which many
    documents share makes keys only where a document holds little else.
    """

    def __init__(self, percent: int, common: np.ndarray, counts: np.ndarray):
        """``common``: shingle hashes seen often, ascending; ``counts``: how often."""
        self.percent, self.common, self.counts = percent, common, counts.astype(np.int64)
        self.most = int(self.counts.max(initial=0))

    def keys(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All keys and, for each, the place of its set."""
        size = np.diff(offsets)
        doc = np.repeat(np.arange(len(size)), size)
        count = np.zeros(len(h), np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            seen = self.common[at] == h
            count[seen] = self.counts[at[seen]]
        order = np.argsort(doc * (self.most + 1) + count, kind="stable")  # hashes ascend within a set
        length = size + (-self.percent * size) // 100 + 1
        place = np.arange(len(h)) - np.repeat(offsets[:-1], size)
        keep = order[place < np.repeat(length, size)]
        return h[keep], doc[keep]
