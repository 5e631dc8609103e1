"""Whole-text encoding with a public byte-level tokenizer.

A byte-level pre-tokenizer cuts a text into words that are encoded alone, and some
of its cuts show from two neighbouring bytes: before white space that follows a
visible character, after a line feed, and after a letter that no letter follows.
Texts are cut there and around each added token of the vocabulary (such as
``<|endoftext|>``), which has one id wherever a text holds it; the tokenizers library encodes each distinct piece once, and a
sorted table of piece keys gives the ids of all others by array look-ups.  A piece of up
to seven bytes is its own key; a longer one has a hash, and its bytes are compared with
those of the piece in the table, so ids never hang on a hash.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from tessella.llm.bytehash import KEEP, blocks_of, hash_ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes whose pieces are looked up in one go.
SPAN = 2_000_000
#: Pieces that one Python worker keeps at most; beyond it the table starts anew.
TABLE_PIECES = 500_000
#: Bytes of a piece that is kept; longer ones are encoded wherever they occur.
LONGEST = 128


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are visible ASCII, and which are ASCII letters."""
    b = np.arange(256)
    visible = (b > 0x20) & (b < 0x7F)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    return visible, letter


_VISIBLE, _LETTER = _byte_classes()


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: every document's start and each cut that two bytes prove.

    Characters from U+00C0 to U+00FF (first byte 0xC3) count as visible, and as
    letters but for the two signs among them; other non-ASCII bytes prove nothing.
    """
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        latin = np.zeros(n, bool)
        latin[1:] = buf[:-1] == 0xC3
        seen = _VISIBLE[buf] | (buf == 0xC3) | latin
        letter = _LETTER[buf] | (latin & (buf != 0x97) & (buf != 0xB7))
        white = (buf == 0x20) | (buf == 0x0A)
        cut[1:n] |= white[1:] & seen[:-1]
        cut[1 : n - 1] |= white[1:-1] & seen[2:]
        cut[1:n] |= (buf[:-1] == 0x0A) & seen[1:]
        cut[1:n] |= letter[:-1] & _VISIBLE[buf[1:]] & ~_LETTER[buf[1:]]
    # a document's edge proves nothing about what lies beyond it
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    last = edge - 1
    cut[last] &= ~((buf[last] == 0x20) | (buf[last] == 0x0A)) | np.where(last > 0, _VISIBLE[buf[last - 1]], False)
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Encodes text bytes to ids, with a bounded table of pieces seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized and self.tokenizer.normalizer for t in added):
            raise ValueError("added tokens that take in or depend on their surroundings aren't supported")
        # as the library finds them: the first one, of several that start there the longest
        names = sorted((t.content.encode() for t in added if t.content), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        # the bytes of pieces beyond seven, as blocks of eight
        self.block_at = np.zeros(0, np.int64)
        self.blocks = np.zeros(1 << 16, np.uint64)
        self.blocks_used = 0

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum())), count

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces; ``keys`` ascend."""
        flat, count = self._library([p.decode() for p in pieces])
        self.pool, at = _appended(self.pool, self.used, flat), self.used + np.cumsum(count) - count
        self.used += len(flat)
        padded = [p + bytes(-len(p) % 8) if len(p) > 7 else b"" for p in pieces]
        size = np.fromiter(map(len, padded), np.int64, len(padded)) >> 3
        self.blocks = _appended(self.blocks, self.blocks_used, np.frombuffer(b"".join(padded), "<u8"))
        block_at = self.blocks_used + np.cumsum(size) - size
        self.blocks_used += int(size.sum())
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, at)
        self.count = np.insert(self.count, where, count)
        self.block_at = np.insert(self.block_at, where, block_at)
        self.keys = np.insert(self.keys, where, keys)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and the offsets of the rows in them."""
        edges, inside = self._edges(buf, offsets)
        starts = piece_starts(buf, edges)
        if len(inside):
            at = np.searchsorted(inside[:, 0], starts, "left") - 1
            starts = starts[(at < 0) | (starts >= inside[at, 1])]
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        ids, sizes = [], []
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
            part, count = self._span(buf, starts[i:j], ends[i:j])
            ids.append(part)
            sizes.append(count)
            i = j
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        return flat, before[np.searchsorted(starts, offsets)] if len(starts) else np.zeros(len(offsets), np.int64)

    def _edges(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The offsets joined by both ends of each added token, and these spans; none crosses a document's end."""
        spans = []
        if self.added is not None and self.added.search(buf):
            rows = zip(offsets[:-1].tolist(), offsets[1:].tolist())
            spans = [m.span() for a, b in rows for m in self.added.finditer(buf, a, b)]
        inside = np.array(spans, offsets.dtype).reshape(-1, 2)
        return (np.union1d(offsets, inside) if spans else offsets), inside

    def _span(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pieces and how many each has."""
        size = ends - starts
        kept = size <= LONGEST
        keys = piece_keys(buf, starts, ends)
        names, first, inverse = np.unique(keys[kept], return_index=True, return_inverse=True)
        if len(self.keys) + len(names) > TABLE_PIECES:
            self.forget()
        where = np.searchsorted(self.keys, names)
        known = np.zeros(len(names), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == names[inside]
        new = np.flatnonzero(~known)
        if len(new):
            at = np.flatnonzero(kept)[first[new]]
            self._learn(names[new], _cut(buf, starts[at], ends[at]))
            where = np.searchsorted(self.keys, names)
        row = np.zeros(len(starts), np.int64)
        row[kept] = where[inverse]
        known = kept.copy()
        long = np.flatnonzero(kept & (size > 7))
        known[long[~self._same(buf, starts[long], ends[long], row[long])]] = False
        if known.all():
            count = self.count[row]
            shift = self.at[row] - (np.cumsum(count) - count)
            return self.pool[np.repeat(shift, count) + np.arange(int(count.sum()))], count
        # very long pieces, and any whose key another piece has, come from the library itself
        odd = np.flatnonzero(~known)
        flat, n = self._library([p.decode() for p in _cut(buf, starts[odd], ends[odd])])
        count, at = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        count[known], at[known] = self.count[row[known]], self.at[row[known]]
        count[odd], at[odd] = n, self.used + np.cumsum(n) - n
        pool = np.concatenate([self.pool[: self.used], flat])
        return pool[np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], count

    def _same(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether pieces beyond seven bytes equal those of the table's rows; lengths are part of a key."""
        same = np.ones(len(starts), bool)
        for i, here, number, words in blocks_of(buf, starts, ends):
            who = np.repeat(np.arange(i, i + len(here)), here)
            same[who[self.blocks[self.block_at[row[who]] + number] != words]] = False
        return same


def piece_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of pieces: length and bytes of up to seven bytes, else a hash that no such key equals.

    Keys of longer pieces hold their length's low bits, so pieces of up to ``LONGEST``
    bytes that have one key have one length.
    """
    size = ends - starts
    keys = np.zeros(len(starts), np.uint64)
    short, long = np.flatnonzero(size <= 7), np.flatnonzero(size > 7)
    keys[long] = hash_ranges(buf, starts[long], ends[long]) & np.uint64((1 << 55) - 1)
    keys[long] |= np.uint64(1 << 63) | (size[long].astype(np.uint64) & np.uint64(0xFF)) << np.uint64(55)
    if len(short):
        base, top = int(starts[0]), int(ends[-1])
        held = np.zeros(top - base + 8, np.uint8)
        held[: top - base] = buf[base:top]
        words = np.ndarray((top - base + 1,), "<u8", held, 0, (1,))[starts[short] - base]
        keys[short] = words & KEEP[size[short]] | size[short].astype(np.uint64) << np.uint64(56)
    return keys


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = buf.tobytes() if len(starts) > 64 and len(buf) <= 4 * SPAN else None
    return [raw[a:b] if raw else buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]


def _appended(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(pool):
        pool = np.concatenate([pool[:used], np.zeros(used + 2 * len(more), pool.dtype)])
    pool[used : used + len(more)] = more
    return pool


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    return Encoder(path)


def sentence_ends(tokenizer) -> np.ndarray:
    """For each id, whether its text ends a sentence or a line."""
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    texts = [tokenizer.id_to_token(i) or "" for i in range(size)]
    line_feed = "Ċ"  # how byte-level vocabularies write byte 10
    return np.array([t.endswith((".", "!", "?", line_feed)) for t in texts])
