"""Order-preserving packing of documents into token sequences by dynamic programming.

Documents in ascending id order make one stream of tokens for each range partition.
A sequence is a window of at most ``seq_len`` tokens between two cut points: document
ends, sentence ends, and every few tokens of a sentence that no window holds.  The
programme chooses the windows that minimise padding plus a penalty for each cut inside
a document.  Padding is linear in the window's length, so the best predecessor is a
sliding-window minimum that a monotone queue keeps; windows whose length is a power of
two need no padding and are further, exact predecessors.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bytehash import text_bytes
from tessella.llm.common import in_order
from tessella.llm.dac import ENCODED, slices
from tessella.llm.encode import encoder, sentence_ends

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long, padding long"
)


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, seq_len: int, step: int):
    """Cut points of a stream and the kind of each: 0 document, 1 sentence, 2 inside a sentence.

    A sentence of more than ``seq_len`` tokens is cut every ``step`` tokens.
    """
    kind = np.full(len(ids) + 1, 3, np.int8)
    kind[1:][ends_sentence[ids]] = 1
    kind[doc_ends] = 0
    kind[0] = 0
    at = np.flatnonzero(kind < 3)
    gaps = np.diff(at)
    for i in np.flatnonzero(gaps > seq_len):
        kind[np.arange(at[i] + step, at[i + 1], step)] = 2
    at = np.flatnonzero(kind < 3)
    return at, kind[at]


def best_windows(at: np.ndarray, penalty: np.ndarray, seq_len: int) -> np.ndarray:
    """Indexes of the cut points, first and last included, of the cheapest windows.

    Neighbouring cut points lie at most ``seq_len`` apart.  Ties go to the longer window.
    """
    n = len(at)
    exact: dict[int, list[int]] = {}
    size = seq_len // 2 if seq_len & (seq_len - 1) == 0 else 1 << (seq_len.bit_length() - 1)
    while size >= 64:
        where = np.searchsorted(at, at - size)
        hit = np.flatnonzero((at >= size) & (at[np.minimum(where, n - 1)] == at - size))
        for j, i in zip(hit.tolist(), where[hit].tolist()):
            exact.setdefault(j, []).append(i)
        size //= 2
    pos, pen = at.tolist(), penalty.tolist()
    cost, source = [0.0] * n, [0] * n
    key = [0.0] * n  # cost plus position: what a predecessor contributes
    key[0] = pos[0]
    queue = deque([0])
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - seq_len:
            queue.popleft()
        i = queue[0]
        best = key[i] + seq_len - p
        for e in exact.get(j, ()):
            if cost[e] < best:
                best, i = cost[e], e
        best += pen[j]
        cost[j], source[j] = best, i
        k = key[j] = best + p
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(j)
    path = [n - 1]
    while path[-1]:
        path.append(source[path[-1]])
    return np.array(path[::-1])


class _Stream:
    """Tokens of one partition that are not yet in a finished sequence."""

    def __init__(self, shard: int, ends_sentence: np.ndarray, seq_len: int, penalties: tuple[float, float]):
        self.next_id = shard << 40
        self.ends_sentence, self.seq_len = ends_sentence, seq_len
        self.penalties = np.array([0.0, *penalties])
        self.ids = np.zeros(0, np.uint32)
        # documents that reach into the stream: id, null, tokens, tokens gone before the stream
        self.docs = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, ids, names, null, sizes) -> None:
        self.ids = np.concatenate([self.ids, ids]) if len(self.ids) else ids
        new = (names, null, sizes, np.zeros(len(names), np.int64))
        self.docs = tuple(np.concatenate(x) for x in zip(self.docs, new))

    def pack(self, last: bool):
        """Finished sequences as a batch of pieces; all but the last window unless ``last``."""
        names, null, sizes, gone = self.docs
        doc_end = np.cumsum(sizes - gone)
        at, kind = cut_points(self.ids, doc_end, self.ends_sentence, self.seq_len, self.seq_len // 16)
        edges = at[best_windows(at, self.penalties[kind], self.seq_len)]
        if not last:
            if len(edges) < 3:
                return None
            edges = edges[:-1]
        stop = edges[-1]
        starts = np.union1d(edges[:-1], doc_end[doc_end < stop])
        ends = np.append(starts[1:], stop)
        doc = np.searchsorted(doc_end, starts, "right")
        window = np.searchsorted(edges, starts, "right") - 1
        length = np.diff(edges)
        padded = np.where(length & (length - 1) == 0, 0, self.seq_len - length)
        raw = memoryview(self.ids[:stop].astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
        doc_start = doc_end - sizes  # where the whole document would begin
        columns = [
            pa.array(names[doc], mask=null[doc]),
            pa.array(starts - doc_start[doc]),
            pa.array(ends - starts),
            pa.array(crc, pa.int64()),
            pa.array(sizes[doc]),
            pa.array(self.next_id + window),
            pa.array(starts - edges[window]),
            pa.array(length[window]),
            pa.array(padded[window]),
        ]
        self.next_id += len(edges) - 1
        left = int(np.searchsorted(doc_end, stop, "right"))
        rest = gone.copy()
        if left < len(sizes):
            rest[left] = stop - doc_start[left]
        self.docs = (names[left:], null[left:], sizes[left:], rest[left:])
        self.ids = self.ids[stop:]
        return pa.record_batch(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    seq_len: int = 1024,
    end_id: int = 0,
    sentence_penalty: float = 4.0,
    inside_penalty: float = 32.0,
    stretch: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, dealt into sequences of at most ``seq_len`` tokens.

    A document is its text's ids (a null text has none) and ``end_id``.  Documents stand
    in ascending id order, null ids first, ties by text; repeated rows are packed as often
    as they occur.  Every id lies in one piece; a sequence's pieces have offsets without
    gaps.  ``padding`` is what the piece's sequence lacks to ``seq_len`` (0 if its length
    is a power of two).  The programme runs over about ``stretch`` tokens at a time and
    hands the last open window on, so memory stays bounded.  Other columns are not read;
    an empty table has no pieces.
    """
    if seq_len < 16:
        raise ValueError("seq_len must be 16 or more")

    def pack(batches):
        codec = encoder(tokenizer)
        stream = _Stream(TaskContext.get().partitionId(), sentence_ends(codec.tokenizer), seq_len, (sentence_penalty, inside_penalty))
        for batch in batches:
            column = batch.column(0)
            names, null = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            buf, offsets = text_bytes(batch.column(1))
            for low, high in slices(offsets, ENCODED):
                part = offsets[low : high + 1]
                flat, at = codec.encode(buf[part[0] : part[-1]], part - part[0])
                stream.add(np.insert(flat, at[1:], end_id), names[low:high], null[low:high], np.diff(at) + 1)
                if len(stream.ids) >= stretch and (out := stream.pack(last=False)) is not None:
                    yield out
        if len(stream.ids):
            yield stream.pack(last=True)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_order(rows, "id", "text").mapInArrow(pack, SCHEMA)
