"""A Bloom filter of bounded size that spares rows a shuffle.

It only ever lets too many rows pass, so what follows it still joins exactly; a table
with more keys than the filter is made for passes more rows and stays right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bytehash import mix
from tessella.llm.common import written

#: Bits of a filter at most (8 MB), bits for each key below that, and bits set by a key.
MOST_BITS, BITS_A_KEY, PROBES = 1 << 26, 12, 4


class Sieve:
    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        """``PROBES`` bit numbers of each key; ``bits`` is a power of two."""
        a = mix(keys.view(np.uint64))
        b = mix(a) | np.uint64(1)
        steps = np.arange(PROBES, dtype=np.uint64)[:, None]
        return (a + steps * b) & np.uint64(bits - 1)

    @classmethod
    def build(cls, keys: DataFrame, column: str, count: int) -> "Sieve":
        """The filter of a long column; ``count`` sizes it.  At most ``MOST_BITS / 64`` rows come to the driver."""
        bits = 64
        while bits < min(MOST_BITS, BITS_A_KEY * count):
            bits *= 2

        def mark(batches):
            for b in batches:
                at = cls.places(b.column(0).to_numpy(zero_copy_only=False), bits).ravel()
                bit = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bit)], names=["word", "bit"])

        marked = keys.select(F.col(column).cast("long")).dropna().mapInArrow(mark, "word int, bit long")
        found = marked.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that the filter was surely not built from."""
        at = self.places(keys, len(self.words) * 64)
        hit = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        return hit.astype(bool).all(axis=0)

    def split(self, rows: DataFrame, column: str, maybe: bool) -> DataFrame:
        """The rows whose non-null key in ``column`` (a long) the filter may have, or all others.

        Keys alone go to Python; the rest of a row, however wide, stays in the JVM.
        """

        def test(keys: pa.Array) -> pa.Array:
            mask = self.has(keys.fill_null(0).to_numpy(zero_copy_only=False))
            return pa.array(mask & keys.is_valid().to_numpy(zero_copy_only=False))

        found = F.arrow_udf(test, "boolean")(F.col(f"`{column}`"))
        return rows.filter(found if maybe else ~found)


def without(rows: DataFrame, name: str, same: Column, heads: DataFrame, head: str, same_head: Column, gone: DataFrame, gone_name: str) -> DataFrame:
    """``rows`` that aren't in ``gone``, an anti-join that moves few rows however wide they are.

    ``heads`` has the key of every row of ``rows`` that ``gone`` might have, without what
    makes rows wide; ``name``, ``head`` and ``gone_name`` are the columns with the key's hash (a long)
    of each table, and ``same`` and ``same_head`` compare the keys themselves with those of
    ``gone``.  A filter of ``gone`` tells most rows that stay; a filter of the heads that
    pass it wrongly tells most of those that go; only what passes both is joined.
    """
    sieve = Sieve.build(gone, gone_name, gone.count())
    wrong = sieve.split(heads, head, maybe=True).join(gone, same_head, "left_anti").select(F.col(head).alias("wrong"))
    wrong = written(wrong.distinct(), "wrong")
    second = Sieve.build(wrong, "wrong", wrong.count())
    doubtful = second.split(sieve.split(rows, name, maybe=True), name, maybe=True).join(gone, same, "left_anti")
    return sieve.split(rows, name, maybe=False).unionByName(doubtful)
