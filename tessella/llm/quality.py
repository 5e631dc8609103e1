"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, many documents at once, in numpy.  Trees are complete
and lie in flat arrays (feature, threshold, leaf value), so a batch walks all trees with
array look-ups, one step for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessella.llm.bytehash import SPAN, hash_ranges, text_bytes
from tessella.llm.common import unused
from tessella.llm.dac import slices

#: Byte classes that are counted; a class is a test on the byte value.
CLASSES = {
    "lower": lambda b: (b >= 97) & (b <= 122),
    "upper": lambda b: (b >= 65) & (b <= 90),
    "digit": lambda b: (b >= 48) & (b <= 57),
    "blank": lambda b: (b == 32) | ((b >= 9) & (b <= 13) & (b != 10)),
    "line": lambda b: b == 10,
    "stop": lambda b: np.isin(b, list(b".,;:?'\"()-")),
    "shout": lambda b: b == ord("!"),
    "bar": lambda b: b == ord("|"),
    "sign": lambda b: np.isin(b, list(b"#$%&*+/<=>@[\\]^_`{}~")),
    "wide": lambda b: b >= 128,
}
FEATURES = [f"share_{c}" for c in CLASSES] + [
    "log_bytes", "log_words", "word_bytes", "upper_of_letters", "distinct_words", "top_word", "repeated_next", "distinct_pairs",
    "words_a_line", "ends_in_sign", "starts_upper",
]


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for k, test in enumerate(CLASSES.values()):
        table[test(np.arange(256))] = k
    return table


_TABLE = _class_table()
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document, how many distinct keys it has, and the count of its most frequent one."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n), most


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text of a batch; shares of an empty text are 0."""
    n, size = len(offsets) - 1, np.diff(offsets)
    k = len(CLASSES) + 1
    counts = np.zeros(n * k)
    for low in range(0, len(buf), SPAN):
        high = min(len(buf), low + SPAN)
        doc = np.searchsorted(offsets, np.arange(low, high), "right") - 1 if n < 2 else None
        if doc is None:
            inside = np.clip(offsets, low, high)
            doc = np.repeat(np.arange(n), np.diff(inside))
        counts += np.bincount(doc * k + _TABLE[buf[low:high]], minlength=n * k)
    counts = counts.reshape(n, k)
    white = _WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins = ~white & np.concatenate([[True], white[:-1]]) | ~white & edge[: len(buf)]
    starts = np.flatnonzero(begins)
    stops = ~white & np.concatenate([white[1:], [True]]) | ~white & edge[1:]
    ends = np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    key = hash_ranges(buf, starts, ends)
    distinct, most = _distinct(doc, key, n)
    same_doc = doc[1:] == doc[:-1]
    again = np.bincount(doc[1:][same_doc & (key[1:] == key[:-1])], minlength=n)
    pairs, _ = _distinct(doc[1:][same_doc], (key[1:] * np.uint64(3) + key[:-1])[same_doc], n)
    last, head = _TABLE[buf[ends - 1]] if len(ends) else ends, _TABLE[buf[starts]] if len(starts) else starts
    names = list(CLASSES)
    signs = [names.index(c) for c in ("shout", "bar", "sign")]
    of = lambda x, y: np.divide(x, y, out=np.zeros(n), where=np.asarray(y) > 0)
    letters = counts[:, 0] + counts[:, 1]
    return np.column_stack(
        [of(counts[:, i], size) for i in range(len(CLASSES))]
        + [
            np.log1p(size),
            np.log1p(words),
            of(size - counts[:, names.index("blank")], words),
            of(counts[:, 1], letters),
            of(distinct, words),
            of(most, words),
            of(again, words),
            of(pairs, np.maximum(words - 1, 0)),
            of(words, counts[:, names.index("line")] + 1),
            of(np.bincount(doc[np.isin(last, signs)], minlength=n), words),
            of(np.bincount(doc[head == 1], minlength=n), words),
        ]
    )


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes row by row, then leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        inner = self.feature.shape[1]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        while len(self.leaf) and node.size and node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        total = self.base + (self.leaf[tree, node - inner].sum(axis=1) if len(self.leaf) and node.size else 0.0)
        return 1 / (1 + np.exp(-np.broadcast_to(total, len(x))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Boost logistic loss; each level's splits come from histograms of binned features."""
    inner, d = (1 << depth) - 1, x.shape[1]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    features, thresholds, leaves = [], [], []
    total = np.full(len(y), base)
    columns = np.arange(d) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (d * bins) + columns + binned).ravel()
            shape = (width, d, bins)
            gs = np.bincount(cell, np.repeat(g, d), width * d * bins).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, d), width * d * bins).reshape(shape).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < 1) | (ha - hs < 1)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, cut = divmod(int(b), bins)
                if gain[k, j, cut] > 1e-6 and cut < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> Trees:
    """Trees fitted on labelled rows that aren't held out.

    ``most_rows`` bounds the sample, taken in order of id hash; statistics of those rows
    alone come to the driver.  Labels other than 0 and 1 and null ids are left out.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).distinct()
    sample = known.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(most_rows)

    def measure(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(0))
            for low, high in slices(offsets):
                part = offsets[low : high + 1]
                x = statistics(buf[part[0] : part[-1]], part - part[0])
                rest = batch.slice(low, high - low)
                flat = pa.array(x.ravel())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.record_batch([rest.column(1), rest.column(2), rows], names=["quality", "turn", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "label_id").select("text", "quality", F.xxhash64("label_id", "text").alias("turn"))
    # a repeated id could bring more rows than labels: bound them once more
    found = rows.mapInArrow(measure, "quality int, turn long, x array<double>").orderBy("turn", "quality").limit(most_rows).collect()
    x = np.array([r.x for r in found]).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r.quality for r in found], float), **options)


def score(
    docs: DataFrame, model: Trees, threshold: float = 0.3, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 from ``threshold``); all rows are kept.

    Null and empty texts have the score of all-zero statistics.  Columns of ``docs`` that
    have one of the two ``names`` are replaced.
    """
    rest = [c for c in docs.columns if c not in names]
    place, source = rest.index(text_col), docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = StructType([*source.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])

    def run(batches):
        for batch in batches:
            buf, offsets = text_bytes(batch.column(place))
            parts = [model.scores(statistics(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets)]
            p = np.concatenate(parts) if parts else np.zeros(0)
            columns = [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns."""
    names = (unused("score", docs), unused("predicted", docs))
    return score(docs, model, threshold, names=names).filter(F.col(names[1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
