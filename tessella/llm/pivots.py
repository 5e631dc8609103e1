"""Exact top-k inner products with a pivot-distance index.

Vectors of integer codes get one coordinate more, which gives all the same length; the
largest inner product is then the nearest vector.  Each vector is keyed by its nearest
pivot and the distance to it, which put it into an annulus.  A query first visits the
annulus that lies nearest, which gives it a k-th best score; then it is sent only to the
annuli that the triangle inequality leaves, and within these it widens in blocks until
the same bound stops it.  Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.vectors import best, distinct_vectors, in_blocks, query_rows, sampled, spread_parts, valid

_FOUND = "query_id long, query_key long, vec_id long, score long"
_SHARD = ["pivot", "ring", "cut", "block"]


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(column) -> list[list[int]]:
    return column.to_pylist()


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in float64 where every sum is exact there."""
    top = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    if top * top * x.shape[1] < 2**53:
        return (x @ q.T).astype(np.int64)
    if top * top * x.shape[1] >= 2**63:
        raise OverflowError("inner products don't fit into 64 bits")
    return x.astype(np.int64) @ q.astype(np.int64).T


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``sample``, each farthest from those before it."""
    if not len(sample):
        return sample
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if gap.max() == 0:
            break
        chosen.append(int(gap.argmax()))
    return sample[chosen]


class _Annuli:
    """One shard: vectors of a pivot's annulus in order of distance, in blocks."""

    def __init__(self, codes, members, dist, long2: float, block: int):
        order = np.argsort(dist, kind="stable")
        self.x, self.dist = codes[order], dist[order]
        self.members = [members[i] for i in order]
        self.first = np.array([m[0] for m in self.members])
        self.long2 = long2
        self.edges = list(range(0, len(order), block)) + [len(order)]
        low = np.array([self.dist[a] for a in self.edges[:-1]])
        high = np.array([self.dist[b - 1] for b in self.edges[1:]])
        self.low, self.high = low, high
        self.computed = 0

    def search(self, q: np.ndarray, to_pivot: np.ndarray, k: int, bar: np.ndarray):
        """For each query, rows (score, place) of its k + 1 best distinct vectors.

        ``bar`` is a score that k candidates of each query are known to reach; what the
        bound puts below it may be left out.  ``computed`` counts products.
        """
        gap = np.maximum(0, np.maximum(to_pivot[:, None] - self.high, self.low - to_pivot[:, None]))
        turn = np.argsort(gap, axis=1, kind="stable")
        norm2 = (q**2).sum(axis=1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
        reach = _reach(bar, norm2, self.long2)
        slack = 1e-6 * (1 + np.sqrt(norm2 + self.long2))
        for step in range(turn.shape[1]):
            block = turn[:, step]
            active = gap[np.arange(len(q)), block] <= reach + slack
            if not active.any():
                break
            for b in np.unique(block[active]):
                rows = np.flatnonzero(active & (block == b))
                a, e = self.edges[b], self.edges[b + 1]
                scores = products(self.x[a:e], q[rows])
                self.computed += scores.size
                for j, r in enumerate(rows):
                    s = np.concatenate([found[r][0], scores[:, j]])
                    at = np.concatenate([found[r][1], np.arange(a, e)])
                    if len(s) > k + 1:
                        cut = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        near = s >= cut
                        s, at = s[near], at[near]
                    order = np.lexsort((self.first[at], -s))[: k + 1]
                    found[r] = s[order], at[order]
                    if len(order) > k:
                        reach[r] = min(reach[r], np.sqrt(max(0.0, norm2[r] + self.long2 - 2 * float(s[order[-1]]))))
        return found


def _reach(bar: np.ndarray, norm2: np.ndarray, long2: float) -> np.ndarray:
    """The distance at which a lifted vector has the score ``bar``; infinite where there is none."""
    return np.where(np.isfinite(bar), np.sqrt(np.maximum(0, norm2 + long2 - 2 * np.where(np.isfinite(bar), bar, 0))), np.inf)


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    pivots: int = 16,
    sample: int = 4096,
    shard_rows: int = 4096,
    block: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products of codes.

    A code is floor(scale * component); scores that don't fit into 64 bits are an error.
    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows
    with another id; ties go to the smaller id.  Rows that ``vectors.valid`` leaves out
    take no part; repeats of a row count once, and an id that has several vectors is a
    query and a candidate with each.  Pivots and the borders of their annuli come from the
    first ``sample`` distinct vectors in hash order; they steer the work only.  An annulus
    with more than ``shard_rows`` vectors is cut by hash, and queries come in blocks, so
    what a task holds doesn't grow with the table.
    """
    spark = vectors.sparkSession
    codes = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    rows = valid(vectors).withColumn("vector", codes)
    points = written(distinct_vectors(rows, k + 1), "codes")
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top, count = points.agg(F.max(norm2), F.count("*")).first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    long2 = float(top)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, long2 - (x**2).sum(axis=1)))])

    few = lifted(sampled(points, sample))
    centres = choose_pivots(few, pivots)

    def distances(x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T
        return np.sqrt(np.maximum(0, square))

    d = distances(few)
    near, step = d.argmin(axis=1), max(1, round(shard_rows * len(few) / count))
    borders = [np.sort(d[near == p, p])[step::step] for p in range(len(centres))]

    def key(batches):
        for b in batches:
            d = distances(lifted(matrix(b.column("vector"))))
            near = d.argmin(axis=1)
            dist = d[np.arange(len(d)), near]
            ring = np.zeros(len(d), np.int32)
            for p in np.unique(near):
                ring[near == p] = np.searchsorted(borders[p], dist[near == p], "right")
            more = [pa.array(near.astype(np.int32)), pa.array(ring), pa.array(dist)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "pivot", "ring", "dist"])

    keyed = written(points.mapInArrow(key, "vector array<long>, members array<long>, pivot int, ring int, dist double"), "keyed")
    # a row for each annulus, of which there are about count / shard_rows
    rings = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).toPandas()
    cuts = np.maximum(1, -(-rings["n"].to_numpy() // shard_rows))
    pivot, ring = np.repeat(rings["pivot"].to_numpy(), cuts), np.repeat(rings["ring"].to_numpy(), cuts)
    low, high = np.repeat(rings["low"].to_numpy(), cuts), np.repeat(rings["high"].to_numpy(), cuts)
    cut = np.concatenate([np.arange(c) for c in cuts])
    sizes = spark.createDataFrame(list(zip(rings["pivot"].tolist(), rings["ring"].tolist(), cuts.tolist())), "pivot int, ring int, cuts int")
    shard = F.pmod(F.xxhash64("vector"), F.col("cuts")).cast("int")
    index = keyed.join(sizes, ["pivot", "ring"]).withColumn("cut", shard).drop("cuts")
    asked = written(in_blocks(query_rows(rows, every)), "asked")

    def gaps(q: np.ndarray) -> np.ndarray:
        """How far each shard's annulus is from each query, at least."""
        to_pivot = distances(np.column_stack([q, np.zeros(len(q))]))[:, pivot]
        return np.maximum(0, np.maximum(to_pivot - high, low - to_pivot))

    def route(second: bool):
        """The shard of the nearest annulus, or all others that the bound leaves, for each query."""

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    q = matrix(b.column("vector"))
                    gap = gaps(q)
                    home = gap.argmin(axis=1)
                    if second:
                        bar = b.column("bar").fill_null(0).to_numpy(zero_copy_only=False).astype(float)
                        bar[b.column("bar").is_null().to_numpy(zero_copy_only=False)] = -np.inf
                        norm2 = (q**2).sum(axis=1)
                        left = gap <= (_reach(bar, norm2, long2) + 1e-6 * (1 + np.sqrt(norm2 + long2)))[:, None]
                        left[np.arange(len(q)), home] = False
                        who, to = np.nonzero(left)
                    else:
                        who, to = np.arange(len(q)), home
                    rest = b.select(["query_id", "query_key", "vector", "block", "bar"]).take(pa.array(who))
                    place = [pa.array(v[to].astype(np.int32)) for v in (pivot, ring, cut)]
                    yield pa.RecordBatch.from_arrays([*rest.columns, *place], names=[*rest.schema.names, "pivot", "ring", "cut"])

        return run

    schema = "query_id long, query_key long, vector array<long>, block int, bar long, pivot int, ring int, cut int"

    def search(here: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if here.num_rows and queries.num_rows:
            part = _Annuli(matrix(here.column("vector")), lists(here.column("members")), here.column("dist").to_numpy(), long2, block)
            q = matrix(queries.column("vector"))
            flat = np.column_stack([q, np.zeros(len(q))])
            to_pivot = np.sqrt(((flat - centres[here.column("pivot")[0].as_py()]) ** 2).sum(axis=1))
            bar = np.array([-np.inf if b is None else b for b in queries.column("bar").to_pylist()], float)
            names, keys = queries.column("query_id").to_pylist(), queries.column("query_key").to_pylist()
            for (scores, at), name, qk in zip(part.search(q, to_pivot, k, bar), names, keys):
                hits = [(-s, m) for s, i in zip(scores.tolist(), at.tolist()) for m in part.members[i] if m != name]
                out += [(name, qk, m, -s) for s, m in sorted(hits)[:k]]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _FOUND.split(", ")])

    def visit(sent: DataFrame) -> DataFrame:
        # a shard goes to the blocks that have a query for it, and to no others
        needed = sent.groupBy(*[F.col(c).alias(c) for c in _SHARD]).agg(F.lit(1)).select(*_SHARD)
        parts = spread_parts(spark, len(pivot))
        here = index.join(needed, _SHARD[:3]).repartition(parts, *_SHARD)
        return here.groupBy(*_SHARD).cogroup(sent.repartition(parts, *_SHARD).groupBy(*_SHARD)).applyInArrow(search, _FOUND)

    first = asked.withColumn("bar", F.lit(None).cast("long")).mapInArrow(route(second=False), schema)
    first = written(visit(written(first, "sent")), "first")
    ranked = best(first, k, [F.desc("score"), F.col("vec_id")])
    bars = ranked.filter(F.col("rank") == k).select("query_id", "query_key", F.col("score").alias("bar"))
    second = asked.join(bars, ["query_id", "query_key"], "left").mapInArrow(route(second=True), schema)
    found = first.unionByName(visit(written(second, "sent")))
    return best(found, k, [F.desc("score"), F.col("vec_id")]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
