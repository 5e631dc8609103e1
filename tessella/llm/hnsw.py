"""Approximate nearest neighbours: a navigable small-world graph for each shard.

Distinct vectors are dealt into cells by their nearest centre, large cells are cut into
shards by hash, and each shard's graph is built alone and stored as flat arrays: for each
layer a matrix of neighbour numbers.  A query visits the shards of the cells whose centres
are nearest to it, and their answers are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bytehash import mix
from tessella.llm.common import written
from tessella.llm.pivots import lists, matrix
from tessella.llm.vectors import best, distinct_vectors, in_blocks, query_rows, sampled, spread_parts, valid


class Graph:
    """Layered neighbour lists over unit vectors; similarity is the inner product."""

    def __init__(self, x: np.ndarray, m: int, neighbours: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.m, self.entry = x, m, entry
        self.neighbours = neighbours or []
        self.seen = np.zeros(len(x), np.int64)
        self.round = 0

    @classmethod
    def build(cls, x: np.ndarray, m: int, width: int) -> "Graph":
        """Insert the vectors one by one; levels fall off by 1/m and come from a hash."""
        n = len(x)
        u = (mix(np.arange(n, dtype=np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(float) / 2**53
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int), 8)
        self = cls(x, m)
        self.neighbours = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        top = int(level[0]) if n else 0
        for i in range(1, n):
            at = [self.entry]
            for k in range(top, level[i], -1):
                at = [self._search(x[i], at, 1, k)[0][1]]
            for k in range(min(top, level[i]), -1, -1):
                near = self._search(x[i], at, width, k)
                self._link(i, near, k)
                at = [j for _, j in near]
            if level[i] > top:
                top, self.entry = int(level[i]), i
        return self

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of ``near``, nearest first, those that are nearer to the vector than to one chosen before."""
        ids = [j for _, j in near]
        x, own = self.x[ids], np.array([s for s, _ in near])
        among = x @ x.T
        open_ = np.ones(len(ids), bool)
        chosen: list[int] = []
        for p, j in enumerate(ids):
            if open_[p]:
                chosen.append(j)
                if len(chosen) == most:
                    return chosen
                open_ &= among[p] < own
        taken = set(chosen)
        return chosen + [j for j in ids if j not in taken][: most - len(chosen)]

    def _link(self, i: int, near: list[tuple[float, int]], k: int) -> None:
        table = self.neighbours[k]
        mine = self._spread(near, self.m)
        table[i, : len(mine)] = mine
        for j in mine:
            row = table[j]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = i
                continue
            ids = np.append(row, i)
            s = self.x[ids] @ self.x[j]
            order = np.argsort(-s, kind="stable")
            kept = self._spread([(float(s[o]), int(ids[o])) for o in order], len(row))
            row[:] = -1
            row[: len(kept)] = kept

    def _search(self, q: np.ndarray, start: list[int], width: int, k: int) -> list[tuple[float, int]]:
        """The ``width`` most similar found on layer ``k``, best first."""
        x, table, seen = self.x, self.neighbours[k], self.seen
        self.round += 1
        now = self.round
        seen[start] = now
        best_ = [(float(s), j) for s, j in zip(x[start] @ q, start)]
        ahead = [(-s, j) for s, j in best_]
        heapq.heapify(best_)
        heapq.heapify(ahead)
        while len(best_) > width:
            heapq.heappop(best_)
        while ahead:
            s, j = heapq.heappop(ahead)
            if -s < best_[0][0] and len(best_) >= width:
                break
            row = table[j]
            new = row[(row >= 0) & (seen[row] != now)]
            if not len(new):
                continue
            seen[new] = now
            near = x[new] @ q
            if len(best_) >= width:  # most neighbours of a late node are too far
                closer = near > best_[0][0]
                near, new = near[closer], new[closer]
            for t, i in zip(near.tolist(), new.tolist()):
                if len(best_) < width:
                    heapq.heappush(best_, (t, i))
                    heapq.heappush(ahead, (-t, i))
                elif t > best_[0][0]:
                    heapq.heapreplace(best_, (t, i))
                    heapq.heappush(ahead, (-t, i))
        return sorted(best_, reverse=True)

    def nearest(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        if not len(self.x):
            return []
        at = [self.entry]
        for k in range(len(self.neighbours) - 1, 0, -1):
            at = [self._search(q, at, 1, k)[0][1]]
        return self._search(q, at, width, 0)


_INDEX = "cell int, cut int, n int, m int, entry int, centre array<double>, layers array<binary>, vectors binary, members array<array<long>>"
_FOUND = "query_id long, query_key long, vec_id long, score double"
_SHARD = ["cell", "cut", "block"]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cell_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors in the middle of the groups into which the sample falls."""
    if not len(sample):
        return sample
    x = _unit(sample)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def build_index(
    rows: DataFrame, k: int, shard_rows: int = 4096, m: int = 16, build_width: int = 64, sample: int = 8192, most_cells: int = 1024
) -> DataFrame:
    """One row for each shard: its cell's centre, its distinct vectors, their ids, and the graph's flat arrays.

    There is a cell for each ``shard_rows`` vectors, up to ``most_cells``; centres are
    fitted on the first ``sample`` distinct vectors in hash order, and every vector is
    indexed.  A cell of more than ``shard_rows`` vectors is cut by hash into several
    shards, so no group of near vectors is too large for a task.
    """
    spark = rows.sparkSession
    points = written(distinct_vectors(rows, k + 1), "points")
    count = points.count()
    centres = cell_centres(sampled(points, sample), max(1, min(most_cells, -(-count // shard_rows))))

    def place(batches):
        for b in batches:
            x = matrix(b.column("vector"))
            near = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "cell"])

    placed = written(points.mapInArrow(place, "vector array<double>, members array<long>, cell int"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("cuts")).collect()  # a row for each cell
    known = spark.createDataFrame([tuple(r) for r in sizes], "cell int, cuts int")
    cut = F.pmod(F.xxhash64("vector"), F.col("cuts")).cast("int")

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by([("first", "ascending")])  # the graph doesn't hang on the shuffle's order
        x = matrix(part.column("vector"))
        graph = Graph.build(_unit(x), m, build_width)
        cell = part.column("cell")[0].as_py()
        layers = [t.astype("<i4").tobytes() for t in graph.neighbours]
        row = (cell, part.column("cut")[0].as_py(), len(x), m, graph.entry, centres[cell].tolist(), layers, x.tobytes(), lists(part.column("members")))
        kinds = [pa.int32()] * 5 + [pa.list_(pa.float64()), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in _INDEX.split(", ")])

    first = placed.join(F.broadcast(known), "cell").withColumn("cut", cut).withColumn("first", F.element_at("members", 1)).drop("cuts")
    parts = spread_parts(spark, sum(r.cuts for r in sizes))
    return written(first.repartition(parts, "cell", "cut").groupBy("cell", "cut").applyInArrow(build, _INDEX), "hnsw")


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = 128, reach: float = 4.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of the visited shards' answers.

    A query visits the ``reach * sqrt(cells)`` cells whose centres are nearest (8 at
    least), so what is sent grows with the square root of the index alone.  Queries come
    in blocks, and a shard goes to the blocks that have a query for it.
    """
    heads = index.select("cell", "cut", "centre").orderBy("cell", "cut").collect()  # a row for each shard
    cuts, middles = {}, {}
    for r in heads:
        cuts.setdefault(r.cell, []).append(r.cut)
        middles[r.cell] = r.centre
    cells = np.array(sorted(cuts), np.int32)
    centres = np.array([middles[c] for c in cells.tolist()]).reshape(len(cells), -1) if heads else np.zeros((0, 0))
    visits = min(len(cells), max(8, int(np.ceil(reach * np.sqrt(len(cells))))))

    def route(batches):
        for b in batches:
            q = matrix(b.column("vector"))
            for at in range(0, len(q), 256):
                part = q[at : at + 256] @ centres.T
                near = np.argpartition(-part, visits - 1, axis=1)[:, :visits] if len(cells) else np.zeros((len(part), 0), int)
                who, cell, cut = [], [], []
                for i, row in enumerate(near):
                    for c in cells[row].tolist():
                        who += [at + i] * len(cuts[c])
                        cell += [c] * len(cuts[c])
                        cut += cuts[c]
                rest = b.take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(cell, pa.int32()), pa.array(cut, pa.int32())], names=[*b.schema.names, "cell", "cut"])

    sent = in_blocks(queries).mapInArrow(route, "query_id long, vector array<double>, query_key long, block int, cell int, cut int")
    sent = written(sent, "sent")

    def search(here: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for shard in here.to_pylist():
            x = np.frombuffer(shard["vectors"], "<f8").reshape(shard["n"], -1)
            layers = [np.frombuffer(b, "<i4").reshape(shard["n"], -1) for b in shard["layers"]]
            norms = np.sqrt((x * x).sum(axis=1))
            graph = Graph(x / norms[:, None], shard["m"], layers, shard["entry"])
            q = matrix(questions.column("vector"))
            for name, key, v in zip(questions.column("query_id").to_pylist(), questions.column("query_key").to_pylist(), q):
                size = np.sqrt((v * v).sum())
                ids = np.array([i for _, i in graph.nearest(v / size, max(width, k + 1))])
                exact = (x[ids] * v).sum(axis=1) / (norms[ids] * size)
                hits = [(-s, p) for s, i in zip(exact.tolist(), ids.tolist()) for p in shard["members"][i] if p != name]
                out += [(name, key, p, -s) for s, p in sorted(hits)[:k]]
        columns = list(zip(*out)) if out else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])

    needed = sent.groupBy(*[F.col(c).alias(c) for c in _SHARD]).agg(F.lit(1)).select(*_SHARD)
    parts = spread_parts(index.sparkSession, len(heads))
    here = index.drop("centre").join(needed, _SHARD[:2]).repartition(parts, *_SHARD)
    asked = sent.repartition(parts, *_SHARD)
    found = here.groupBy(*_SHARD).cogroup(asked.groupBy(*_SHARD)).applyInArrow(search, _FOUND)
    return best(found, k, [F.desc("score"), F.col("vec_id")]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, width: int = 128, **options) -> DataFrame:
    """Each query's ``k`` nearest rows found by cosine: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows
    with another id; ties go to the smaller id.  Zero vectors and the rows that
    ``vectors.valid`` leaves out take no part; repeats of a row count once, and an id that
    has several vectors is a query and a candidate with each.  ``score`` is the cosine in
    double precision of the original vectors.  ``options`` are those of ``build_index``.
    """
    rows = valid(vectors).withColumn("vector", F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)))
    rows = rows.filter(F.exists("vector", lambda x: x != 0))
    return search_index(build_index(rows, k, **options), query_rows(rows, every), k, width)
