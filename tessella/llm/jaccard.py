"""Exact Jaccard join of word-shingle sets over a count-vector R-tree.

A set's shingles are hashed into groups; the group counts are a point, and the summed
coordinate minima of two points bound their sets' overlap from above.  An R-tree of points
keeps the coordinate maxima of each node, so whole pairs of nodes are ruled out by the same
bound, and only pairs that survive it are verified on the sets.

One tree over all documents would not do on a cluster: in so many dimensions its upper
nodes all overlap.  So documents are first dealt into blocks by keys that two near sets
must share (``shingles.Prefixes``), and each block has its tree.  Equal sets are one
class throughout.  In a block, members are first compared with one of them, its lead;
those linked to it are one part from then on, within which nothing is compared, so the
tree's work in a large near group grows with its members, not with their pairs.  A block
yields the links of a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bytehash import mix, text_bytes
from tessella.llm.common import unused, written
from tessella.llm.dac import slices
from tessella.llm.graph import components
from tessella.llm.shingles import Prefixes, set_hashes, shingle_sets
from tessella.llm.sieve import Sieve, without

#: Coordinates of a point, points in a leaf of the tree, and children of an inner node.
GROUPS, LEAF, FAN = 256, 32, 8
#: Classes of one block that are compared in one task; larger blocks are cut.
BLOCK = 2000
#: Documents of the sample that tells common shingles at least, the share of all that it
#: takes at least, and common shingles kept at most.
SAMPLED, SHARE, COMMON = 5000, 1 / 50, 200_000
#: Names that a Python task remembers at most, to leave out what it has seen.
REMEMBERED = 100_000


def group_counts(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A point for each set: how many members fall into each group."""
    n = len(offsets) - 1
    slot = np.repeat(np.arange(n), np.diff(offsets)) * GROUPS + (mix(h) % np.uint64(GROUPS)).astype(np.int64)
    return np.bincount(slot, minlength=n * GROUPS).reshape(n, GROUPS)


class CountTree:
    """An R-tree of group counts, packed by size and then by the coordinate that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, sizes, percent
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * FAN
        for a in range(0, len(order), slab):
            part = order[a : a + slab]
            wide = int(points[part].var(axis=0).argmax()) if len(part) > LEAF else 0
            order[a : a + slab] = part[np.argsort(points[part, wide], kind="stable")]
        # levels from the leaves up: (member lists, coordinate maxima, smallest and largest size)
        nodes = [order[a : a + LEAF] for a in range(0, len(order), LEAF)]
        self.levels = [self._level(nodes, points, sizes, sizes)]
        while len(self.levels[-1][0]) > FAN:
            below = self.levels[-1]
            nodes = [np.arange(a, min(a + FAN, len(below[0]))) for a in range(0, len(below[0]), FAN)]
            self.levels.append(self._level(nodes, *below[1:]))

    @staticmethod
    def _level(nodes, top, small, large):
        return (
            nodes,
            np.array([top[m].max(axis=0) for m in nodes]),
            np.array([small[m].min() for m in nodes]),
            np.array([large[m].max() for m in nodes]),
        )

    def _near(self, top_a, small_a, large_a, top_b, small_b, large_b) -> np.ndarray:
        """Which pairs of nodes (or points) may hold a link."""
        p = self.percent
        shared = np.minimum(top_a[:, None, :], top_b[None, :, :]).sum(axis=2)
        enough = (100 + p) * shared >= p * (small_a[:, None] + small_b[None, :])
        return enough & (100 * large_b[None, :] >= p * small_a[:, None]) & (100 * large_a[:, None] >= p * small_b[None, :])

    def near(self, i: int) -> np.ndarray:
        """Which points may link to point i."""
        point = lambda k: (self.points[k], self.sizes[k], self.sizes[k])
        return self._near(*point([i]), *point(slice(None)))[0]

    def pairs(self, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All pairs i, j of points, i before j in the tree, that the bound leaves.

        Points with one ``part`` of 0 or more are left out as pairs, and so are nodes that
        hold one part alone.  ``tested`` counts the pairs of points that are looked at.
        """
        part = np.full(len(self.points), -1) if part is None else part
        parts = [np.array([part[m[0]] if (part[m] == part[m[0]]).all() else -1 for m in self.levels[0][0]])]
        for nodes, *_ in self.levels[1:]:
            below = parts[-1]
            parts.append(np.array([below[m[0]] if (below[m] == below[m[0]]).all() else -1 for m in nodes]))

        def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (p[:, None] != q[None, :]) | (p[:, None] < 0)

        nodes, top, small, large = self.levels[-1]
        self.tested = 0
        a, b = np.nonzero(np.triu(self._near(top, small, large, top, small, large) & apart(parts[-1], parts[-1])))
        for level in range(len(self.levels) - 1, 0, -1):
            nodes, below, of = self.levels[level][0], self.levels[level - 1], parts[level - 1]
            found = []
            for x, y in zip(a.tolist(), b.tolist()):
                m, n = nodes[x], nodes[y]
                i, j = np.nonzero(self._near(*(v[m] for v in below[1:]), *(v[n] for v in below[1:])) & apart(of[m], of[n]))
                i, j = m[i], n[j]
                found.append((i[i <= j], j[i <= j]) if x == y else (i, j))
            a, b = (np.concatenate(c) for c in zip(*found)) if found else (a[:0], b[:0])
        nodes, found = self.levels[0][0], []
        for x, y in zip(a.tolist(), b.tolist()):
            m, n = nodes[x], nodes[y]
            point = lambda k: (self.points[k], self.sizes[k], self.sizes[k])
            self.tested += len(m) * (len(m) - 1) // 2 if x == y else len(m) * len(n)
            i, j = np.nonzero(self._near(*point(m), *point(n)) & apart(part[m], part[n]))
            keep = i < j if x == y else slice(None)
            found.append((m[i[keep]], n[j[keep]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Exact overlaps of all pairs of the given sets, by products of membership columns.

    Members that one set alone has are left out; the rest come in slices, so memory is
    bounded.
    """
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(rows), len(rows)))
    width = max(256, 4_000_000 // max(1, len(rows)))
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        table = np.zeros((len(rows), min(width, int(shared.sum()) - low)), np.float32)
        table[owner[a:b], column[a:b] - low] = 1
        out += table @ table.T
    return out.astype(np.int64)


def _shared(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many members of the ascending ``pivot`` each set has."""
    out = np.zeros(len(sets), np.int64)
    for i, s in enumerate(sets):
        at = np.searchsorted(pivot, s)
        out[i] = np.count_nonzero(pivot[np.minimum(at, len(pivot) - 1)] == s)
    return out


def star(sets: list[np.ndarray], lead: int, percent: int) -> list[tuple[int, int]]:
    """Links of the sets with one of them, as pairs of places."""
    both, sizes = _shared(sets[lead], sets), np.array([len(s) for s in sets])
    near = np.flatnonzero((100 + percent) * both >= percent * (sizes + sizes[lead]))
    return [(x, lead) for x in near.tolist() if x != lead]


def links(sets: list[np.ndarray], points: np.ndarray, percent: int, lead: int | None = 0, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets, as pairs of places.

    Sets with one ``part`` of 0 or more are linked already.  Without parts, stars come
    first: all are compared with ``lead``, what is left with the first that is left, and
    so on while it pays.
    """
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(points, sizes, percent)
    root = list(range(len(sets)))
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(x: int, y: int) -> None:
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))

    if part is None:
        part = np.full(len(sets), -1)
        centre = lead
        while centre is not None:
            left = np.flatnonzero((part < 0) & tree.near(centre))
            left = left[left != centre]
            both = _shared(sets[centre], [sets[i] for i in left])
            near = left[(100 + percent) * both >= percent * (sizes[left] + sizes[centre])]
            part[centre] = centre
            part[near] = centre
            for x in near.tolist():
                join(x, centre)
            free = np.flatnonzero(part < 0)
            centre = int(free[0]) if len(near) > 1 and len(free) else None
    else:
        for p in np.unique(part[part >= 0]):
            same = np.flatnonzero(part == p).tolist()
            for x in same[1:]:
                root[x] = same[0]
    i, j = tree.pairs(part)
    if len(i) > 8 * len(sets):
        rows = np.unique(np.concatenate([i, j]))
        at = np.searchsorted(rows, i), np.searchsorted(rows, j)
        both = _overlaps(sets, rows)[at]
        good = (100 + percent) * both >= percent * (sizes[i] + sizes[j])
        for x, y in zip(i[good].tolist(), j[good].tolist()):
            join(x, y)
    else:
        for x, y in zip(i.tolist(), j.tolist()):
            if find(x) != find(y):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if (100 + percent) * both >= percent * (sizes[x] + sizes[y]):
                    join(x, y)
    return out


def _groups(batches, keys: int):
    """Tables of rows that agree in their first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != v for c, v in zip(cols, last))
        last = [c[-1] for c in cols]
        start = 0
        for at in np.flatnonzero(change):
            if at > start:
                held.append(batch.slice(start, at - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], int(at)
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _pack_point(p: np.ndarray) -> bytes:
    """Two bytes a count, or four where a count needs them."""
    return p.astype("<u2" if p.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _points(column) -> np.ndarray:
    blobs = [b.as_buffer() for b in column]
    return np.stack([np.frombuffer(b, "<u2" if b.size == 2 * GROUPS else "<u4").astype(np.int32) for b in blobs])


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes()


def _unpack(data) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _fresh(seen: set[int], names: list[int]) -> list[int]:
    """Places of the names that ``seen`` lacks, which it then has; it starts anew when it is full."""
    if len(seen) > REMEMBERED:
        seen.clear()
    out = []
    for i, x in enumerate(names):
        if x not in seen:
            seen.add(x)
            out.append(i)
    return out


def _per_text(words: int, make):
    """A mapInArrow function over (text, ...): ``make(rest, sets, offsets)`` for each slice of a batch."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            buf, offsets = text_bytes(batch.column(0))
            for low, high in slices(offsets):
                part = offsets[low : high + 1]
                h, at = shingle_sets(buf[part[0] : part[-1]], part - part[0], words)
                yield make(batch.slice(low, high - low), h, at, seen)

    return run


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least three documents of a sample have, ascending, and how many have them.

    They only steer which keys are made; no link hangs on them.  The sample grows with the
    table, and at most ``COMMON`` of its shingles come to the driver.
    """
    step = max(1, min(rows.count() // SAMPLED, round(1 / SHARE)))
    some = rows.filter(F.pmod(_row_hash(), F.lit(step)) == 0).select("text")

    def shingles(rest, h, at, seen):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["shingle"])

    counts = some.mapInArrow(_per_text(words, shingles), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") >= 3).orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    name = found.column("shingle").to_numpy().view(np.uint64)
    at = np.argsort(name)
    return name[at], found.column("n").to_numpy()[at]


_NODE = "no_id boolean, id long, class long"
_MEMBER = f"lead long, low int, high int, {_NODE}, part long, point binary"
_GROUP = ["lead", "low", "high"]
#: ``high`` of a group in which all are compared with the lead alone.
STAR = -1


def near_components(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, text_hash, n_shingles, component_id.

    Two documents link when 100 * overlap >= ``percent`` * union of their shingle sets;
    component_id is the smallest id reachable by links, the row's own included.  Documents
    without words (null and empty texts) have no shingles and their own id.  Null ids are
    never the smallest unless there is no other; repeated ids and rows are kept.  Other
    columns are not read.
    """
    return _judged(docs, percent, words, id_col, text_col).drop("stays")


def _judged(docs: DataFrame, percent: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_components`` with ``stays``: whether the row is (a repeat of) its component's first document.

    A component is named by its first class, the one with the smallest id; ids alone name
    none, since all of them may be null and two unlinked texts may share one.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    order = Prefixes(percent, *_common(rows, words))

    def describe(rest, h, at, seen):
        """Every row's class; keys and point where the task sees the class for the first time."""
        name, sizes = set_hashes(h, at), np.diff(at)
        first = [i for i in _fresh(seen, name.tolist()) if sizes[i]]
        size = sizes[first] if first else np.zeros(0, np.int64)
        near = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        member = h[np.repeat(at[:-1][first] - near[:-1], size) + np.arange(near[-1])] if first else h[:0]
        key, who = order.keys(member, near)
        count = np.zeros(len(name), np.int64)
        count[first] = np.bincount(who, minlength=len(first))
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(key[np.argsort(who, kind="stable")].view(np.int64)))
        points: list = [None] * len(name)
        for i, p in zip(first, group_counts(member, near)):
            points[i] = _pack_point(p)
        columns = [rest.column(1), rest.column(2), pa.array(sizes), pa.array(name.view(np.int64)), pa.array(points, pa.binary()), keys]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "class", "point", "keys"])

    described = rows.mapInArrow(_per_text(words, describe), "doc_id long, text_hash long, n long, class long, point binary, keys array<long>")
    described = written(described, "sets")
    named = described.filter(F.col("n") > 0)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    classes = named.groupBy("class").agg(F.min("n").alias("n"), F.min(first).alias("first"), F.first("point", ignorenulls=True).alias("point"))
    classes = written(classes.select("class", "n", "first.no_id", "first.id", "first.text_hash", "point"), "classes")

    # blocks: all classes that share a key belong to the block of the key's most central class,
    # the one that shares most; so a large near group has few blocks
    keyed = named.select("class", F.explode("keys").alias("key"))
    known = keyed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"))
    known = known.filter(F.col("low") != F.col("high")).select("key", "n")
    shared = written(keyed.join(known, "key").select("key", "class", "n"), "shared")
    central = shared.groupBy("class").agg(F.sum("n").alias("score"))
    leads = shared.join(central, "class").groupBy("key").agg(F.max(F.struct("score", "class"))["class"].alias("lead"))
    edges = shared.join(leads, "key").filter(F.col("class") != F.col("lead")).select("lead", "class").distinct()
    edges = written(edges, "blocks")
    members = edges.unionByName(edges.select("lead", F.col("lead").alias("class")).distinct())
    sizes = written(members.groupBy("lead").agg(F.count("*").alias("members")), "block_sizes")
    sized = members.join(sizes, "lead")
    light = classes.select("class", "no_id", "id", "point")
    texts = _Texts(rows, classes, words)

    small = sized.filter(F.col("members") <= BLOCK).select("lead", F.lit(0).alias("low"), F.lit(0).alias("high"), "class", F.lit(-1).cast("long").alias("part"))
    stars, cut = _large_blocks(sized.filter(F.col("members") > BLOCK), light, texts, percent)
    dealt = small if cut is None else small.unionByName(cut)
    left = _bounded(dealt.join(light, "class"), percent)
    links_ = _verified(left, texts, percent)
    roots = components(links_ if stars is None else links_.unionByName(stars))

    own = F.struct("no_id", "id", "class")
    found = roots.select(F.col("node.class").alias("class"), "root")
    joined = classes.join(found, "class", "left").select("class", F.coalesce("root", own).alias("root"), F.col("text_hash").alias("first_hash"))
    joined = written(joined, "components")  # the join below can then split a large class
    out = described.select("doc_id", "text_hash", "n", "class").join(joined, "class", "left")
    same_id = F.col("root.no_id") & F.col("doc_id").isNull() | ~F.col("root.no_id") & F.col("doc_id").eqNullSafe(F.col("root.id"))
    stays = (F.col("class") == F.col("root.class")) & same_id & (F.col("text_hash") == F.col("first_hash"))
    smallest = F.when(~F.col("root.no_id"), F.col("root.id"))
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce(smallest, "doc_id").alias("component_id"), F.coalesce(stays, F.lit(True)).alias("stays")
    )


class _Texts:
    """Sets of chosen classes, from one text of each."""

    def __init__(self, rows: DataFrame, classes: DataFrame, words: int):
        self.rows, self.classes, self.words = rows, classes, words

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(class, members) for each ``class`` of ``wanted``, and for a few others."""
        heads = self.classes.select("class", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text_hash")
        heads = written(wanted.select("class").distinct().join(heads, "class").select(_row_hash().alias("row")), "wanted")
        sieve, words = Sieve.build(heads, "row", heads.count()), self.words

        def members_of(batches):
            seen: set[int] = set()
            for batch in batches:
                batch = batch.filter(pa.array(sieve.has(batch.column(1).to_numpy(zero_copy_only=False))))
                buf, offsets = text_bytes(batch.column(0))
                for low, high in slices(offsets):
                    part = offsets[low : high + 1]
                    h, at = shingle_sets(buf[part[0] : part[-1]], part - part[0], words)
                    name = set_hashes(h, at)
                    out = _fresh(seen, name.tolist())
                    blobs = [_pack(h[at[i] : at[i + 1]]) for i in out]
                    yield pa.RecordBatch.from_arrays([pa.array(name[out].view(np.int64)), pa.array(blobs, pa.binary())], names=["class", "members"])

        return self.rows.select("text", _row_hash().alias("row")).mapInArrow(members_of, "class long, members binary")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _bounded(dealt: DataFrame, percent: int) -> DataFrame:
    """Rows of ``dealt`` that have a pair in their group which the tree leaves."""
    names = [c.split()[0] for c in _MEMBER.split(", ")]

    def bound(batches):
        for t in _groups(batches, 3):
            if t.num_rows < 2:
                continue
            p, part = _points(t.column("point").combine_chunks()), t.column("part").to_numpy().copy()
            tree = CountTree(p, p.sum(axis=1), percent)
            keep = np.zeros(t.num_rows, bool)
            lead = np.flatnonzero(t.column("class").to_numpy() == t.column("lead").to_numpy())
            if len(lead) and (part < 0).all():
                # what may link to the lead stays anyway
                keep |= tree.near(int(lead[0]))
                if keep.sum() < 2:
                    keep[:] = False
                part[keep] = 0
            if t.column("high")[0].as_py() != STAR:
                for side in tree.pairs(part):
                    keep[side] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    return written(_dealt(dealt.select(*names)).mapInArrow(bound, _MEMBER), "left")


def _verified(left: DataFrame, texts: _Texts, percent: int) -> DataFrame:
    """Links (a, b) of nodes (no_id, id, class) in the groups of ``left``, by their sets."""
    ready = left.join(texts.sets(left).dropDuplicates(["class"]), "class")
    ready = _dealt(ready.select(*[c.split()[0] for c in _MEMBER.split(", ")], "members"))

    def verify(batches):
        for t in _groups(batches, 3):
            sets = [_unpack(b.as_buffer()) for b in t.column("members").combine_chunks()]
            p, part = _points(t.column("point").combine_chunks()), t.column("part").to_numpy()
            lead = np.flatnonzero(t.column("class").to_numpy() == t.column("lead").to_numpy())
            if t.column("high")[0].as_py() == STAR:
                pairs = star(sets, int(lead[0]), percent) if len(lead) else []
            else:
                pairs = links(sets, p, percent, int(lead[0]) if len(lead) else 0, None if (part < 0).all() else part)
            if pairs:
                nodes = t.select(["no_id", "id", "class"])
                ends = [nodes.take(pa.array(end)).combine_chunks().columns for end in zip(*pairs)]
                columns = [c.combine_chunks() for end in ends for c in end]
                yield pa.RecordBatch.from_arrays(columns, names=[f"{end}_{n}" for end in "ab" for n in nodes.column_names])

    schema = ", ".join(f"{end}_{c}" for end in "ab" for c in _NODE.split(", "))
    found = ready.mapInArrow(verify, schema)
    node = lambda end: F.struct(*[F.col(f"{end}_{c.split()[0]}").alias(c.split()[0]) for c in _NODE.split(", ")])
    return found.select(node("a").alias("a"), node("b").alias("b"))


def _large_blocks(sized: DataFrame, light: DataFrame, texts: _Texts, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Star links of blocks beyond ``BLOCK`` classes, and their members dealt for what is left to compare.

    Members of such a block (lead, class, members) are dealt into slots, each with a copy
    of the lead, and compared with it.  What is linked to the lead is the block's core.
    Within the core nothing is left to compare: a core slot meets each slot of the others
    once, these meet each other, and a block that is all core is done.
    """
    sized = written(sized, "large")
    if sized.isEmpty():
        return None, None
    slots = F.ceil(F.col("members") / BLOCK).cast("int")
    slot = F.pmod(F.xxhash64("class"), slots).cast("int")
    others = sized.filter(F.col("class") != F.col("lead")).select("lead", slot.alias("low"), "class")
    leads = sized.filter(F.col("class") == F.col("lead")).select("lead", F.explode(F.sequence(F.lit(0), slots - 1)).alias("low"), "class")
    rows = others.unionByName(leads).withColumns({"high": F.lit(STAR), "part": F.lit(-1).cast("long")})
    stars = written(_verified(_bounded(rows.join(light, "class"), percent), texts, percent), "stars")
    near = stars.select(F.col("a.class").alias("x"), F.col("b.class").alias("y"))
    linked = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"))).select(F.col("x").alias("class"), F.col("y").alias("lead")).distinct()
    core = linked.withColumn("core", F.lit(True))
    told = sized.join(core, ["lead", "class"], "left").withColumn("core", F.coalesce("core", F.col("class") == F.col("lead")))
    told = written(told, "told")
    counts = told.groupBy("lead").agg(F.sum(F.col("core").cast("int")).alias("inner"), F.sum((~F.col("core")).cast("int")).alias("outer"))
    counts = counts.filter(F.col("outer") > 0).select(
        "lead", F.ceil(F.col("inner") / BLOCK).cast("int").alias("s"), F.ceil(F.col("outer") / BLOCK).cast("int").alias("t")
    )
    rows = told.join(counts, "lead")
    inner = F.pmod(F.xxhash64("class"), F.col("s")).cast("int")
    outer = F.col("s") + F.pmod(F.xxhash64("class"), F.col("t")).cast("int")
    rows = rows.withColumn("slot", F.when(F.col("core"), inner).otherwise(outer))
    start = F.when(F.col("core"), F.col("s")).otherwise(F.lit(0))
    rows = rows.withColumn("other", F.explode(F.sequence(start, F.col("s") + F.col("t") - 1)))
    cut = rows.select(
        "lead", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "class",
        F.when(F.col("core"), 0).otherwise(-1).cast("long").alias("part"),
    )
    return stars, cut


def _row_hash():
    return F.xxhash64("doc_id", "text_hash")


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component.

    One with the smallest id stays (null only if there is no other; ties by class and text
    hash); documents without words all stay; columns stay the same.  Texts of rows that go
    are not shuffled, and of those that stay only the few that a filter can't tell.
    """
    found = _judged(docs, percent, words).filter(F.col("n_shingles") > 0)
    judged = found.groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows"))
    judged = written(judged.withColumn("name", _row_hash()), "judged")
    gone = judged.filter(~F.col("stays"))
    name, text_hash = (unused(n, docs) for n in ("name", "text_hash"))
    hashed = F.xxhash64(F.col("text").cast("string"))
    rows = docs.withColumn(text_hash, hashed).withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), text_hash))
    heads = judged.select("doc_id", "text_hash", "name")
    same = lambda a, b: F.col(a).cast("long").eqNullSafe(F.col("gone_id")) & (F.col(b) == F.col("gone_hash"))
    keys = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.col("name").alias("gone_name"))
    kept = without(rows, name, same("doc_id", text_hash), heads, "name", same("doc_id", "text_hash"), keys, "gone_name")
    twice = written(judged.filter(F.col("stays") & (F.col("rows") > 1)).select("name"), "twice")
    if not twice.isEmpty():
        # repeats of a row that stays: one of them
        sieve = Sieve.build(twice, "name", twice.count())
        again = sieve.split(kept, name, maybe=True).join(twice.select(F.col("name").alias("again")), F.col(name) == F.col("again"), "left")
        once = again.filter(F.col("again").isNull()).unionByName(again.filter(F.col("again").isNotNull()).dropDuplicates(["doc_id", text_hash]))
        kept = sieve.split(kept, name, maybe=False).unionByName(once.drop("again"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
