"""Sequences: paths over arrays, indexes, grouping by key, last-wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item(values: Column, index: int) -> Column:
    """The element at a 0-based index, nothing beyond the end."""
    return F.get(values, F.lit(index))


def each(values: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` once for each present value; results that are missing drop out."""
    return F.filter(F.transform(F.filter(values, lambda v: v.isNotNull()), body), lambda v: v.isNotNull())


def indexed(values: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` with each value and its 0-based place."""
    return F.transform(values, body)


def walk(values: Column, *path: str) -> Column:
    """A field path over an array of structs; ``name*`` is a field that repeats, whose arrays are flattened."""
    for name in path:
        values = F.transform(F.filter(values, lambda v: v.isNotNull()), _member(name.removesuffix("*")))
        if name.endswith("*"):
            values = F.flatten(F.filter(values, lambda v: v.isNotNull()))
    return F.filter(values, lambda v: v.isNotNull())


def _member(name: str) -> Callable[[Column], Column]:
    return lambda v: v[name]


def _runs(values: Column, key: Callable[[Column, Column], Column], build: Callable[[Column, Column, Column], Column]) -> Column:
    """``build(values, sorted, at)`` with places sorted by key, and where each key begins among them.

    Sorting brings equal keys together, so no key is looked for among all others.  Arrays
    of one bind a value once.
    """
    places = F.transform(values, lambda v, i: F.struct(key(v, i).alias("key"), i.alias("i")))
    places = F.array_sort(F.filter(places, lambda p: p["key"].isNotNull()))

    def begin(p: Column) -> Column:
        first = F.transform(p, lambda x, i: F.when((i == 0) | (x["key"] != F.get(p, i - 1)["key"]), i))
        return F.transform(F.array(F.filter(first, lambda i: i.isNotNull())), lambda at: build(values, p, at))[0]

    return F.when(values.isNotNull(), F.transform(F.array(places), begin)[0])


def keyed(values: Column, key: Callable[[Column, Column], Column]) -> Column:
    """A map of each value by a key; a repeated key keeps its last value (``grouped`` keeps all), none drops out."""

    def build(values: Column, p: Column, at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(p)) - 1
        return F.map_from_entries(
            F.transform(at, lambda a, k: F.struct(F.get(p, a)["key"].alias("key"), F.get(values, F.get(p, end(k))["i"]).alias("value")))
        )

    return _runs(values, key, build)


def grouped(values: Column, key: Callable[[Column, Column], Column]) -> Column:
    """A map of all values by a key, in their order; values without a key drop out."""

    def build(values: Column, p: Column, at: Column) -> Column:
        many = lambda a, k: F.slice(p, a + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - a)
        return F.map_from_entries(
            F.transform(
                at,
                lambda a, k: F.struct(F.get(p, a)["key"].alias("key"), F.transform(many(a, k), lambda x: F.get(values, x["i"])).alias("value")),
            )
        )

    return _runs(values, key, build)


def last(values: Column) -> Column:
    """The last present value: what a single-valued element keeps."""
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


def appended(*parts: Column) -> Column:
    """Arrays one after the other; a missing one adds nothing, and nothing at all is null."""
    whole = F.concat(*[F.coalesce(p, F.array()) for p in parts])
    return F.when(F.size(whole) > 0, whole)


def listed(value: Column) -> Column:
    """A present value as an array of one."""
    return F.when(value.isNotNull(), F.array(value))


def counted_by(rows: DataFrame, key: str, output: str) -> DataFrame:
    """``rows`` with the number of rows that share a row's key; a missing key is a key.

    Counts are aggregated before they are joined, so a key that many rows share is not
    gathered in one task.
    """
    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias(output))
    return rows.join(counts, rows[key].eqNullSafe(counts["__key"])).drop("__key")
