"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Each source has a number of words to give.  Among all document rates that meet it, the
one closest to one copy each (in relative entropy) is tilted exponentially by the
document's size, ``rate = min(most, exp(lambda * size / mean size))``.  The convex dual
has one lambda for each source; distributed Newton steps find it over a table with a row
for each source and size.  Rates are then rounded into copies: sizes of a source are
walked from large to small, what one size owes goes on to the next, so that a source's
words meet its target to within about its smallest size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import unused, written

#: Documents of one source and size that are ranked together; larger groups are cut by hash.
RANKED = 1000


def word_count(text: Column) -> Column:
    """Words of a text, runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each distinct (doc_id, text, source): hash, size, and how many rows it has."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(text).alias("text_hash"),
        word_count(text).alias("size"),
    )
    return rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("rows"))


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sources`` (source, source_size) with target, shares of the total by weight.

    Sources in code-point order, null last, take ``weights`` in turn.  A target stops at
    ``most`` times its source's size and the rest is shared by weight again until none is
    above: sources are filled in the order in which they reach their limit.  One row for
    each source is ordered here.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * float(most)
    rows = sources.withColumn("weight", weight).withColumn("limit", limit)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rows = rows.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), zero),
            "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero),
        }
    ).withColumn("level", F.col("left") / F.col("weights"))
    full = F.col("level") * F.col("weight") >= F.col("limit")
    rows = rows.withColumn("full", full)
    first_open = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("limit") / F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * first_open)
    return rows.select("source", "source_size", target.alias("target"), "full")


def _rate(lam: Column, z: Column, most: float) -> Column:
    return F.exp(F.least(lam * z, F.lit(math.log(most))))


def tilts(cells: DataFrame, goals: DataFrame, most: float, tolerance: float = 1e-7, steps: int = 40) -> DataFrame:
    """``goals`` with the dual variable ``lam`` of each open source, by guarded Newton steps.

    ``cells`` has source, size and n.  A step sums words and their slope over all cells of
    a source; it falls back to halving where Newton leaves the bracket.  Sums are those of
    decimals, which don't depend on the order of their terms, so reruns agree to the bit.
    """
    exact = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    low = F.least(F.log(F.col("target") / F.col("source_size")), F.lit(0.0)) * F.col("mean") - 1e-9
    state = written(
        goals.filter(~F.col("full") & (F.col("target") > 0))
        .join(mean, goals["source"].eqNullSafe(mean["source"]))
        .select(goals["source"], "source_size", "target", "mean", F.lit(0.0).alias("lam"), low.alias("low"), (F.col("mean") * math.log(most)).alias("high")),
        "state",
        codec="none",
    )
    for _ in range(steps):
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("lam"), z, most)
        words = F.col("n") * F.col("size") * rate
        free = F.col("lam") * z < math.log(most)
        sums = (
            cells.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s", "source_size", "target", "mean", "lam", "low", "high")
            .agg(exact(words).alias("words"), exact(F.when(free, words * z).otherwise(0.0)).alias("slope"))
        )
        over = F.col("words") > F.col("target")
        high, low = F.when(over, F.col("lam")).otherwise(F.col("high")), F.when(over, F.col("low")).otherwise(F.col("lam"))
        newton = F.col("lam") - (F.col("words") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > low) & (newton < high)
        near = F.abs(F.col("words") - F.col("target")) <= tolerance * F.col("target")
        lam = F.when(near, F.col("lam")).when(inside, newton).otherwise((low + high) / 2)
        columns = [F.col("s").alias("source"), "source_size", "target", "mean", lam.alias("lam"), low.alias("low"), high.alias("high"), near.alias("near")]
        state = written(sums.select(*columns), "state", codec="none")  # a row for each source
        if state.filter(~F.col("near")).isEmpty():
            break
        state = state.drop("near")
    return state.select("source", "mean", "lam")


def _quotas(cells: DataFrame, stretch: int = 256) -> DataFrame:
    """``cells`` (source, size, n, rate) with ``copies`` for each: rates rounded, debts carried.

    A source's cells meet in one array, one element for each distinct size whatever the
    number of documents.  They are walked in stretches, since an array can't grow in
    place; so the work is linear.
    """

    def step(acc: Column, c: Column) -> Column:
        owed = acc["owed"] + c["n"] * c["rate"] * c["size"]
        least, top = c["n"] * F.floor(c["rate"]), c["n"] * F.ceil(c["rate"])
        q = F.least(top, F.greatest(least, F.round(owed / c["size"]).cast("long")))
        row = F.array(F.struct(c["size"].alias("size"), q.alias("copies")))
        return F.struct((owed - q * c["size"]).alias("owed"), F.concat(acc["out"], row).alias("out"))

    def walk(acc: Column, part: Column) -> Column:
        start = F.struct(acc["owed"].alias("owed"), F.array().cast(kind).alias("out"))
        walked = F.transform(F.array(part), lambda p: F.aggregate(p, start, step))[0]
        return F.transform(
            F.array(walked), lambda w: F.struct(w["owed"].alias("owed"), F.concat(acc["out"], F.array(w["out"])).alias("out"))
        )[0]

    kind = "array<struct<size:bigint,copies:bigint>>"
    none = F.struct(F.lit(0.0).alias("owed"), F.array().cast(f"array<{kind}>").alias("out"))
    listed = F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False)
    rows = cells.filter(F.col("size") > 0).groupBy("source").agg(listed.alias("cells"))
    parts = F.transform(F.sequence(F.lit(1), F.size("cells"), F.lit(stretch)), lambda a: F.slice("cells", a, F.lit(stretch)))
    rows = rows.select("source", parts.alias("parts"))
    return rows.select("source", F.explode(F.flatten(F.aggregate("parts", none, walk)["out"])).alias("c")).select("source", "c.*")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, text_col: str = "text") -> DataFrame:
    """Copies of each document: doc_id, source, text_hash, rows, size, source_size, target, copies, more.

    There is a row for each distinct (doc_id, text, source); ``rows`` says how often the
    input has it, ``copies`` how often the mix takes each of those rows (0 to ``most``),
    and ``more`` how many of them it takes once more.
    Null sources make one source, the last; null and empty texts have size 0 and are kept
    once; null ids are an id like any other.  Which rows of one size take a copy more
    is settled by a hash of the row, so reruns agree.
    """
    units = written(sized(docs, text_col), "units")
    cells = written(units.groupBy("source", "size").agg(F.sum("rows").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = written(targets(sources, weights, most), "goals")
    tilt = tilts(cells, goals, most)
    rated = (
        cells.withColumnRenamed("source", "s")
        .join(goals, F.col("s").eqNullSafe(F.col("source")))
        .drop("source")
        .join(tilt, F.col("s").eqNullSafe(F.col("source")), "left")
        .drop("source")
        .withColumnRenamed("s", "source")
    )
    rate = F.coalesce(_rate(F.col("lam"), F.col("size") / F.col("mean"), most), F.when(F.col("full"), float(most)).otherwise(0.0))
    rated = rated.select("source", "source_size", "target", "size", "n", rate.alias("rate"))
    quota = _quotas(rated)
    plan = (
        rated.withColumnRenamed("source", "s")
        .withColumnRenamed("size", "z")
        .join(quota, F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")), "left")
        .select("s", "z", "n", "source_size", "target", F.coalesce("copies", "n").alias("quota"))
    )
    plan = written(plan, "quotas")
    joined = units.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    turn = F.xxhash64("doc_id", "text_hash")
    joined = joined.withColumn("turn", turn).withColumn("slot", F.pmod(turn, F.ceil(F.col("n") / RANKED)))
    # extra copies of a group that was cut by hash: each slot's share of them, by its rows
    cut = joined.filter(F.col("n") > RANKED).groupBy("source", "size", "slot").agg(F.sum("rows").alias("in_slot"))
    ahead = F.sum("in_slot").over(Window.partitionBy("source", "size").orderBy("slot")) - F.col("in_slot")
    cut = cut.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("slot").alias("k"), ahead.alias("ahead"))
    joined = joined.join(
        cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("slot") == F.col("k")), "left"
    ).drop("s", "z", "k")
    within = F.sum("rows").over(Window.partitionBy("source", "size", "slot").orderBy("turn", "doc_id", "text_hash")) - F.col("rows")
    place = F.coalesce("ahead", F.lit(0)) + within
    extra = F.expr("quota - n * (quota div n)")
    more = F.least(F.col("rows"), F.greatest(F.lit(0), extra - F.col("place")))
    every = (F.col("more") == F.col("rows")).cast("int")
    joined = joined.withColumn("place", place).withColumn("more", more)
    return joined.select(
        "doc_id", "source", "text_hash", "rows", "size", "source_size", "target",
        (F.expr("quota div n") + every).cast("int").alias("copies"), (F.col("more") * (1 - every)).alias("more"),
    )


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, taken (words)."""
    rows = mix(docs, **options).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    rows = rows.withColumn("copies", F.col("copies") + (F.col("row") <= F.col("more")).cast("int"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; columns stay the same."""
    chosen = mix(docs, **options).filter((F.col("copies") > 0) | (F.col("more") > 0))
    id_, source, hash_, copies, more, row, turn = (unused(n, docs) for n in ("id", "source", "hash", "copies", "more", "row", "turn"))
    renamed = {"doc_id": id_, "source": source, "text_hash": hash_, "copies": copies, "more": more}
    chosen = chosen.select(*[F.col(a).alias(b) for a, b in renamed.items()])
    chosen = written(chosen, "chosen")
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def found(part: DataFrame) -> DataFrame:
        return docs.join(
            part,
            F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
            & F.col("source").cast("string").eqNullSafe(F.col(source))
            & (F.xxhash64(F.col("text").cast("string")) == F.col(hash_)),
        )

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(copies) > 0).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns)

    out = repeated(found(chosen.filter(F.col(more) == 0)))
    # at most one document of each source and size has rows that differ in copies: they are numbered
    uneven = written(chosen.filter(F.col(more) > 0), "uneven")
    if uneven.isEmpty():
        return out
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy(id_, source, hash_).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    numbered = found(uneven).withColumn(turn, F.row_number().over(order))
    return out.unionByName(repeated(numbered.withColumn(copies, F.col(copies) + (F.col(turn) <= F.col(more)).cast("int"))))
