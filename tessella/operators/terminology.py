"""Code translation, value-set checks and display injection as joins and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes up to which a map or set becomes a literal in the plan; larger ones are joined.
LITERAL_CODES = 200


def concept_map_rows(maps: DataFrame) -> DataFrame:
    """(map_id, source, code, target, target_code, equivalence) of ConceptMap resources."""
    groups = maps.select(F.col("id").alias("map_id"), F.explode("group").alias("g"))
    elements = groups.select("map_id", F.col("g.source").alias("source"), F.col("g.target").alias("target"), F.explode("g.element").alias("e"))
    return elements.select(
        "map_id", "source", F.col("e.code").alias("code"), "target", F.explode("e.target").alias("t")
    ).select("map_id", "source", "code", "target", F.col("t.code").alias("target_code"), F.col("t.equivalence").alias("equivalence"))


def translate(rows: DataFrame, code: str, concept_map: DataFrame, output: str) -> DataFrame:
    """``rows`` with the target of ``code``; an unmapped code gives null.

    ``concept_map`` has (code, target_code); of several targets the smallest is taken.  It
    is a plain left join: Spark broadcasts it if its size allows and shuffles otherwise.
    """
    m = concept_map.groupBy(F.col("code").alias("__code")).agg(F.min("target_code").alias(output))
    return rows.join(m, rows[code] == m["__code"], "left").drop("__code")


def translate_literal(code: Column, mapping: dict[str, str]) -> Column:
    """The same with a small map folded into the expression."""
    if len(mapping) > LITERAL_CODES:
        raise ValueError("join a map of this size with translate()")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), code)


def in_value_set(code: Column, codes: list[str]) -> Column:
    """Whether a present code is in a required set; a missing code isn't judged."""
    return F.when(code.isNotNull(), code.isin(codes))


def with_membership(rows: DataFrame, system: str | None, code: str, value_set: DataFrame, output: str) -> DataFrame:
    """``rows`` with ``output``: whether the code is in a value set (system, code) of any size; null for a missing code.

    A plain left join with the set's distinct members, which Spark plans by their size;
    without ``system`` the code alone decides.
    """
    names = (["system"] if system else []) + ["code"]
    members = value_set.select(*[F.col(n).alias(f"__{n}") for n in names]).dropna().distinct().withColumn("__in", F.lit(True))
    on = rows[code] == members["__code"]
    if system:
        on = on & (rows[system] == members["__system"])
    joined = rows.join(members, on, "left")
    return joined.withColumn(output, F.when(F.col(code).isNotNull(), F.coalesce("__in", F.lit(False)))).drop("__in", *[f"__{n}" for n in names])


def any_coding_in(codings: Column, allowed: list[tuple[str, str]]) -> Column:
    """Whether at least one coding of a concept is allowed."""
    pairs = [F.struct(F.lit(s).alias("system"), F.lit(c).alias("code")) for s, c in allowed]
    return F.exists(codings, lambda c: F.array_contains(F.array(*pairs), F.struct(c["system"].alias("system"), c["code"].alias("code"))))


def with_display(rows: DataFrame, system: str, code: str, display: str, code_system: DataFrame) -> DataFrame:
    """``display`` filled from (system, code, display) where it is missing and the code is known.

    Of several displays the smallest is taken.  A quantity's unit is filled the same way.
    """
    known = code_system.groupBy(F.col("system").alias("__s"), F.col("code").alias("__c")).agg(F.min("display").alias("__d"))
    joined = rows.join(known, (rows[system] == known["__s"]) & (rows[code] == known["__c"]), "left")
    return joined.withColumn(display, F.coalesce(F.col(display), F.col("__d"))).drop("__s", "__c", "__d")


def lookup_reference(rows: DataFrame, key: str, resources: DataFrame, resource_key: str, kind: str, output: str) -> DataFrame:
    """``Type/id`` of the resource that has the key; null where there is none."""
    found = resources.select(F.col(resource_key).alias("__k"), F.concat(F.lit(kind + "/"), F.col("id").cast("string")).alias(output))
    found = found.groupBy("__k").agg(F.min(output).alias(output))
    return rows.join(found, rows[key] == found["__k"], "left").drop("__k")
