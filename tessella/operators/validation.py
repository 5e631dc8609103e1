"""Automatic conformance: coercions, and checks that give diagnostics rather than errors.

Codes and message texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.operators.diagnostics import diagnostic


def to_date(value: Column) -> Column:
    """A date from a date or dateTime, partial precision kept, as text."""
    return F.substring(value.cast("string"), 1, 10)


def to_decimal(value: Column) -> Column:
    """The number that a text writes out, as a double; null where it isn't one."""
    number = "^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"
    return F.when(value.cast("string").rlike(number), value.cast("string").try_cast("double"))


def single(values: Column) -> Column:
    """The one value of an array for a scalar element: the last."""
    return F.try_element_at(values, F.lit(-1))


def required_code(code: Column, codes: list[str] | None, path: str, profile: str, ok: Column | None = None) -> Column:
    """A diagnostic where a present code is outside its required set, else null.

    The set is a short list, or ``ok`` says whether the code is in it
    (``terminology.with_membership`` joins sets of any size).
    """
    ok = code.isin(codes) if ok is None else F.coalesce(ok, F.lit(False))
    message = F.concat(F.lit('Value "'), code, F.lit(f'" for "{path}" in "{profile}" is not in the required ValueSet.'))
    return F.when(code.isNotNull() & ~ok, diagnostic("F5120", message, 12, path=path))


def required_concept(codings: Column, ok: Column, path: str, profile: str) -> Column:
    """A diagnostic where none of a concept's codings is allowed, with their number."""
    n = F.size(codings).cast("string")
    message = F.concat(
        F.lit("CodeableConcept.coding does not contain a Coding from the required ValueSet ("), n, F.lit(f' provided) for "{path}" in "{profile}".')
    )
    return F.when(codings.isNotNull() & (F.size(codings) > 0) & ~ok, diagnostic("F5123", message, 12, path=path))


def required_unit(system: Column, code: Column, allowed: list[tuple[str, str]] | None, path: str, profile: str, ok: Column | None = None) -> Column:
    """The same for a quantity's unit."""
    if ok is None:
        pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s, c in allowed])
        ok = F.array_contains(pairs, F.struct(system.alias("s"), code.alias("c")))
    message = F.concat(
        F.lit('Quantity unit code (system="'), F.coalesce(system, F.lit("")), F.lit('", code="'), code, F.lit(f'") for "{path}" in "{profile}" is not in the required ValueSet.')
    )
    return F.when(code.isNotNull() & ~F.coalesce(ok, F.lit(False)), diagnostic("UNIT", message, 12, path=path))


def mandatory(value: Column, path: str, profile: str, minimum: int = 1, many: bool = False) -> Column:
    """A diagnostic where a mandatory element has too few values; ``many`` says that ``value`` is an array."""
    n = F.coalesce(F.size(F.filter(value, lambda v: v.isNotNull())) if many else value.isNotNull().cast("int"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    given = F.when(n == 0, "no value was").otherwise(F.concat(n.cast("string"), F.when(n == 1, " value was").otherwise(" values were")))
    message = F.concat(F.lit(f'The FHIR element "{path}" is mandatory in "{profile}" (minimum {minimum}), but '), given, F.lit(" provided."))
    return F.when(n < minimum, diagnostic("MIN", message, 12, path=path))


def injected_system(system: Column, only_system: str) -> Column:
    return F.coalesce(system, F.lit(only_system))


def injected_unit(unit: Column, system: Column, code: Column, known: dict[tuple[str, str], str]) -> Column:
    """A quantity's unit name, from a short list by (system, code) where it is missing.

    ``terminology.with_display`` fills it from a code system of any size.
    """
    pairs = [F.lit(x) for (s, c), name in known.items() for x in (f"{s}|{c}", name)]
    return F.coalesce(unit, F.try_element_at(F.create_map(*pairs), F.concat_ws("|", system, code)))
