"""The engine: mappings over DataFrames of documents, with bindings and thresholds.

A mapping is a Python function from (row columns, bindings) to a Column; it runs once, on
the driver, and what it returns is part of the query's plan.
"""

from __future__ import annotations

import time
from collections import ChainMap
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import Config
from tessella.operators import diagnostics as diag
from tessella.operators import profiles
from tessella.operators.resource import Resource
from tessella.operators.rules import rule_mapping
from tessella.sources import registry

Mapping = Callable[..., "Column | Resource"]
Checks = Callable[[DataFrame], list[Column]]


class MappingNotFound(KeyError):
    pass


class NoMappingSource(RuntimeError):
    pass


class Engine:
    def __init__(self, config: Config | None = None, bindings: dict | None = None):
        self.config = config or Config()
        self.bindings: dict = dict(bindings or {})
        self.aliases: dict[str, str] = {}
        self.static: dict = {}
        self.mappings: dict[str, Mapping] = {}
        self.started = time.time()

    def register(self, name: str, value) -> None:
        """Add or replace a named value, Column function or UDF."""
        self.bindings[name] = value

    def register_mapping(self, name: str, mapping: Mapping) -> None:
        """A saved mapping; other mappings may call it by name."""
        if not callable(mapping):
            raise TypeError(f"Mapping '{name}' does not contain a valid expression")
        self.mappings[name] = mapping

    def load_mappings(self, texts: DataFrame, definitions: dict | None = None) -> list[str]:
        """Register the saved mappings of a source (key, source, expression); of one key the last source's stays.

        Rows of ``registry.structure_maps`` and ``registry.folder``; there is one for each
        mapping, and they come to the driver.
        """
        known = profiles.PROFILES if definitions is None else definitions
        rows = texts.orderBy("source", "key").collect()
        for r in rows:
            self.register_mapping(r.key, rule_mapping(r.expression, known))
        return sorted({r.key for r in rows})

    def bound(self, **call) -> ChainMap:
        """Bindings of one call: the call's, the engine's, static values, aliases, mappings."""
        return ChainMap(call, self.bindings, self.static, self.aliases, self.mappings)

    def _mapping(self, mapping: Mapping | str) -> Mapping:
        if callable(mapping):
            return mapping
        if not self.mappings and self.config.stateless:
            raise NoMappingSource("no source of saved mappings is set")
        if mapping not in self.mappings:
            raise MappingNotFound(f"Mapping '{mapping}' not found")
        return self.mappings[mapping]

    def transform(self, docs: DataFrame, mapping: Mapping | str, output: str = "result", **call) -> DataFrame:
        """``docs`` with the mapping's result in ``output``; a ``Resource`` gives its column."""
        result = self._mapping(mapping)(docs, self.bound(**call))
        return docs.withColumn(output, result.column() if isinstance(result, Resource) else result)

    def transform_checked(self, docs: DataFrame, mapping: Mapping | str, checks: Checks | None = None, output: str = "report", **call) -> DataFrame:
        """``transform_verbose`` that keeps the diagnostics to be thrown alone (``collect`` is ``throw``)."""
        throw = call.get("throw", self.config.thresholds.throw)
        return self.transform_verbose(docs, mapping, checks, output, **(call | {"collect": throw}))

    def transform_verbose(
        self, docs: DataFrame, mapping: Mapping | str, checks: Checks | None = None, output: str = "report", **call
    ) -> DataFrame:
        """``docs`` with a report for each row instead of a result.

        A mapping that gives a ``Resource`` is checked for its mandatory elements.  Checks
        at or above the validation threshold aren't built at all; ``throw``, ``log``,
        ``collect`` and ``validation`` among the call's bindings hold for this call.
        """
        levels = {k: call.pop(k) for k in ("throw", "log", "collect", "validation") if k in call}
        limits = self.config.thresholds.override(**levels)
        result = self._mapping(mapping)(docs, self.bound(**call))
        found = checks(docs) if checks else []
        if isinstance(result, Resource):
            found, result = [*result.checks(), *found], result.column()
        found = found if limits.validation > diag.SEVERITY["invalid"] else []
        gathered = diag.gathered(*found) if found else F.array().cast(f"array<{diag.DIAGNOSTIC}>")
        return docs.withColumn(output, diag.report(result, gathered, limits))

    def info(self) -> dict:
        return {
            "status": "UP",
            "uptime": time.time() - self.started,
            "fhir_version": self.config.fhir_version,
            "packages": registry.packages(self.config.fhir_packages, self.config.fhir_version),
        }

    def reload(self, concept_maps: DataFrame | None = None, alias_map: str = "Aliases", static: dict | None = None) -> None:
        """Take aliases and static values anew."""
        if concept_maps is not None:
            self.aliases = registry.aliases(concept_maps, alias_map)
        if static is not None:
            self.static = dict(static)
