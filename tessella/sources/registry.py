"""Sources of mappings, aliases and static values, read with Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def structure_maps(spark: SparkSession, path: str) -> DataFrame:
    """(key, source, expression) of StructureMap resources in JSON files."""
    maps = spark.read.option("multiLine", True).json(path).filter(F.col("resourceType") == "StructureMap")
    rules = maps.select(F.col("id").alias("key"), F.explode("group").alias("g")).select("key", F.explode("g.rule").alias("r"))
    found = rules.select("key", F.explode("r.extension").alias("e")).select("key", F.col("e.valueExpression.expression").alias("expression"))
    return found.filter(F.col("expression").isNotNull()).select("key", F.lit("server").alias("source"), "expression")


def folder(spark: SparkSession, path: str | None, extension: str = ".map") -> DataFrame:
    """(key, source, expression) of a folder's files; ``n/a`` and blank switch it off."""
    schema = "key string, source string, expression string"
    if not path or not path.strip() or path.strip().lower() == "n/a":
        return spark.createDataFrame([], schema)
    files = spark.read.text(f"{path.rstrip('/')}/*{extension}", wholetext=True)
    name = F.regexp_extract(F.input_file_name(), "([^/]+)" + re.escape(extension) + "$", 1)
    return files.select(F.url_decode(name).alias("key"), F.lit("file").alias("source"), F.col("value").alias("expression"))


def aliases(concept_maps: DataFrame, name: str) -> dict[str, str]:
    """Names to values of the alias ConceptMap; a handful of constants, folded into plans."""
    one = concept_maps.filter(F.col("name") == name).select(F.explode("group").alias("g")).select(F.explode("g.element").alias("e"))
    return {r.code: r.value for r in one.select("e.code", F.get("e.target", F.lit(0))["code"].alias("value")).collect()}


def static_values(spark: SparkSession, path: str) -> dict[str, object]:
    """JSON values by file name, for literals."""
    import json

    files = spark.read.text(f"{path.rstrip('/')}/*.json", wholetext=True).select(F.input_file_name().alias("f"), "value").collect()
    return {re.search(r"([^/]+)\.json$", r.f)[1]: json.loads(r.value) for r in files}


def packages(listed: str, version: str = "4.0.1") -> list[str]:
    """Package ids of a comma list, blanks dropped, the base package of the version first."""
    base = f"hl7.fhir.r{version[0]}.core@{version}"
    return [base, *[p.strip() for p in listed.split(",") if p.strip() and p.strip() != base]]
