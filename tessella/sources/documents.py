"""Input converters: JSON, CSV and XML text columns to nested columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import hl7v2

#: Fixed content types, matched by prefix.
HL7_TYPES = ("x-application/hl7-v2+er7",)
CSV_TYPES = ("text/csv",)
XML_TYPES = ("application/xml", "application/fhir+xml")
JSON_TYPES = ("application/json", "application/fhir+json", "text/json")


def source_kind(content_type: str | None) -> str:
    """json, csv, xml or hl7 for a content type; none means json."""
    if not content_type:
        return "json"
    for kind, prefixes in (("hl7", HL7_TYPES), ("csv", CSV_TYPES), ("xml", XML_TYPES), ("json", JSON_TYPES)):
        if content_type.startswith(prefixes):
            return kind
    raise ValueError(f"Unsupported Content-Type: '{content_type}'")


def as_json(text: Column, content_type: Column) -> Column:
    """Documents of mixed content types as JSON text, by the row's type; none means JSON.

    CSV becomes an array of objects and HL7 v2 an object of segments.  XML needs a schema
    (``xml_document``) and, like a type that isn't known, gives null.
    """
    kind = F.coalesce(content_type, F.lit(""))
    of = lambda prefixes: reduce(Column.__or__, [kind.startswith(p) for p in prefixes])
    return (
        F.when(of(HL7_TYPES), hl7v2.to_json(text))
        .when(of(CSV_TYPES), F.to_json(csv_objects(text)))
        .when((kind == "") | of(JSON_TYPES), text)
    )


def json_document(text: Column) -> Column:
    """A document of unknown shape; text that isn't JSON gives null."""
    return F.try_parse_json(text)


def json_value(document: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(document, path, kind)


def csv_objects(text: Column) -> Column:
    """Rows of CSV text as maps: names trimmed, cells as text, cells of short rows left out.

    Cells may be quoted and then hold commas and line ends.
    """
    # every cell with the comma or line end before it: no match is empty, so no cell is passed over
    whole = F.concat(F.lit("\n"), text)
    found = lambda group: F.regexp_extract_all(whole, F.lit('(,|\r\n|\n|\r)("[^"]*+(?:""[^"]*+)*+"|[^,\r\n]*)'), F.lit(group))

    def plain(cell: Column) -> Column:
        return F.when(cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1), F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)

    def rows(cells: Column) -> Column:
        first = F.filter(F.transform(cells, lambda c, i: F.when(c["before"] != ",", i + 1)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(first), lambda at: F.filter(F.transform(at, lambda a, k: part(cells, at, a, k)), lambda r: ~blank(r))), F.lit(0))

    def part(cells: Column, at: Column, a: Column, k: Column) -> Column:
        return F.slice(cells, a, F.coalesce(F.get(at, k + 1), F.size(cells) + 1) - a)

    def blank(row: Column) -> Column:
        return (F.size(row) == 1) & (F.get(row, F.lit(0))["cell"] == "")

    def objects(lines: Column) -> Column:
        header = F.transform(F.get(lines, F.lit(0)), lambda c: F.trim(plain(c["cell"])))
        rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.get(F.transform(F.array(header), lambda names: F.transform(rest, lambda r: row(names, r))), F.lit(0))

    def row(names: Column, cells: Column) -> Column:
        pairs = F.arrays_zip(names.alias("name"), F.transform(cells, lambda c: plain(c["cell"])).alias("cell"))
        return F.map_from_entries(F.filter(pairs, lambda p: p["name"].isNotNull() & p["cell"].isNotNull()))

    # arrays of one bind a value once, where a lambda would compute it again for each row
    cells = F.arrays_zip(found(1).alias("before"), found(2).alias("cell"))
    lines = F.transform(F.array(cells), rows)
    return F.get(F.transform(lines, objects), F.lit(0))


def xml_document(text: Column, schema: str) -> Column:
    """XML text as a struct; the root element is unwrapped."""
    return F.from_xml(text, schema)


def xml_value(element: Column, nested: bool = False) -> Column:
    """An element's plain value, from its text or its ``value`` attribute."""
    return element["_value"] if nested else element


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file: header names trimmed, every cell as text."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return rows.toDF(*[c.strip() for c in rows.columns])


def read_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)
