"""Diagnostics, severity thresholds and the verbose report, per row."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed severity scale: a level's number, lower is worse.
SEVERITY = {"fatal": 0, "invalid": 10, "error": 20, "warning": 30, "notice": 40, "info": 50, "debug": 60}
DIAGNOSTIC = (
    "struct<code:string,position:int,start:int,line:int,instanceOf:string,fhirElement:string,"
    "bindingStrength:string,expansionMode:string,value:string,message:string,severity:int,level:string,timestamp:bigint>"
)


@dataclass(frozen=True)
class Thresholds:
    """An action is taken for severities strictly below its threshold."""

    throw: int = 30
    log: int = 40
    collect: int = 70
    validation: int = 30

    def override(self, **levels: int) -> "Thresholds":
        """Thresholds for one call; the engine's own stay as they are."""
        return replace(self, **levels)


def level_of(severity: Column) -> Column:
    """The name of the scale's step that a severity falls on."""
    out = F.when(severity.isNull(), F.lit(None).cast("string"))
    for name, low in sorted(SEVERITY.items(), key=lambda x: -x[1]):
        out = out.when(severity >= low, name)
    return out


def diagnostic(code: str, message: Column, severity: int, path: str | None = None, instance_of: str | None = None) -> Column:
    s = F.lit(severity)
    values = {
        "code": F.lit(code), "instanceOf": F.lit(instance_of), "fhirElement": F.lit(path), "message": message, "severity": s, "level": level_of(s),
    }
    fields = [f.split(":") for f in DIAGNOSTIC[len("struct<") : -1].split(",")]
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def warn(message: Column) -> Column:
    """What a mapping's own warning adds."""
    return diagnostic("F5320", message, 32)


def gathered(*checks: Column) -> Column:
    """All diagnostics that are present, as one array."""
    return F.filter(F.array(*checks), lambda d: d.isNotNull())


def report(result: Column, found: Column, thresholds: Thresholds = Thresholds()) -> Column:
    """{ok, status, result, diagnostics{error, warning, debug}} of a row.

    A diagnostic to be thrown makes the row not ok: 206 where there is a result, 422 where
    there is none.
    """
    kept = F.filter(found, lambda d: d["severity"] < thresholds.collect)
    thrown = F.exists(found, lambda d: d["severity"] < thresholds.throw)
    between = lambda low, high: F.filter(kept, lambda d: (d["severity"] >= low) & (d["severity"] < high))
    status = F.when(~thrown, 200).when(result.isNotNull(), 206).otherwise(422)
    parts = F.struct(between(0, 30).alias("error"), between(30, 40).alias("warning"), between(40, 1000).alias("debug"))
    return F.struct((~thrown).alias("ok"), status.alias("status"), result.alias("result"), parts.alias("diagnostics"))


def primary(rep: Column) -> Column:
    """The first error, else warning, else debug diagnostic."""
    d = rep["diagnostics"]
    return F.get(F.concat(d["error"], d["warning"], d["debug"]), F.lit(0))


def primary_code(rep: Column) -> Column:
    return F.coalesce(primary(rep)["code"], F.when(~rep["ok"], F.lit("EVALUATION_FAILED")))


def normalized(rep: Column, execution_id: Column | None = None) -> Column:
    """Defaults for a report's missing parts: status 500, empty lists, a random execution id."""
    none = F.array().cast(f"array<{DIAGNOSTIC}>")
    d = rep["diagnostics"]
    parts = F.struct(*[F.coalesce(d[k], none).alias(k) for k in ("error", "warning", "debug")])
    given = F.nullif(F.lit(None).cast("string") if execution_id is None else execution_id, F.lit(""))
    return F.struct(
        F.coalesce(rep["ok"], F.lit(False)).alias("ok"), F.coalesce(rep["status"], F.lit(500)).alias("status"), rep["result"].alias("result"), parts.alias("diagnostics"),
        F.coalesce(given, F.expr("uuid()")).alias("executionId"),
    )


def legacy_error(rep: Column, product: str = "Engine", language: str = "Mapping") -> Column:
    """The older error shape of a report's primary diagnostic, eleven keys; null for a report that is ok.

    Two of its keys hold the names of the product and of the mapping language.
    """
    first = primary(rep)
    code = F.coalesce(first["code"], F.lit("EVALUATION_FAILED"))
    text = {f"__is{product}Error": F.lit(True), f"__is{language}Error": is_mapping_error(code), "message": F.coalesce(first["message"], F.lit("Evaluation failed")), "code": code}
    rest = {"name": F.lit("EvaluationError"), "value": F.lit(""), "token": F.lit(""), "cause": F.lit("")}
    place = {k: F.coalesce(first[k].cast("string"), F.lit("")) for k in ("line", "start", "position")}
    return F.when(~F.coalesce(rep["ok"], F.lit(False)), F.struct(*[v.alias(k) for k, v in (text | rest | place).items()]))


def synthetic(code: str, message: str, status: int) -> Column:
    """A report of one error for a request that was never evaluated."""
    one = diagnostic(code, F.lit(message), 1)
    none = F.array().cast(f"array<{DIAGNOSTIC}>")
    parts = F.struct(F.array(one).alias("error"), none.alias("warning"), none.alias("debug"))
    return F.struct(F.lit(False).alias("ok"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("result"), parts.alias("diagnostics"))


def is_mapping_error(code: Column) -> Column:
    return F.coalesce(code.startswith("F"), F.lit(False))
