"""Request metadata as columns: redacted headers, sub-routes, the verbose flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed header rules: names that are secret, and parts of a name that make it so.
SECRET_NAMES = ("authorization", "proxy-authorization", "cookie", "set-cookie")
SECRET_PARTS = ("token", "secret", "password", "session", "api-key", "apikey")
REDACTED = "[REDACTED]"


def is_secret_header(name: Column) -> Column:
    low = F.lower(name)
    return reduce(Column.__or__, [low.contains(p) for p in SECRET_PARTS], low.isin(*SECRET_NAMES))


def redacted(headers: Column) -> Column:
    """A header map with the values of secret headers replaced."""
    return F.transform_values(headers, lambda k, v: F.when(is_secret_header(k), REDACTED).otherwise(v))


def subroute(path: Column, mapping_id: Column) -> Column:
    """Segments of a request path after ``/id``."""
    prefix = F.concat(F.lit("/"), mapping_id)
    rest = F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise("")
    return F.filter(F.split(rest, "/", -1), lambda s: s != "")


def wants_report(values: Column) -> Column:
    """Whether any of a repeated flag's values is 1 or true."""
    return F.exists(values, lambda v: F.lower(F.trim(v)).isin("1", "true"))
