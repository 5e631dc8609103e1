"""URL filters as a sort-merge range join.

A host with its labels reversed, ``com.example.www.``, begins with the reversed host of
every domain above it, so a rule for a host is an interval of reversed hosts.  Rules and
urls are dealt out by range of (reversed host, row hash), so that a hot host is cut into
many ranges; a rule goes to each range that its interval meets.  Within a range, both are
swept in order with a stack of the nested rules whose intervals are open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessella.llm.common import partitions

_LAST = "\U0010ffff"
_LOW, _HIGH = np.int64(-(1 << 63)), np.int64((1 << 63) - 1)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


class Borders:
    """At most ``ranges - 1`` borders (key, salt) between ranges of rows that have these columns."""

    def __init__(self, rows: DataFrame, picked: int, ranges: int):
        pick = F.xxhash64(F.lit("border"), "salt", "key")
        seen = sorted((r.key, r.salt) for r in rows.select("key", "salt", pick.alias("pick")).orderBy("pick", "salt", "key").limit(picked).collect())
        chosen = [seen[i * len(seen) // ranges] for i in range(1, ranges)] if seen else []
        self.keys = np.array([k for k, _ in chosen], object)
        self.salts = np.array([s for _, s in chosen], np.int64)

    def places(self, key: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The range of each row: how many borders are not beyond it."""
        low = np.searchsorted(self.keys, key, "left")
        high = np.searchsorted(self.keys, key, "right")
        out = high.astype(np.int64)
        # hot keys lie on several borders; rows of the same stretch are placed at once
        on = np.flatnonzero(low < high)
        for first in np.unique(low[on]):
            rows = on[low[on] == first]
            out[rows] = first + np.searchsorted(self.salts[first : high[rows[0]]], salt[rows], "right")
        return out


class _Open:
    """Rules of one reversed host: paths by length, longest first."""

    def __init__(self, key: str):
        self.key, self.by_length = key, {}

    def add(self, host: str, path: str, action: str) -> None:
        at = self.by_length.setdefault(len(path), {})
        if path not in at or action == "block":
            at[path] = (host, action)

    def best(self, path: str):
        for n in sorted(self.by_length, reverse=True):
            if n <= len(path) and (hit := self.by_length[n].get(path[:n])):
                return len(hit[0]) + n, len(hit[0]), hit[0] + path[:n], hit[1]
        return None


def _sweep(default: str):
    def run(urls: pa.Table, rules: pa.Table) -> pa.Table:
        nested: dict[str, _Open] = {}
        for key, host, path, action in zip(*(rules.column(c).to_pylist() for c in ("key", "host", "path", "action"))):
            nested.setdefault(key, _Open(key)).add(host, path, action)
        ahead = sorted(nested.values(), key=lambda o: o.key, reverse=True)
        keys, paths = urls.column("key").to_pylist(), urls.column("path").to_pylist()
        found: list[tuple] = [(None, default)] * len(keys)
        stack: list[_Open] = []
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            key = keys[i]
            while ahead and ahead[-1].key <= key:
                rule = ahead.pop()
                while stack and not rule.key.startswith(stack[-1].key):
                    stack.pop()
                stack.append(rule)
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if hits := [h for o in stack if (h := o.best(paths[i]))]:
                found[i] = max(hits)[2:]
        rule, verdict = zip(*found) if found else ((), ())
        columns = [urls.column("page_id"), urls.column("host"), urls.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
        return pa.table(columns, names=["page_id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None, range_rows: int = 250_000,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """For each row of ``pages``: page_id, host, path, the rule that fits and its verdict.

    ``rules`` has host, path and action (allow or block).  A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest (host and path
    together, then host) wins, block before allow for the same rule; without one, rule is
    null and the verdict ``default``.  Rules with a null field are left out.  Repeated and
    null ids are kept as they are; other columns are not read.

    ``ranges`` only balances the work: unless given, there are twice as many as shuffle
    partitions, and at least one for each ``range_rows`` rows.  Borders come from 20 urls
    for each range, picked by a hash of their own, so that the row hashes (``salt``) of a
    hot host's picked rows spread over all of its rows and cut it evenly.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    ranges = ranges or max(2 * partitions(spark), -(-pages.count() // range_rows))
    urls = urls.withColumns({"key": reversed_host(F.col("host")), "salt": F.xxhash64("page_id", "host", "path")})
    borders = Borders(urls, 20 * ranges, ranges)

    @F.pandas_udf(IntegerType())
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(borders.places(key.to_numpy(object), salt.to_numpy(np.int64)), dtype="int32")

    @F.pandas_udf("struct<low:int,high:int>")
    def ranges_of(key: pd.Series) -> pd.DataFrame:
        low = borders.places(key.to_numpy(object), np.full(len(key), _LOW))
        high = borders.places((key + _LAST).to_numpy(object), np.full(len(key), _HIGH))
        return pd.DataFrame({"low": low, "high": high}, dtype="int32")

    rows = urls.withColumn("range", range_of("key", "salt")).drop("salt")
    upper = "".join(map(chr, range(65, 91)))
    clean = rules.select(F.translate("host", upper, upper.lower()).alias("host"), "path", "action").dropna().dropDuplicates()
    dealt = clean.withColumn("key", reversed_host(F.col("host"))).withColumn("r", ranges_of("key"))
    dealt = dealt.select("key", "host", "path", "action", F.explode(F.sequence("r.low", "r.high")).alias("range"))
    return (
        rows.groupBy("range")
        .cogroup(dealt.groupBy("range"))
        .applyInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
    )
