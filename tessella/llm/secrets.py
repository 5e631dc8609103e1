"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every version of a document is addressed by the SHA-256 of its text.  A ledger holds a
row for each blob and rule version that has been scanned, with the spans found.  A scan
takes one copy of each blob and the rule versions that the ledger lacks for it; findings
are joined back to every document that has the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, running, unused


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: Fixed patterns.  A run shorter than its limit can't hold a longer one, so those of
#: access and hex state the limit themselves.
RULES = (
    Rule("assign", 1, "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", base=False),
)

_SPAN = "array<struct<start:int,end:int>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's leftmost, non-overlapping matches, in code points, end exclusive.

    The text between matches and the matches themselves alternate, so their lengths
    added up give every match's place; the sums take linear time.
    """
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("between"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("match"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )

    def build(p: Column) -> Column:
        ends = running(F.transform(p["match"], lambda n, i: n + F.get(p["between"], i)), lambda a, b: a + b, 0)
        found = F.transform(
            ends,
            lambda end, i: F.struct(
                (end - F.get(p["match"], i)).cast("int").alias("start"), end.cast("int").alias("end"), (F.get(p["value"], i) >= rule.least).alias("kept")
            ),
        )
        return F.transform(F.filter(found, lambda s: s["kept"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    found = F.get(F.transform(F.array(parts), build), F.lit(0))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows (blob_id, kind, version, spans) of the pairs that ``ledger`` lacks.

    A null text is the empty blob.  Copies of a blob are dropped before and after the
    shuffle, so a large group of copies costs no task more than its share.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(blob_id(text).alias("blob_id"), text.alias("text"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        unseen = blobs.dropDuplicates(["blob_id"]).withColumn("wanted", wanted)
    else:
        heads = blobs.select("blob_id").distinct().select("blob_id", F.explode(wanted).alias("w")).select("blob_id", "w.*")
        missing = heads.join(ledger.select("blob_id", "kind", "version"), ["blob_id", "kind", "version"], "left_anti")
        needed = missing.groupBy("blob_id").agg(F.collect_set(F.struct("kind", "version")).alias("wanted"))
        unseen = blobs.dropDuplicates(["blob_id"]).join(needed, "blob_id")
    results = []
    for r in rules:
        pair = F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))
        found = F.when(F.array_contains("wanted", pair), spans(F.col("text"), r))
        results.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), found.alias("spans")))
    rows = unseen.select("blob_id", F.array(*results).alias("found")).select("blob_id", F.explode("found").alias("f"))
    return rows.select("blob_id", "f.kind", "f.version", "f.spans").filter(F.col("spans").isNotNull())


def update_ledger(docs: DataFrame, path: str | None = None, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what is unseen, write it to ``path`` (a new folder), and return the whole ledger."""
    path = path or fresh_path(docs.sparkSession, "ledger")
    new = scan(docs, ledger, rules)
    new.write.option("compression", "zstd").parquet(path)
    read = docs.sparkSession.read.schema(new.schema).parquet(path)
    return read if ledger is None else ledger.select(read.columns).unionByName(read)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each blob with any: ``found``, its spans of the given rule versions by start, then kind."""
    current = reduce(Column.__or__, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
    rank = reduce(lambda c, x: c.when(F.col("kind") == x[1].kind, x[0]), enumerate(rules), F.when(F.lit(False), -1))
    rows = ledger.filter(current & (F.size("spans") > 0)).dropDuplicates(["blob_id", "kind", "version"])
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind")))
    # at most one row for each rule
    return rows.groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_list(named))).alias("found"))


def joined_spans(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row of ``docs``: doc_id, counts by base kind, base_sha256, and all spans.

    Rows with null or repeated ids are kept; a null text has no spans; other columns are
    not read.
    """
    heads = docs.select("doc_id", blob_id(F.col("text").cast("string")).alias("blob_id"))
    joined = heads.join(blob_findings(ledger, rules), "blob_id", "left")
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    base = [r.kind for r in rules if r.base]
    of = lambda *kinds: F.filter(found, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return joined.select("doc_id", *counts, F.sha2(joined_spans(of(*base)), 256).alias("base_sha256"), joined_spans(found).alias("spans"))


def redact(docs: DataFrame, ledger: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span in text replaced by ``mark``; overlapping spans become one mark.

    All rows and columns are kept; a null text stays null.  Work is linear in text and
    spans.
    """
    key, spans_ = unused("blob_id", docs), unused("found", docs)
    heads = blob_findings(ledger, rules).select(F.col("blob_id").alias(key), F.col("found").alias(spans_))
    joined = docs.withColumn(key, blob_id(F.col("text").cast("string"))).join(heads, key, "left")
    clean = F.when(F.col(spans_).isNotNull(), masked(F.col("text"), F.col(spans_), mark)).otherwise(F.col("text"))
    return joined.withColumn("text", clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def masked(text: Column, found: Column, mark: str, stretch: int = 4096) -> Column:
    """``text`` with ``mark`` for each of the sorted, non-empty spans; what overlaps is one.

    The text is cut into stretches of characters once, so what lies between two spans is
    put together from whole stretches and two short ends.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stretch}}}"), F.lit(0)).alias("cut"),
        F.transform(found, lambda s: s["start"]).alias("start"),
        running(F.transform(found, lambda s: s["end"]), F.greatest, 0).alias("reach"),
        F.length(text).alias("n"),
    )

    def between(p: Column, a: Column, b: Column) -> Column:
        """Characters from a up to b."""
        first, last = F.floor(a / stretch).cast("int"), F.floor(b / stretch).cast("int")
        at, to = (a - first * stretch).cast("int"), (b - last * stretch).cast("int")
        whole = F.array_join(F.slice(p["cut"], first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, F.substring(F.get(p["cut"], first), at + 1, to - at)).otherwise(
            F.concat(F.substring(F.get(p["cut"], first), at + 1, F.lit(stretch)), whole, F.coalesce(F.substring(F.get(p["cut"], last), F.lit(1), to), F.lit("")))
        )

    def build(p: Column) -> Column:
        # what lies before span i begins where all spans before it have ended
        before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(p["reach"], i - 1))
        gaps = F.transform(
            p["start"], lambda start, i: F.when((i == 0) | (start >= before(i)), F.coalesce(between(p, before(i), start.cast("bigint")), F.lit("")))
        )
        tail = F.coalesce(between(p, F.element_at(p["reach"], -1), p["n"].cast("bigint")), F.lit(""))
        return F.array_join(F.concat(F.filter(gaps, lambda g: g.isNotNull()), F.array(tail)), mark)

    return F.get(F.transform(F.array(parts), build), F.lit(0))
