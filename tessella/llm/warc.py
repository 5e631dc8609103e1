"""WARC archives with revisit resolution.

Headers alone (id, url, digest, length) are shuffled by payload digest: of the records
with one digest, that of the smallest id is the original response, and every other one
becomes a revisit with fresh headers that refer to it.  A revisit is written from its
header, so its payload never moves; which rows are responses is told on the spot by a
Bloom filter of the revisits, and the few rows that it can't tell are joined.

Archives are WARC/1.1 files with a gzip member for each record, written by Spark's text
writer: a row is a whole archive, and its last byte, which ends a gzip member of less
than 16 MiB and is 0, is the writer's line separator.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.sieve import without

#: Fixed values of the format: RFC 4648 digits, and the profile of a revisit record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = b"\r\n"
#: Bytes of a gzip member before compression at most; below 16 MiB its last byte is 0.
MEMBER = (1 << 24) - 1
_RECORD = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_url string"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 20 bits, or five hex digits, at a time."""
    digits = F.sha1(payload)
    out = []
    for k in range(8):
        value = F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(page_id: int | None, salt: bytes) -> str:
    """A version-8 UUID that holds the 64-bit page id, whether it is null, and 57 bits of a hash of ``salt``."""
    h = int.from_bytes(hashlib.sha1(salt).digest()[:8]) >> 7
    value = ((page_id or 0) & (1 << 64) - 1) << 58 | (page_id is None) << 57 | h
    a, b, c = value >> 74, value >> 62 & 0xFFF, value & (1 << 62) - 1
    last = f"{1 << 63 | c:016x}"
    return f"{a >> 16:08x}-{a & 0xFFFF:04x}-8{b:03x}-{last[:4]}-{last[4:]}"


def _page_id(urn: str) -> int | None:
    """The page id that a record's UUID holds."""
    x = urn.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    value = int(x[:12], 16) << 74 | int(x[13:16], 16) << 62 | int(x[16:], 16) & (1 << 62) - 1
    page = value >> 58
    return None if value >> 57 & 1 else page - (1 << 64) if page >> 63 else page


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_to_url) of ``pages``.

    A null payload is empty.  Of records with equal payloads of at least ``min_bytes``
    bytes, those with the smallest non-null page_id are responses (a repeated smallest
    id leaves several) and the others revisit it, with a null ``payload``; shorter
    payloads, and groups whose ids are all null, are responses.  Columns other than
    page_id, url and html are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    name = F.xxhash64(F.sha1("payload"), F.octet_length("payload"), "page_id").alias("name")
    heads = rows.select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), name
    )
    heads = written(heads, "heads")
    same = ["payload_digest", "payload_bytes"]
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    groups = heads.filter(F.col("payload_bytes") >= min_bytes).groupBy(*same).agg(F.count("*").alias("n"), first.alias("first"))
    repeated = written(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).select(*same, "first"), "repeated")
    revisits = heads.join(repeated, same).filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    revisits = written(
        revisits.select(
            "page_id", "url", F.lit(None).cast("string").alias("payload"), *reversed(same), F.lit("revisit").alias("record_type"),
            F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_url"), "name",
        ),
        "revisits",
    )
    known = revisits.select(F.col("payload_digest").alias("d"), F.col("page_id").alias("p"), F.col("name").alias("n")).distinct()
    is_revisit = (F.col("payload_digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p"))
    named = _described(rows.select("*", name))
    responses = without(named, "name", is_revisit, heads.select("payload_digest", "page_id", "name"), "name", is_revisit, known, "n")
    order = [c.split()[0] for c in _RECORD.split(", ")]
    return responses.select(*order).unionByName(revisits.select(*order))


def _described(rows: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload, name) as responses."""
    return rows.select(
        "page_id",
        "url",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_url"),
        "name",
    )


def _block(fields: list[tuple[str, bytes | str | None]], body: bytes = b"", version: bytes = b"WARC/1.1\r\n", end: bytes = _EOL) -> bytes:
    """Header lines, a blank one and ``body``; null values have no line, control characters become blanks."""
    lines = [version]
    for name, value in fields:
        if value is not None:
            value = value.encode() if isinstance(value, str) else value
            lines += [name.encode(), b": ", re.sub(rb"[\x00-\x1F\x7F]", b" ", value), _EOL]
    return b"".join([*lines, end, body])


def _record(row: dict, date: str, place: bytes) -> bytes:
    """One WARC record; a revisit has the HTTP header block alone."""
    digest, page = row["payload_digest"], row["page_id"]
    revisit = row["record_type"] == b"revisit"
    http = _block(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(row["payload_bytes"]))],
        b"" if revisit else row["payload"],
        b"HTTP/1.1 200 OK\r\n",
    )
    # what others refer to is named by page and digest, all else by its place as well
    salt = digest if page is not None and not revisit else digest + place
    urn = lambda p, s: f"<urn:uuid:{record_id(p, s)}>"
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", urn(page, salt)),
        ("WARC-Date", date),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", b"sha1:" + digest),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", urn(row["refers_to"], digest)),
            ("WARC-Refers-To-Target-URI", row["refers_to_url"]),
            ("WARC-Refers-To-Date", date),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http)))]
    return _block(fields, http + _EOL + _EOL)


def _info(date: str, place: bytes) -> bytes:
    body = b"software: tessella\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{record_id(None, b'info' + place)}>"), ("WARC-Date", date)]
    return _block([*fields, ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))], body + _EOL + _EOL)


def _members(record: bytes) -> list[bytes]:
    """The record as a gzip member, or as several if it is very long."""
    return [gzip.compress(record[a : a + MEMBER], 6, mtime=0) for a in range(0, len(record), MEMBER)]


def write_archives(resolved: DataFrame, path: str, date: str | None = None, file_bytes: int = 32 << 20) -> None:
    """Write a record for each row of ``resolve()`` into archives below ``path``, a new folder.

    Each archive begins with a warcinfo record and ends with the record that fills
    ``file_bytes`` compressed bytes.  ``date`` (now, unless given) is that of all records.
    Record ids are unique, but for exact repeats of a response (same id and payload).
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archive(batches):
        held: list[bytes] = []
        size, made, rows = 0, 0, 0
        task = TaskContext.get().partitionId()

        def whole() -> pa.RecordBatch:
            data = b"".join([*_members(_info(date, b"%d %d" % (task, made))), *held])
            return pa.record_batch([pa.array([data[:-1]], pa.binary())], names=["archive"])

        for batch in batches:
            columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, columns)}
                rows += 1
                members = _members(_record(row, date, b" %d %d" % (task, rows)))
                held += members
                size += sum(map(len, members))
                if size >= file_bytes:
                    yield whole()
                    held, size, made = [], 0, made + 1
        if held:
            yield whole()

    rows = resolved.select(*[c.split()[0] for c in _RECORD.split(", ")]).mapInArrow(archive, "archive binary")
    rows.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    found = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8").partition(": ")
        found[name.lower()] = value
    return found


def _records(content: pa.Buffer):
    """Records of one archive, read one after the other by their Content-Length."""
    with io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content)), 1 << 16) as stream:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = _headers(stream)
            block = io.BytesIO(stream.read(int(head["content-length"])))
            if head["warc-type"] not in ("response", "revisit"):
                continue
            block.readline()
            http = _headers(block)
            yield head, http, block.read()


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each response and revisit: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken anew from its payload, those of a revisit
    from its headers.  ``payloads`` adds the payload (null for a revisit).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [c.split()[0] for c in schema.split(", ")] + ["payload"] * payloads

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, http, body in _records(content.as_buffer()):
                    response = head["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if response else head["warc-payload-digest"].removeprefix("sha1:")
                    refers = None if response else _page_id(head["warc-refers-to"])
                    n = len(body) if response else int(http["content-length"])
                    row = (_page_id(head["warc-record-id"]), head.get("warc-target-uri"), n, digest, head["warc-type"], refers)
                    rows.append((*row, body if response else None) if payloads else row)
                    size += len(body) * payloads + 200
                    if size > 8_000_000:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, schema + ", payload binary" * payloads)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
