"""Token ids as directly addressable codes.

Ids are split into byte chunks.  Level 0 holds the lowest chunk of every id; a bitmap
says which ids go on, and level 1 holds the next chunk of those alone, and so on.  A
rank directory over each bitmap finds an id's place on the next level, so any token
is read from a few bytes without decoding a block.

An *image* is one self-contained byte string of this format: header, document ids and
starts, then for each level its chunks, bitmap and rank directory.  Images are rows of
a Parquet table, since Spark can write and read that in any store; its pages are not
compressed, so the bytes of an image lie there as they are.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.bytehash import text_bytes
from tessella.llm.common import fresh_path, in_order
from tessella.llm.encode import encoder

_MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sIqqq")  # magic, levels, tokens, documents, nulls' place in the list
#: Bytes of text that are encoded in one go.
ENCODED = 2_000_000
#: Bits of a bitmap that one rank entry covers.
RANK_BITS = 512


def encode_image(ids: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, starts: np.ndarray) -> bytes:
    """The image of ``ids``, which hold documents starting at ``starts`` (one more at the end)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        go_on = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), go_on))
        rest = rest[go_on] >> 8
        if not go_on.any():
            break
    parts = [
        _HEAD.pack(_MAGIC, len(levels), len(ids), len(doc_ids), 0),
        doc_ids.astype("<i8").tobytes(),
        doc_null.astype(np.uint8).tobytes(),
        starts.astype("<i8").tobytes(),
    ]
    for chunks, go_on in levels:
        bits = np.packbits(go_on, bitorder="little")
        ends = np.concatenate([[0], np.cumsum(go_on, dtype=np.int64)])
        ranks = ends[np.arange(0, len(chunks) + 1, RANK_BITS)].astype("<u4")
        parts += [struct.pack("<q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class Image:
    """Reads an image in place."""

    def __init__(self, data: bytes):
        magic, n_levels, self.n_tokens, self.n_docs, _ = _HEAD.unpack_from(data, 0)
        if magic != _MAGIC:
            raise ValueError("not a token image")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.doc_null = np.frombuffer(data, np.uint8, self.n_docs, at).astype(bool)
        at += self.n_docs
        self.starts = np.frombuffer(data, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            ranks = np.frombuffer(data, "<u4", n // RANK_BITS + 1, at)
            at += 4 * (n // RANK_BITS + 1)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """The id at place ``i``: one byte, one bit and one rank for each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            low = block * RANK_BITS // 8
            before = int(np.bitwise_count(bits[low : i >> 3]).sum())
            before += (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + before
            shift += 8
        return value

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at many places at once, by the same few bytes for each."""
        value, at, who = np.zeros(len(places), np.uint32), np.asarray(places, np.int64), np.arange(len(places))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value[who] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            go_on = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            at, who = at[go_on], who[go_on]
            found = np.empty(len(at), np.int64)
            for low in range(0, len(at), 65_536):
                part = at[low : low + 65_536]
                block = part // RANK_BITS
                byte = (block * (RANK_BITS // 8))[:, None] + np.arange(RANK_BITS // 8)
                inside = part[:, None] - 8 * byte  # bits of each byte that lie before the place
                kept = (1 << np.clip(inside, 0, 8)) - 1
                before = np.bitwise_count(bits[np.minimum(byte, len(bits) - 1)] & kept.astype(np.uint8)).sum(axis=1)
                found[low : low + 65_536] = ranks[block] + before
            at = found
        return value

    def tokens(self) -> np.ndarray:
        """All ids, from the last level down."""
        higher = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            go_on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            here[go_on] |= higher << np.uint32(8)
            higher = here
        return higher


def write_images(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    image_tokens: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts in ascending ``id_col`` order and write their images to ``path``.

    Null ids come first, repeated ids are ordered by text, a null text is empty, and
    ``end_id`` follows every document.  Other columns are not read.  An image ends with
    the document that fills it, so a very long text has an image of its own.
    """

    def encode(batches):
        codec, shard, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def image():
            ids = np.concatenate([h[0] for h in held])
            lens = np.concatenate([h[3] for h in held])
            names, null = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            starts = np.concatenate([[0], np.cumsum(lens)])
            row = (shard, seq, len(ids), len(lens), encode_image(ids, names, null, starts))
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)

        for batch in batches:
            column = batch.column(0)
            names, null = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            buf, offsets = text_bytes(batch.column(1))
            for low, high in slices(offsets, ENCODED):
                part = offsets[low : high + 1]
                flat, at = codec.encode(buf[part[0] : part[-1]], part - part[0])
                lens = np.diff(at) + 1
                ids = np.insert(flat, at[1:], end_id)
                held.append((ids, names[low:high], null[low:high], lens))
                size += len(ids)
                if size >= image_tokens:
                    yield image()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield image()

    rows = in_order(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text")
    rows.mapInArrow(encode, "shard int, seq int, n_tokens long, n_docs long, image binary").write.option(
        "compression", "none"
    ).parquet(path)


_NAMES = ["shard", "seq", "n_tokens", "n_docs", "image"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def slices(offsets: np.ndarray, most: int = 500_000):
    """Row ranges of a batch that hold about ``most`` bytes each."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the images at ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the tokens of all documents before it: those of earlier shards, of
    earlier images of its shard, and of earlier documents of its image.
    """

    def decode(batches):
        for batch in batches:
            for shard, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                image = Image(data)
                raw, starts = memoryview(image.tokens().astype("<u4").tobytes()), image.starts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
                n = image.n_docs
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array(np.full(n, seq, np.int32)),
                        pa.array(image.doc_ids, mask=image.doc_null),
                        pa.array(starts[:-1].copy()),
                        pa.array(np.diff(starts)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    images = spark.read.parquet(path)
    docs = images.select("shard", "seq", "image").mapInArrow(
        decode, "shard int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    return docs.join(_bases(images), ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _bases(images: DataFrame) -> DataFrame:
    """(shard, seq, base, n) of each image: the tokens before it and its own; images aren't read."""
    heads = images.select("shard", "seq", F.col("n_tokens").alias("n"))
    shards = heads.groupBy("shard").agg(F.sum("n").alias("n"))
    # a row for each shard, however many documents there are
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n")
    bases = heads.select("shard", "seq", "n", inside.alias("inside")).join(before, "shard")
    return bases.select("shard", "seq", (F.col("shard_base") + F.col("inside")).alias("base"), "n")


#: Token positions of one bucket, by which positions find their image.
BUCKET = 1 << 20


def tokens_at(positions: DataFrame, path: str, position_col: str = "position") -> DataFrame:
    """(position, token) for each distinct position asked for: random access to the archive at ``path``.

    Positions count all tokens of the archive, as ``start`` does; nulls and positions
    outside of it have no row.  Images without a position are not joined, and a token is
    read from its image in place, without decoding the others.
    """
    images = positions.sparkSession.read.parquet(path)
    bucket = lambda c: F.floor(c / BUCKET)
    asked = positions.select(F.col(position_col).cast("long").alias("position")).dropna().distinct()
    spans = _bases(images).filter("n > 0")
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("base")), bucket(F.col("base") + F.col("n") - 1))))
    hit = asked.withColumn("bucket", bucket(F.col("position"))).join(spans, "bucket")
    hit = hit.filter((F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("n")))
    # at most an image's tokens
    wanted = hit.groupBy("shard", "seq", "base").agg(F.collect_list(F.col("position") - F.col("base")).alias("places"))

    def read(batches):
        for batch in batches:
            for data, base, places in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                at = places.values.to_numpy(zero_copy_only=False)
                found = Image(data.as_buffer()).take(at)
                yield pa.record_batch([pa.array(at + base), pa.array(found.astype(np.int32))], names=["position", "token"])

    ready = images.select("shard", "seq", "image").join(wanted, ["shard", "seq"]).select("image", "base", "places")
    return ready.mapInArrow(read, "position long, token int")


def token_archive(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as images and read every document back from them."""
    path = path or fresh_path(docs.sparkSession, "dac")
    write_images(docs, path, tokenizer, **options)
    return read_images(docs.sparkSession, path)
