"""Mappings over streams of documents, and metadata that is read anew between batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.engine import Engine, Mapping


def stream_mapping(engine: Engine, docs: DataFrame, mapping: Mapping | str, output: str = "result") -> DataFrame:
    """A mapping is row-local, so it holds for a stream as it stands."""
    return engine.transform(docs, mapping, output)


def refreshed_batches(
    docs: DataFrame, apply: Callable[[DataFrame], DataFrame], reload: Callable[[], None], sink: Callable[[DataFrame, int], None], checkpoint: str, every_seconds: float | None
) -> StreamingQuery:
    """Write each micro-batch through ``sink``; before one, ``reload`` if its time has come.

    ``every_seconds`` of None, zero or less never reloads.
    """
    last = [time.monotonic()]

    def batch(df: DataFrame, number: int) -> None:
        if every_seconds and every_seconds > 0 and time.monotonic() - last[0] >= every_seconds:
            reload()
            last[0] = time.monotonic()
        sink(apply(df), number)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
