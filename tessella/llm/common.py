"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that this process has written below the shared folder and not removed.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset in local mode
    (tests) is a folder of our own made and used for checkpoints as well.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage.

    The table stays until ``clear`` or the end of a ``temporary`` block removes it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0, last: int | None = None) -> None:
    """Remove the tables written so far, once nothing reads them any more."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for place in _MADE[since:last]:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(hadoop).delete(path, True)
    del _MADE[since:last]


@contextmanager
def temporary(spark: SparkSession):
    """Tables written within the block are removed at its end, but for the last one."""
    before = len(_MADE)
    yield
    clear(spark, before, -1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def running(values: Column, merge: Callable[[Column, Column], Column], none: int, stretch: int = 128) -> Column:
    """Running totals of a non-empty array of whole numbers by an associative ``merge``.

    Arrays can't grow in place, so totals are built within stretches and then shifted by
    what lies before each: the work is linear but for one element a stretch.
    """
    array = "array<bigint>"
    start = F.struct(F.lit(none).cast("bigint").alias("now"), F.array().cast(array).alias("out"))

    def totals(xs: Column, before: bool) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = merge(acc["now"], x)
            kept = acc["now"] if before else now
            return F.struct(now.alias("now"), F.concat(acc["out"], F.array(kept)).alias("out"))

        return F.aggregate(xs, start, step)["out"]

    def build(xs: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(stretch)), lambda a: F.slice(xs, a, F.lit(stretch)))
        inner = F.transform(cuts, lambda c: totals(c, before=False))
        return F.transform(
            F.array(inner),
            lambda parts: F.flatten(
                F.zip_with(
                    parts,
                    totals(F.transform(parts, lambda p: F.element_at(p, -1)), before=True),
                    lambda p, b: F.transform(p, lambda v: merge(b, v)),
                )
            ),
        )[0]

    # the array is bound once, not computed anew for each use
    return F.transform(F.array(F.transform(values, lambda v: v.cast("bigint"))), build)[0]


def unused(name: str, docs: DataFrame) -> str:
    """``name`` behind as many underscores as no column of ``docs`` begins with."""
    most = max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0)
    return "_" * (most + 1) + name


def in_order(df: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """Deal rows out by ascending ``key`` (nulls first, ties by text hash) and sort them."""
    tie = F.xxhash64(F.col(text))
    return df.repartitionByRange(parts or partitions(df.sparkSession), F.col(key), tie).sortWithinPartitions(
        F.col(key), tie, F.col(text)
    )


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
