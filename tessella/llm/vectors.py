"""What the two vector searches share: valid rows, distinct vectors, query sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import partitions


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of rows that take part.

    Left out: null ids, vectors that are null, empty or hold null or non-finite
    components, and vectors whose length is not the most frequent one.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    )
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    length = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.filter(F.size("vector") == (length.dim if length else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(vector, members): each distinct vector with its ``most`` smallest ids in order.

    A search for fewer rows than ``most`` can't need more of one vector.  Repeats of an id
    count once.  The row limit of the window is applied before the shuffle, so a vector
    that a third of all rows share sends few rows.
    """
    once = rows.groupBy("vector", "vec_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = once.withColumn("place", place).filter(F.col("place") <= most)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))


def query_rows(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, vector) of the rows whose id is divisible by ``every``, once each."""
    return rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` of each query by ``order``, with their rank."""
    place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(*order))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


#: Queries that one task takes at a time.
ASKED = 4096


def in_blocks(queries: DataFrame, rows: int = ASKED) -> DataFrame:
    """``queries`` (query_id, vector) with query_key, a hash of the vector, and a block of about ``rows`` each."""
    blocks = max(1, -(-queries.count() // rows))
    keyed = queries.withColumn("query_key", F.xxhash64("vector"))
    return keyed.withColumn("block", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(blocks)).cast("int"))


def sampled(points: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` distinct vectors in hash order, as a matrix on the driver."""
    few = points.orderBy(F.xxhash64("vector"), "vector").limit(most).select("vector").toArrow().column(0).combine_chunks()
    return few.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(few), -1) if len(few) else np.zeros((0, 0))


def spread_parts(spark: SparkSession, shards: int) -> int:
    """Partitions for work that is heavy on little data, which shouldn't be coalesced by size."""
    return max(1, min(shards, 4 * partitions(spark)))
