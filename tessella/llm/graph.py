"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node reached.

    Each round points every node at its smallest neighbour, follows the pointers twice, and
    contracts the edges; stars and short chains are gone after a round or two.  Rounds end
    as written tables.  Nulls, loops and repeated edges are ignored.
    """
    left = written(edges.select("a", "b").dropna().filter("a != b").distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        point = written(point, "pointers")
        for _ in range(2):
            ahead = point.select(F.col("a").alias("p"), F.col("p").alias("next"))
            point = point.join(ahead, "p").select("a", F.col("next").alias("p"))
        point = written(point, "pointers")
        if found is None:
            found = point.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = point.select(F.col("a").alias("root"), F.col("p").alias("next"))
            found = written(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        for end in ("a", "b"):
            to = point.select(F.col("a").alias(end), F.col("p").alias("to"))
            left = left.join(to, end).drop(end).withColumnRenamed("to", end)
        left = written(left.select("a", "b").filter("a != b").distinct(), "edges")
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
