"""Connected components of a link table by contraction, without a graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spool


def _roots(pointers: DataFrame) -> DataFrame:
    """Follow ``v`` -> ``to`` (always downwards) to the end by pointer doubling."""
    while True:
        ahead = pointers.select(F.col("v").alias("to"), F.col("to").alias("next"))
        doubled = spool(
            pointers.join(ahead, "to", "left").select(
                "v",
                F.coalesce("next", "to").alias("to"),
                (F.col("next").isNotNull() & (F.col("next") != F.col("to"))).alias("moved"),
            )
        )
        if doubled.filter("moved").isEmpty():
            return doubled.select("v", "to")
        pointers = doubled.select("v", "to")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (v, component) for every vertex of ``links``; component is its smallest vertex.

    Each round points every vertex at the smallest vertex among itself and its neighbours,
    follows the pointers to their ends and replaces the links by the distinct links between
    those ends. The graph at least halves, so the rounds grow with its logarithm; every step is
    a keyed join or a combined aggregate and is stored, so a lost executor costs a reread.
    Self links and nulls are ignored; an empty table gives an empty result.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    graph = spool(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not graph.isEmpty():
        both = graph.union(graph.select(F.col("b"), F.col("a")))
        pointers = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to"))
        roots = _roots(spool(pointers))
        if found is None:
            found = roots.withColumnRenamed("to", "component")
        else:
            step = roots.select(F.col("v").alias("component"), "to")
            found = found.join(step, "component", "left").select(
                "v", F.coalesce("to", "component").alias("component")
            )
        found = spool(found)
        left = roots.select(F.col("v").alias("a"), F.col("to").alias("ra"))
        right = roots.select(F.col("v").alias("b"), F.col("to").alias("rb"))
        graph = spool(
            graph.join(left, "a").join(right, "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if found is None:
        return ends.select(F.col("a").alias("v"), F.col("b").alias("component")).limit(0)
    return found
