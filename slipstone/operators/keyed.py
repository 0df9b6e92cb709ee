"""Per-key lookups and ranks that stay balanced when one key holds a large share of all rows.

The aggregate side is combined before its shuffle, so a hot key costs nothing there. The row
side meets a side that is unique per key in an ordinary join: a partition that a hot key makes
large is split at run time and its one matching row repeated for each part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spool


def _matches(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys]
    )


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """Left-join the unique-per-key ``values`` onto ``rows``; missing keys give nulls."""
    side = values.select(
        *[F.col(k).alias(f"__c_{k}") for k in keys],
        *[F.col(c).alias(f"__c_{c}") for c in take],
    )
    return rows.join(side, _matches(rows, side, keys, "__c_"), "left").select(
        *[c for c in rows.columns if c not in take],
        *[F.col(f"__c_{c}").alias(c) for c in take],
    )


def attach_first(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    into: str,
    *,
    where: Column | None = None,
) -> DataFrame:
    """Add struct column ``into``: the smallest ``order`` tuple among the rows of each key.

    ``where`` limits which rows may be the first one; keys without such a row get null. Keys
    held by one row need no lookup, so only repeated keys enter the join.
    """
    own = F.struct(*order)
    eligible = own if where is None else F.when(where, own)
    firsts = rows.groupBy(*keys).agg(
        F.min(eligible).alias(into), F.count(F.lit(1)).alias("n")
    )
    found = lookup(rows, spool(firsts.filter("n > 1")), keys, [into])
    return found.withColumn(into, F.coalesce(into, eligible))


def ranked(df: DataFrame, order: list[str], into: str = "rank") -> DataFrame:
    """Global 1-based rank without a global window.

    Rows are range-partitioned and sorted by ``order``, and numbered as they lie in their part;
    part sizes (one row each) give the offsets. ``order`` must be unique. The rows are written
    once and shuffled once.
    """
    parted = spool(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    # the number holds the part in its upper bits and the place within the part in the lower 33
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = parted.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    # one row per partition of the sort, so the broadcast side cannot grow with the data
    return (
        parted.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(into, place + F.lit(1) + F.col("__offset"))
        .drop("__part", "__offset", "__at")
    )


def ranked_within(
    df: DataFrame, keys: list[str], order: list[str], into: str = "rank", size: str = "size"
) -> DataFrame:
    """1-based rank of each row inside its key, and the key's size; safe for hot keys.

    ``order`` must be unique inside a key. The rank is the global one less the key's start.
    """
    everywhere = ranked(df, keys + order, "__global")
    starts = everywhere.groupBy(*keys).agg(
        F.min("__global").alias("__start"), F.count(F.lit(1)).alias(size)
    )
    return (
        lookup(everywhere, starts, keys, ["__start", size])
        .withColumn(into, F.col("__global") - F.col("__start") + 1)
        .drop("__global", "__start")
    )
