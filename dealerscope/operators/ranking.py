"""Ranks that do not put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A value's range is one of STEPS to each factor of two, so a range spans 1/185 of its values.
STEPS = 128
# Doubles lie between 2**-1074 and 2**1024, which bounds the ranges of a group: 2 * STEPS * 2098 + 1.
_FAR = 1100 * STEPS


def value_range(value: Column) -> Column:
    """A whole number that does not fall as the value grows; null stays null.

    It hangs on the value alone, so it needs no look at the data and every reading gives the same.
    """
    x = value.cast("double")
    place = F.floor(F.log2(F.abs(F.nullif(x, F.lit(0.0)))) * STEPS) + _FAR
    return F.when(value.isNotNull(), F.coalesce(F.signum(x).cast("bigint") * place, F.lit(0).cast("bigint")))


def rank_descending(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """``RANK() OVER (PARTITION BY group ORDER BY value DESC NULLS FIRST)``, ties included.

    No task sorts a whole group. Equal values are counted first, so a tie is one row however
    many rows have it. A group is cut into value ranges, sorted inside each, and the rows of
    higher ranges are added: a group has at most half a million ranges whatever its rows, most
    have a few hundred. ``df`` is read for the counts and for the rows. Group and value are
    kept as structs, which equal themselves even where they hold a null.
    """
    rows = df.withColumns({"_group": F.struct(*group), "_at": F.struct(F.col(value).alias("v")), "_range": value_range(F.col(value))})
    counts = rows.groupBy("_group", "_range", "_at").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy(F.desc_nulls_first("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_group", F.struct("_range").alias("_in")).agg(F.first("_range").alias("_range"), F.sum("_n").alias("_n"))
    ranges = ranges.select("_group", "_in", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_group", "_in").orderBy(F.desc("_at.v")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        counts.withColumn("_in", F.struct("_range"))
        .join(ranges, ["_group", "_in"])
        .select("_group", "_at", (F.col("_above") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1).alias(out))
    )
    return rows.join(ranked, ["_group", "_at"]).select(*df.columns, out)


def tiles(df: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """Add the exact n-tile of ``value``, 0 for the smallest; equal values share one, null is the largest.

    It is taken from the rank among all rows, which no task sorts as a whole.
    """
    count = df.agg(F.count(F.lit(1))).scalar()
    ranked = rank_descending(df.withColumn("_everything", F.lit(0)), ["_everything"], value, "_rank")
    tile = n - 1 - F.floor((F.col("_rank") - 1) * n / count).cast("int")
    return ranked.withColumn(out, tile).drop("_everything", "_rank")


def mean_rank_share(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ascending rank divided by the row count, ties sharing their mean rank.

    Meant for a handful of rows (cluster centres): the window is one partition.
    """
    ordered, peers, everything = Window.orderBy(column), Window.partitionBy(column), Window.partitionBy()
    mean_rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)
    return df.withColumn(out, mean_rank / F.count(F.lit(1)).over(everything))
