"""Places of rows in a total order, without passing them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil.sources.shared import written


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds each row's place from 0.  Rows are dealt by range and sorted; only the sizes of the ranges are gathered.

    The sorted rows are written once, so that both uses see the same ranges, also after a lost executor.
    """
    ranged = written(df.sort(*order).select("*", F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    if not sizes:
        return ranged.drop("_id").withColumn(name, F.lit(0).cast("long"))
    before, starts = 0, []
    for p in sorted(sizes):
        starts += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += sizes[p]
    within = F.col("_id") - F.shiftleft(part, 33)
    return ranged.withColumn(name, F.element_at(F.create_map(*starts), part) + within).drop("_id")


def with_rank(df: DataFrame, group: str, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds each row's place from 1 within its group.

    All rows are sorted by group and order over as many tasks as there are ranges, and a group's places count from its first one: a large
    group is not one task.  Ties that order leaves are broken as the sort falls.
    """
    placed = with_position(df, group, *order, name="_place")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    joined = placed.join(first.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first", "_group")
