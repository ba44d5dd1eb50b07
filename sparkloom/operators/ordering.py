"""Global positions and ordered fills without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned by the order columns, with the partition's number in __part.

    Range bounds are sampled, so they are fixed once, by a checkpoint, before two passes rely on them.
    """
    return cut(df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).withColumn("__part", F.spark_partition_id()))


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position in the order (ties keep any order, nulls first): ranks within range partitions, shifted by the
    partitions before. Only one row a partition meets in one task."""
    d = _ranged(df, order)
    cols = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    sizes = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__from"))
    ranked = d.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*cols)) - 1)
    return ranked.join(F.broadcast(before), "__part").withColumn(name, (F.col("__from") + F.col("__k")).cast("long")).drop("__part", "__k", "__from")


def fill(df: DataFrame, column: str, order: list[str], backward: bool = False, partition: list[str] = ()) -> DataFrame:
    """Forward or backward fill by order; within groups if partition columns are named, else over the whole table.

    The whole-table fill goes in two passes: within range partitions, then from the nearest partition with a value.
    """
    # a frame that reaches to the end is scanned anew for every row; backward fills run through the rows from the end instead
    ends = [F.col(f"`{c}`").desc_nulls_last() if backward else F.col(f"`{c}`").asc_nulls_first() for c in order]
    last = F.last(F.col(f"`{column}`"), ignorenulls=True)

    def frame(by: list[str]):
        return Window.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(*ends).rowsBetween(Window.unboundedPreceding, 0)

    if partition:
        return df.withColumn(column, last.over(frame(partition)))
    d = _ranged(df, order)
    d = d.withColumn("__v", last.over(frame(["__part"])))
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    known = F.col(f"`{column}`").isNotNull()
    summary = d.groupBy("__part").agg((F.min_by if backward else F.max_by)(F.when(known, F.col(f"`{column}`")), F.when(known, key)).alias("__e"))
    across = Window.orderBy(F.col("__part").desc() if backward else F.col("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select("__part", F.last("__e", ignorenulls=True).over(across).alias("__c"))
    out = d.join(F.broadcast(carry), "__part", "left").withColumn(column, F.coalesce("__v", "__c"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
