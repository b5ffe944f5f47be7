"""Exclusive running sums without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.session import cut


def exclusive_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """For each row the sums over the rows before it in ``order`` within its ``group``
    (columns without nulls); ``sums`` names a result column per summed column.

    Rows are range-partitioned by group and order, so a large group lies in many tasks.
    The partition number is stored with the row, so a task run again cannot disagree with
    the offsets, which are running sums over one row per group and partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *[F.col(c) for c in [*group, *order]]).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    parts = placed.groupBy(*group, "_part").agg(*[F.sum(src).alias(f"_s_{dst}") for dst, src in sums.items()])
    parts = parts.select(*group, "_part", *[F.coalesce(F.sum(f"_s_{dst}").over(outer), zero).alias(f"_o_{dst}") for dst in sums])
    out = placed.select("*", *[F.coalesce(F.sum(src).over(inner), zero).alias(f"_i_{dst}") for dst, src in sums.items()])
    out = out.join(parts, [*group, "_part"])
    return out.select(*df.columns, *[(F.col(f"_o_{dst}") + F.col(f"_i_{dst}")).alias(dst) for dst in sums])
