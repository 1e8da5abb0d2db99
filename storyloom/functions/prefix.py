"""Ranks and running totals within groups of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import shuffle_width, written


def running(df: DataFrame, group: list[str], order: list[Column], totals: dict[str, Column], rank: str = "rank") -> DataFrame:
    """df with `rank` (from 1) and the totals up to and including each row, within group by order.

    Rows are cut into ranges of (group, order); each range is ranked on its own and shifted by what the
    ranges before it hold, of which there are at most as many as shuffle partitions for a group. So no
    task sorts a whole group. order must be total within a group.
    """
    ordered = df.withColumns({f"_t{i}": c for i, c in enumerate(totals.values())} | {f"_o{i}": c for i, c in enumerate(order)})
    keys = [*group, *(c for c in ordered.columns if c.startswith("_o"))]
    # nulls come first and rank with the rest: range partitioning and windows order alike
    ranged = ordered.repartitionByRange(shuffle_width(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy(*group, "_part").orderBy(*keys[len(group) :]).rowsBetween(Window.unboundedPreceding, 0)
    names = list(totals)
    held = written(ranged.select("*", F.row_number().over(local.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("_n"), *(F.sum(f"_t{i}").over(local).alias(f"_s{i}") for i in range(len(names)))), "ranges")
    parts = held.groupBy(*group, "_part").agg(F.count("*").alias("_n"), *(F.coalesce(F.sum(f"_t{i}"), F.lit(0)).alias(f"_s{i}") for i in range(len(names))))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_p"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ["_n", *(f"_s{i}" for i in range(len(names)))]))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = held.join(shift, same)
    return out.select(*df.columns, (F.col("_n") + F.col("_b_n")).alias(rank), *((F.col(f"_s{i}") + F.col(f"_b_s{i}")).alias(n) for i, n in enumerate(names)))
