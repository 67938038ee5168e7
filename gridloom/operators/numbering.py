"""Row numbers and running sums over a whole table, without a task that sees all of it.

Rows are dealt by ranges of their order and written; each range is numbered on its own
and moved by the totals of the ranges before it, of which there are as many as
partitions (for each group, as many as it spans).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def running(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), **sums: Column) -> DataFrame:
    """df with a column for each of ``sums``: its sum over the rows before a row, in its group, in ``order``.

    A sum of 1 numbers the rows from 0. The order should tell rows of a group apart; equal rows are numbered as they come.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *[c.alias(f"_of_{k}") for k, c in sums.items()], F.struct(*order).alias("_order"))
    ranged = materialize(keyed.repartitionByRange(parts, *group, "_order").withColumn("_part", F.spark_partition_id()), "ranges")
    names = [F.col(g) for g in group]
    totals = ranged.groupBy("_part", *group).agg(*[F.sum(f"_of_{k}").alias(f"_sum_{k}") for k in sums])
    # a group's rows lie in neighbouring ranges, at most one row a range here
    earlier = Window.partitionBy(*(names or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *group, *[F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_from_{k}") for k in sums])
    totals = totals.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[f"_from_{k}" for k in sums])
    inside = Window.partitionBy("_part", *group).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.select("*", *[F.coalesce(F.sum(f"_of_{k}").over(inside), F.lit(0)).alias(f"_in_{k}") for k in sums])
    on = ranged["_part"] == totals["_p"]
    for i, g in enumerate(group):
        on = on & ranged[g].eqNullSafe(totals[f"_g{i}"])
    return ranged.join(totals, on).select(*df.columns, *[(F.col(f"_from_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])
