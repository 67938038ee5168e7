"""Text dumps of tree nodes: blank-separated, a ``#`` header, extents at the end of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("idx", "num", "axis", "value", "left", "right", "beg", "end", "depth")
KINDS = ("long", "long", "int", "double", "long", "long", "long", "long", "int")


def write_nodes(nodes: DataFrame, path: str, dim: int) -> None:
    """Nodes as made by ``PointSet.kd_nodes``, as text under ``path``."""
    extents = [F.col(b)[i].cast("string") for b in ("bbox_min", "bbox_max") for i in range(dim)]
    lines = nodes.orderBy("idx").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in FIELDS], *extents).alias("value"))
    header = nodes.groupBy().agg(F.concat(F.lit(f"# dim={dim} nodes="), F.count("*").cast("string")).alias("value"))
    header.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)


def read_nodes(spark: SparkSession, path: str, dim: int) -> DataFrame:
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    named = [parts[i].cast(k).alias(c) for i, (c, k) in enumerate(zip(FIELDS, KINDS))]
    n = len(FIELDS)
    extent = lambda a: F.array(*[parts[n + a + i].cast("double") for i in range(dim)])
    return rows.select(*named, extent(0).alias("bbox_min"), extent(dim).alias("bbox_max"))
