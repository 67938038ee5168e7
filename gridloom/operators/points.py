"""Proximity queries over point sets: nearest neighbours, radius joins, pairs, pair counts.

A ``PointSet`` is a lazy DataFrame with an id, one double column an axis and, if
wanted, a weight. Nothing is indexed up front. Sets are joined tile by tile
(``tiles``), periodic ones too. Joins at radius 0 are equality joins on the coordinates, which Spark
shuffles, spills and splits under skew like any other join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import bin_index, box_of, squared_distance
from ..sources.tables import materialize
from . import tiles

#: Up to this many dimensions nearest neighbours are searched by tiles, above it by blocks.
MOST_GRID_DIM = 8
#: Bytes of coordinates that a broadcast block of queries may have.
BLOCK_BYTES = 16 << 20
#: Split nodes of a level up to which they are broadcast to the points; levels whose node numbers fit a long.
BROADCAST_NODES, MOST_LEVELS = 1 << 15, 62
#: Cells are wider than the radius by this share, so that rounding can't part neighbours.
SLACK = 1e-9


class PointSet:
    """Points ``id``, ``coords`` (column names, or one array column with ``dim`` entries), optional ``weight`` and periodic ``box``.

    Ids must be unique. Rows with a NULL or NaN coordinate match nothing. Further columns are dropped.
    """

    def __init__(self, df: DataFrame, id: str, coords: Sequence[str] | str, weight: str | None = None, periodic: float | Sequence[float | None] | None = None, dim: int | None = None, check: bool = True):
        if isinstance(coords, str):
            if not dim:
                raise ValueError("an array column needs dim")
            axes = [F.col(coords)[i] for i in range(dim)]
        else:
            axes = [F.col(c) for c in coords]
        if not axes:
            raise ValueError("points need at least one dimension")
        self.dim = len(axes)
        self.box = box_of(periodic, self.dim)
        self.weighted = weight is not None
        columns = [F.col(id).cast("long").alias("id"), *(a.cast("double").alias(f"x{i}") for i, a in enumerate(axes))]
        rows = df.select(*columns, *([F.col(weight).cast("double").alias("w")] if weight else []))
        self.df = rows.where(" and ".join(f"x{i} is not null and not isnan(x{i})" for i in range(self.dim)))
        if self.box and check:
            self._check_spread()

    @property
    def axes(self) -> list[str]:
        return [f"x{i}" for i in range(self.dim)]

    @cached_property
    def bounds(self) -> tuple[int, list[tuple[float, float]]]:
        """Number of points and (min, max) of each axis: one job, kept."""
        parts = [f(c).alias(f"{n}{c}") for c in self.axes for n, f in (("lo", F.min), ("hi", F.max))]
        r = self.df.agg(F.count("*").alias("n"), *parts).first()
        return r.n, [(r[f"lo{c}"], r[f"hi{c}"]) for c in self.axes] if r.n else [(0.0, 0.0)] * self.dim

    def _check_spread(self) -> None:
        _, bounds = self.bounds
        if any(s is not None and hi - lo > s for s, (lo, hi) in zip(self.box, bounds)):
            raise ValueError("points spread over more than the periodic box")

    def bbox(self) -> DataFrame:
        """One row an axis: axis, min, max, spread."""
        return self.df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).alias("x")) for i, c in enumerate(self.axes)])).alias("p")).groupBy("p.axis").agg(F.min("p.x").alias("min"), F.max("p.x").alias("max"), (F.max("p.x") - F.min("p.x")).alias("spread"))

    def _wrapped(self, other: PointSet) -> tuple[PointSet, PointSet]:
        """Both sets; wrapped into the box first if they lie too far apart for the shorter way round to be plain."""
        if self.dim != other.dim or self.box != other.box:
            raise ValueError("point sets differ in dimension or box")
        if not self.box:
            return self, other
        both = [[(min(a[0], b[0]), max(a[1], b[1])) for a, b in zip(self.bounds[1], other.bounds[1])]]
        if all(s is None or hi - lo <= s for s, (lo, hi) in zip(self.box, both[0])):
            return self, other
        return self._folded(), other._folded()

    def _folded(self) -> PointSet:
        out = PointSet.__new__(PointSet)
        out.dim, out.box, out.weighted = self.dim, self.box, self.weighted
        out.df = self.df.select("id", *(F.pmod(c, F.lit(s)).alias(c) if s is not None else F.col(c) for c, s in zip(self.axes, self.box)), *(["w"] if self.weighted else []))
        return out

    # --- grid ---------------------------------------------------------------------------------

    def _cells(self, width: float) -> DataFrame:
        """Adds cell columns c0.. of the given width."""
        width = width * (1 + SLACK)
        own = []
        for i, c in enumerate(self.axes):
            side = self.box[i] if self.box else None
            n = max(1, math.floor(side / width)) if side is not None else None
            cell = F.floor(F.col(c) / F.lit(side / n if n else width)).cast("long")
            own.append((F.pmod(cell, F.lit(n)) if n else cell).alias(f"c{i}"))
        return self.df.select("*", *own)

    def _equal(self, other: PointSet, keep: str) -> DataFrame:
        """Rows a_id, b_id, d2 (and a_w, b_w) of pairs at one place that fulfil ``keep``; ``self`` is a."""
        cells = [f"c{i}" for i in range(self.dim)]
        keys = [(F.pmod(c, F.lit(self.box[i])) if self.box and self.box[i] is not None else F.col(c) + 0.0).alias(f"c{i}") for i, c in enumerate(self.axes)]
        a, b = (p.df.select(*[F.col(c).alias(f"{side}_{c}") for c in ["id", *self.axes, *(["w"] if p.weighted else [])]], *keys) for p, side in ((self, "a"), (other, "b")))
        d2 = squared_distance([F.col(f"a_{c}") for c in self.axes], [F.col(f"b_{c}") for c in self.axes], self.box)
        return a.join(b.hint("merge"), cells).withColumn("d2", d2).where(keep)

    def _around(self, bounds: list[tuple[float, float]]) -> tiles.Around:
        """The box, and images wanted near the bounds."""
        return tiles.Around(self.box, bounds) if self.box else tiles.OPEN

    def _within(self, other: PointSet, r: float) -> DataFrame:
        """a_id, b_id, d2 of pairs within r."""
        if r == 0:
            return self._equal(other, "d2 <= 0")
        return tiles.pairs_within(self.df, other.df, self.axes, self.bounds[0], other.bounds[0], r, self._around(other.bounds[1]))

    # --- joins --------------------------------------------------------------------------------

    def radius(self, queries: PointSet, r: float) -> DataFrame:
        """query_id, id, distance of all points within r (inclusive) of each query."""
        if not r >= 0:
            raise ValueError("the radius must not be negative")
        points, queries = self._wrapped(queries)
        near = points._within(queries, r)
        return near.select(F.col("b_id").alias("query_id"), F.col("a_id").alias("id"), F.sqrt("d2").alias("distance"))

    def radius_lists(self, queries: PointSet, r: float) -> DataFrame:
        """query_id, neighbours: array of (distance, id), ascending; an empty array for a query without any."""
        lists = self.radius(queries, r).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("n"))
        empty = F.array().cast("array<struct<distance:double,id:bigint>>")
        return queries.df.select(F.col("id").alias("query_id")).join(lists, "query_id", "left").select("query_id", F.coalesce("n", empty).alias("neighbours"))

    def has_neighbour(self, queries: PointSet, r: float) -> DataFrame:
        """The queries (id) with at least one point within r."""
        near = self.radius(queries, r).select(F.col("query_id").alias("id"))
        return queries.df.select("id").join(near, "id", "left_semi")

    def pairs(self, r: float, other: PointSet | None = None) -> DataFrame:
        """i, j within r: unordered pairs of this set (i < j), or all pairs of this set and another."""
        if not r >= 0:
            raise ValueError("the radius must not be negative")
        if other is None and r > 0:
            return tiles.pairs_of_one(self.df, self.axes, self.bounds[0], r, self._around(self.bounds[1]))
        a, b = (self, None) if other is None else self._wrapped(other)
        near = a._within(b, r) if b else a._equal(a, "a_id < b_id and d2 <= 0")
        return near.select(F.col("a_id").alias("i"), F.col("b_id").alias("j"))

    def pairs_set(self, r: float, other: PointSet | None = None) -> set[tuple[int, int]]:
        """The pairs as a set on the driver; for few of them."""
        return {(x["i"], x["j"]) for x in self.pairs(r, other).toLocalIterator()}

    # --- nearest ------------------------------------------------------------------------------

    def nearest(self, queries: PointSet, k: int = 1) -> DataFrame:
        """query_id, rank (from 1), id, distance of each query's k nearest points (all, if fewer); ties by id."""
        if k < 1:
            raise ValueError("k must be positive")
        points, queries = self._wrapped(queries)
        if self.dim > MOST_GRID_DIM:
            found = points._nearest_by_blocks(queries, k)
        else:
            found = tiles.nearest(points.df, queries.df, self.axes, self.bounds[0], queries.bounds[0], k, self._around(points.bounds[1]))
        return found.select("query_id", "rank", "id", F.sqrt("d2").alias("distance"))

    def nearest_lists(self, queries: PointSet, k: int = 1) -> DataFrame:
        """query_id, neighbours: array of (distance, id), ascending."""
        return self.nearest(queries, k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("neighbours"))

    def _nearest_by_blocks(self, queries: PointSet, k: int) -> DataFrame:
        """Each partition of points finds its k nearest for a block of queries; the best k over all partitions remain.

        Blocks are ranges of queries' hashes of at most about ``BLOCK_BYTES``, collected and broadcast one at a time.
        """
        spark, dim, box, axes = self.df.sparkSession, self.dim, self.box, self.axes
        blocks = max(1, math.ceil(queries.bounds[0] * (dim + 1) * 8 / BLOCK_BYTES))
        out = None
        for b in range(blocks):
            rows = queries.df.select("id", *axes)
            block = (rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else rows).toPandas()
            shared = spark.sparkContext.broadcast((block["id"].to_numpy(), block[axes].to_numpy(dtype=np.float64)))

            def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q = shared.value
                for batch in batches:
                    own = batch["id"].to_numpy()
                    p = np.stack([batch[c].to_numpy() for c in axes], axis=1)
                    for at in range(0, len(ids), step := max(1, (1 << 21) // max(1, len(own)))):
                        d2 = np.zeros((min(step, len(ids) - at), len(own)))
                        for i in range(dim):  # axis by axis, as the column expression sums
                            d = q[at : at + step, i, None] - p[None, :, i]
                            if box and box[i] is not None:
                                d = np.abs(d)
                                d = np.where(d > box[i] / 2, box[i] - d, d)
                            d2 += d * d
                        most = min(k, len(own))
                        worst = np.partition(d2, most - 1, axis=1)[:, most - 1]
                        r, c = np.nonzero(d2 <= worst[:, None])
                        order = np.lexsort((own[c], d2[r, c], r))
                        r, c = r[order], c[order]
                        first = np.searchsorted(r, r)
                        keep = np.arange(len(r)) - first < most
                        r, c = r[keep], c[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + r]), pa.array(own[c]), pa.array(d2[r, c])], names=["query_id", "id", "d2"])

            part = self.df.select("id", *axes).mapInArrow(nearest, "query_id long, id long, d2 double")
            out = part if out is None else out.union(part)
        best = Window.partitionBy("query_id").orderBy("d2", "id")
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # --- counts -------------------------------------------------------------------------------

    def counts(self, radii: float | Sequence[float], other: PointSet | None = None, cumulative: bool = True) -> DataFrame:
        """k, radius, count of pairs up to each radius, or in the shell below it (behind the next smaller one); in the given order."""
        return self._histogram(radii, other, cumulative, "n", F.count("*"), F.lit(0).cast("long"))

    def counts_weighted(self, radii: float | Sequence[float], other: PointSet | None = None, cumulative: bool = True) -> DataFrame:
        """k, radius, count: as counts, but the sum of the pairs' weight products."""
        if not self.weighted or (other is not None and not other.weighted):
            raise ValueError("every point set needs a weight")
        return self._histogram(radii, other, cumulative, "w", F.sum(F.col("a_w") * F.col("b_w")), F.lit(0.0))

    def _histogram(self, radii: float | Sequence[float], other: PointSet | None, cumulative: bool, kind: str, total: Column, zero: Column) -> DataFrame:
        given = [float(r) for r in ([radii] if isinstance(radii, (int, float)) else radii)]
        if not given or not all(r >= 0 for r in given):
            raise ValueError("radii must be given and not negative")
        order = sorted(range(len(given)), key=lambda i: given[i])
        ascending = [given[i] for i in order]
        widest = ascending[-1]
        a, b = (self, None) if other is None else self._wrapped(other)
        if widest == 0:
            near = a._equal(b or a, "d2 <= 0" if b else "a_id < b_id and d2 <= 0")
            # through a generator, or each branch of the bins would compute the distance anew
            near = near.withColumn("d2", F.explode(F.array("d2")))
            binned = near.withColumn("bin", bin_index(F.col("d2"), ascending)).where("bin is not null").groupBy("bin").agg(total.alias("n"))
        else:
            binned = tiles.binned_within(a.df, b.df if b else None, self.axes, a.bounds[0], (b or a).bounds[0], ascending, a._around((b or a).bounds[1])).select("bin", F.col(kind).alias("n"))
        rows = self.df.sparkSession.createDataFrame([(k, i, given[i]) for k, i in enumerate(order)], "bin int, k int, radius double")
        found = rows.join(binned, "bin", "left").withColumn("n", F.coalesce("n", zero))
        if cumulative:  # a row a radius
            found = found.withColumn("n", F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        return found.select("k", "radius", F.col("n").alias("count"))

    # --- statistics ---------------------------------------------------------------------------

    def stats(self, width: float) -> DataFrame:
        """One row a grid cell: its place, num and the extent of its points."""
        axes = list(range(self.dim))
        cells = self._cells(width)
        extent = [f(c).alias(f"{n}_{i}") for i, c in enumerate(self.axes) for n, f in (("min", F.min), ("max", F.max))]
        return cells.groupBy(*[f"c{i}" for i in axes]).agg(F.count("*").alias("num"), *extent)

    def kd_nodes(self, leaf_size: int = 16, max_depth: int | None = None) -> DataFrame:
        """A tree of nodes as a table: idx, num, axis, value, left, right, beg, end, depth, bbox_min, bbox_max.

        Nodes split at the (approximate) median of their widest axis, level by level, until each has at most ``leaf_size``
        points or no extent; ``max_depth`` ends that earlier. Points at the median go left, unless it is the node's upper
        end: then they go right. Each level is one aggregation over the points of nodes that were split, and a
        written table; no node reaches the driver. A leaf has axis and children -1.
        """
        axes = range(self.dim)
        df = self.df.select(*self.axes, F.lit(0).cast("long").alias("node"))
        extent = [F.array(*[f(c) for c in self.axes]).alias(n) for n, f in (("bbox_min", F.min), ("bbox_max", F.max))]
        middle = F.array(*[F.percentile_approx(c, 0.5, 10000) for c in self.axes]).alias("middle")
        spread, nowhere = F.array(*[F.col("bbox_max")[i] - F.col("bbox_min")[i] for i in axes]), F.lit(-1).cast("long")
        parents, out, depth = None, None, 0
        while True:
            level = df.groupBy("node").agg(F.count("*").alias("num"), *extent, middle).withColumn("wide", F.array_position(spread, F.array_max(spread)).cast("int"))
            split = (F.col("num") > leaf_size) & (F.element_at(spread, F.col("wide")) > 0) & F.lit(max_depth is None or depth < max_depth)
            level = level.withColumn("split", F.coalesce(split, F.lit(False)))
            if parents is None:
                level = level.withColumn("beg", F.lit(0).cast("long"))
            else:  # a right child ends where its parent does
                level = level.join(parents.select(F.col("node").alias("parent"), F.col("beg").alias("from"), (F.col("beg") + F.col("num")).alias("to")), F.expr("(node - 1) div 2") == F.col("parent"))
                level = level.withColumn("beg", F.when(F.col("node") % 2 == 1, F.col("from")).otherwise(F.col("to") - F.col("num"))).drop("parent", "from", "to")
            level = materialize(level)
            idx = F.col("node")
            rows = level.select(
                idx.alias("idx"), "num", F.when(F.col("split"), F.col("wide") - 1).otherwise(-1).alias("axis"), F.when(F.col("split"), F.element_at("middle", F.col("wide"))).otherwise(0.0).alias("value"),
                F.when(F.col("split"), 2 * idx + 1).otherwise(nowhere).alias("left"), F.when(F.col("split"), 2 * idx + 2).otherwise(nowhere).alias("right"),
                "beg", (F.col("beg") + F.col("num")).alias("end"), F.lit(depth).alias("depth"), "bbox_min", "bbox_max",
            )
            out = rows if out is None else out.union(rows)
            parents = level.where("split")
            many = parents.count()
            if not many:
                return out.orderBy("idx")
            if depth >= MOST_LEVELS:
                raise ValueError(f"a tree of more than {MOST_LEVELS} levels; node numbers would not fit a long")
            cuts = parents.select("node", "wide", F.element_at("middle", F.col("wide")).alias("value"), F.element_at("bbox_max", F.col("wide")).alias("top"))
            at = F.element_at(F.array(*self.axes), F.col("wide"))
            left = (at <= F.col("value")) & (at < F.col("top"))
            df = df.join(F.broadcast(cuts) if many <= BROADCAST_NODES else cuts, "node").withColumn("node", 2 * F.col("node") + F.when(left, 1).otherwise(2))
            df = materialize(df.select(*self.axes, "node"))
            depth += 1

    def unpersist(self) -> None:
        self.df.unpersist()

    def __enter__(self) -> PointSet:
        self.df = self.df.persist()
        return self

    def __exit__(self, *_) -> None:
        self.unpersist()
