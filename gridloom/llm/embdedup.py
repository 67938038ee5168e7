"""Near-duplicate vectors by collision-counting projections.

Vectors are compared when their labels (and lengths) are equal. Equal vectors
fold into one node with a multiplicity. A node is projected on ``PROJECTIONS``
random lines. Around each query's projection lies a window of half-width
``HALF_WIDTH``; a pair collides on a line when one lies in the other's window,
which sorted projections tell by rank. Pairs that collide on at least
``least_collisions`` lines are verified by cosine in double precision. That count
is set by recall: a pair at the threshold's angle reaches it but for one in a
million.

Counting all pairs would be quadratic, so pairs are counted where they meet in
at least one of ``TABLES`` coarse tables, each a cell of ``LINES`` randomly shifted
lines. A pair at the threshold shares no cell of any table with probability
1.6e-3, closer pairs less. A pair that meets in several tables is taken in the
first one only. Cells of more than ``TILE`` nodes are counted tile by tile, so no
cell is gathered in one task. What leaves a tile is a number of links and a root
a node, not pairs.

Vectors that are null, zero, or hold null or non-finite components, and those
with a null label, link with nothing. Rows with one vec_id count as one vector in
components. A null vec_id has no links: its component_id is null and it is kept.
An empty table gives an empty result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .shared import materialize, partitions

TABLES, LINES, CELL = 24, 7, 1.6
PROJECTIONS, HALF_WIDTH = 48, 0.75
MISS = 1e-6
TILE = 512
SEED = 7


@lru_cache
def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed, dim]).standard_normal((dim, count))


def least_collisions(cosine: float) -> int:
    """The largest count that a pair at this cosine reaches with probability 1 - ``MISS``."""
    distance = math.sqrt(max(2 - 2 * cosine, 1e-12))
    p = math.erf(HALF_WIDTH / distance / math.sqrt(2))
    below = 0.0
    for c in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, c) * p**c * (1 - p) ** (PROJECTIONS - c)
        if below > MISS:
            return c
    return PROJECTIONS


def units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squaring, against overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray) -> np.ndarray:
    """One 64-bit key a table for each row."""
    dim = x.shape[1]
    shift = np.random.default_rng([SEED, 3, dim]).uniform(0, CELL, TABLES * LINES)
    at = np.floor((x @ directions(dim, TABLES * LINES, 1) + shift) / CELL).astype(np.int64).reshape(len(x), TABLES, LINES)
    key = np.zeros((len(x), TABLES), dtype=np.uint64) + np.arange(1, TABLES + 1, dtype=np.uint64)
    for k in range(LINES):
        key = (key ^ at[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


#: Tiles with up to this many (pair, line) combinations are compared outright; sorting pays in larger ones.
OUTRIGHT = 1 << 19


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of projections a (points x lines) with projections b: on how many lines b's lies in the window around a's."""
    if len(a) * a.shape[1] * len(b) <= OUTRIGHT:
        return ((b[None, :, :] >= a[:, None, :] - HALF_WIDTH) & (b[None, :, :] <= a[:, None, :] + HALF_WIDTH)).sum(axis=2)
    order = np.argsort(b, axis=0)
    rank = np.empty(order.shape, dtype=np.int32)
    count = np.zeros((len(a), len(b)), dtype=np.int16)
    for k in range(a.shape[1]):
        rank[order[:, k], k] = np.arange(len(b))
        line = b[order[:, k], k]
        low, high = np.searchsorted(line, a[:, k] - HALF_WIDTH, "left"), np.searchsorted(line, a[:, k] + HALF_WIDTH, "right")
        count += (rank[None, :, k] >= low[:, None]) & (rank[None, :, k] < high[:, None])
    return count


def tile_links(ids, times, x, lines, keys, side, table: int, cosine: float, least: int) -> tuple[list, list, list]:
    """(node, links, root) of the nodes of one tile that have links first found in this table; side is 0 or 1 in a tile of two parts, else -1."""
    one, two = (np.arange(len(ids)),) * 2 if side[0] < 0 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(one) or not len(two):
        return [], [], []
    i, j = np.nonzero(collisions(lines[one], lines[two]) >= least)
    i, j = one[i], two[j]
    apart = ids[i] < ids[j] if side[0] < 0 else ids[i] != ids[j]
    i, j = i[apart], j[apart]
    sure = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
    if table:
        sure &= ~(keys[i, :table] == keys[j, :table]).any(axis=1)
    i, j = i[sure], j[sure]
    links = np.bincount(i, weights=times[j], minlength=len(ids)) + np.bincount(j, weights=times[i], minlength=len(ids))
    forest = Forest()
    for a, b in zip(ids[i].tolist(), ids[j].tolist()):
        forest.join(a, b)
    at = np.flatnonzero(links)
    return ids[at].tolist(), links[at].astype(np.int64).tolist(), [forest.find(v) for v in ids[at].tolist()]


def near_vectors(table: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    narrow = table.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind, width = ("<f4", 4) if narrow else ("<f8", 8)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # 0.0 and -0.0 are one value
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0).cast("float" if narrow else "double"))))
    rows = rows.withColumn("h1", F.xxhash64("v", "label")).withColumn("h2", F.xxhash64(F.lit(1), "v", "label"))
    nodes = rows.where("v is not null").groupBy("h1", "h2", "label").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"), F.first("v").alias("v"))
    nodes = materialize(nodes, "vectors")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch["v"]])
            raw = [np.asarray(v.values).astype(kind).tobytes() for v in batch["v"]]
            found = [None] * len(raw)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for i, k in zip(at.tolist(), cells(units([raw[i] for i in at], kind))):
                    found[i] = k.tolist()
            yield pa.RecordBatch.from_arrays([batch["node"], batch["times"], batch["label"], pa.array(raw, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["node", "times", "label", "v", "keys"])

    placed = nodes.select("node", "times", "label", "v").mapInArrow(place, "node long, times long, label string, v binary, keys array<long>")
    placed = materialize(placed, "placed-vectors")
    # members of cells with company; a large cell's members go to every pair of tiles that holds theirs
    members = placed.select("node", "label", F.length("v").alias("size"), F.posexplode("keys").alias("t", "key"))
    members = members.withColumn("cell", F.xxhash64("label", "size", "t", "key"))
    crowded = members.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.expr(f"int((n + {TILE - 1}) div {TILE})"))
    members = members.join(crowded.hint("merge"), "cell").withColumn("own", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("tiles")).cast("int"))
    members = members.select("node", "t", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    members = members.select("node", "t", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    full = members.hint("merge").join(placed.select("node", "times", "v", "keys"), "node")
    full = full.repartition(partitions(spark), "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    least = least_collisions(cosine)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_end(batches):
            now = rest if batch is None else pa.Table.from_batches([*rest.to_batches(), batch]).combine_chunks() if rest is not None else pa.Table.from_batches([batch])
            if now is None or not len(now):
                continue
            where = np.stack([now[c].to_numpy() for c in ("cell", "lo", "hi")])
            cuts = np.concatenate([[0], np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1, [len(now)]])
            if batch is not None:
                rest = now.slice(int(cuts[-2]))  # may go on in the next batch
                cuts = cuts[:-1]
            if len(cuts) < 2:
                continue
            ids, times, side, tables = (now[c].to_numpy() for c in ("node", "times", "side", "t"))
            raw, keys = now["v"].to_pylist(), now["keys"].combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
            out = [], [], []
            alike = len({len(r) for r in raw}) == 1
            x = units(raw, kind) if alike else None
            lines = x @ directions(x.shape[1], PROJECTIONS, 2) if alike else None
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a > 1:
                    own = x[a:b] if alike else units(raw[a:b], kind)
                    at = lines[a:b] if alike else own @ directions(own.shape[1], PROJECTIONS, 2)
                    for o, f in zip(out, tile_links(ids[a:b], times[a:b], own, at, keys[a:b], side[a:b], int(tables[a]), cosine, least)):
                        o.extend(f)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["node", "links", "root"])

    found = materialize(full.select("node", "times", "t", "cell", "lo", "hi", "side", "v", "keys").mapInArrow(count, "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # vectors that share an id are one in components
    named = rows.where("v is not null").select("vec_id", "h1", "h2", "label").join(nodes.select("h1", "h2", "label", "node"), ["h1", "h2", "label"])
    shared = named.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(shared))
    known = nodes.join(links, "node", "left").join(groups, "node", "left").select("h1", "h2", "label", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    keyed = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), "h2", "label").join(known, ["h1", "h2", "label"], "left")
    component = F.coalesce("component", "vec_id")
    return keyed.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
