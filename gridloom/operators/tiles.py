"""Joins of points within a radius and of nearest points, tile by tile.

A k-d tree over a bounded sample of the points splits space into tiles of about
equally many points, however they cluster. The tree (a few numbers a tile) goes to all
workers. Rows are shuffled once, to their tile; for joins within a radius points near a border go
to the tiles across it as well, so every tile finds the pairs of its own queries
alone. Nearest points are searched in the query's own tile first; a query whose k-th
distance reaches over a border asks the tiles there, within that distance. Inside a tile numpy works on
sorted cells (radius) or on a small tree (nearest). Equal points of a tile are searched once, as one place.
In a periodic box points near its border (for nearest points: queries) also go, moved by the box, to the other end; a pair
is taken from the image that is the shorter way round, and from no other. Tiles with very many queries are searched in
several tasks, each with a share of the queries, and so are the points of a join within a radius.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import Box
from ..sources.tables import materialize

#: Points of the sample on the driver, points of a tile, tiles, and rows of either side that one task takes.
SAMPLE, TILE, MOST_TILES, MOST_ROWS = 1 << 18, 1 << 16, 1 << 16, 1 << 20
#: Points of a node of the tree inside a tile; pairs that are looked at together.
NODE, PAIRS = 512, 1 << 20
#: Rows of either place that go out together; Spark makes the pairs of such lists, LIST * LIST at a time.
LIST = 128
#: Where points meet themselves: ids of neighbours that repeat together, a multiple of 8 as Parquet packs them, and pairs of a batch.
RUN, BATCH = 256, 1 << 17
SLACK = 1e-9


class Around:
    """A periodic box (or none, then one image), and the bounds outside which no image is wanted."""

    def __init__(self, box: Box, bounds: Sequence[tuple[float, float]]):
        self.box = box
        self.low, self.high = np.array(bounds, dtype=np.float64).T if bounds else (None, None)
        sides = box or [None] * len(bounds)
        self.shifts = np.array(list(itertools.product(*[(0,) if s is None else (0, -1, 1) for s in sides])), dtype=np.int64)
        self.sides = np.array([0.0 if s is None else s for s in sides])
        #: rounding of moved coordinates
        self.pad = 8 * np.finfo(float).eps * float(max(np.abs(self.low).max(), np.abs(self.high).max()) + self.sides.max()) if box else 0.0

    def images(self, x: np.ndarray, r: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(image, rows, moved rows) of the images that come within r of the bounds; image 0 is the row itself, of all rows."""
        yield 0, np.arange(len(x)), x
        for k, shift in enumerate(self.shifts[1:], 1):
            moved, reach = x + shift * self.sides, (r * (1 + SLACK) + self.pad)[:, None]
            rows = np.flatnonzero(((moved >= self.low - reach) & (moved <= self.high + reach)).all(1))
            yield k, rows, moved[rows]

    def moved(self, x: np.ndarray, image: np.ndarray) -> np.ndarray:
        return x + self.shifts[image] * self.sides

    def squared(self, still: np.ndarray, moving: np.ndarray, image: np.ndarray | None) -> np.ndarray:
        """Squared distances the shorter way round, as the column expression gives them; infinite for an image that is not that way."""
        if not self.box:
            return squared_distances(still, moving)
        total = np.zeros(np.broadcast_shapes(still.shape, moving.shape)[:-1])
        for k, side in enumerate(self.box):
            d = still[..., k] - moving[..., k]
            if side is not None:
                far = np.abs(d) > side / 2
                total = np.where(self.shifts[image, k] == np.where(far, np.sign(d), 0), total, np.inf)
                d = np.where(far, side - np.abs(d), d)
            total = total + d * d
        return total


OPEN = Around(None, [])


class Tree:
    """Splits: points with x[axis] <= value lie on the left. Leaves (axis -1) are numbered in ``leaf``."""

    def __init__(self, x: np.ndarray, most: int):
        self.axis, self.value, self.left, self.right, self.leaf, self.rows = [], [], [], [], [], []
        todo = [(np.arange(len(x)), -1, False)]
        while todo:
            rows, parent, on_right = todo.pop()
            node = len(self.axis)
            if parent >= 0:
                (self.right if on_right else self.left)[parent] = node
            own = x[rows]
            spread = own.max(0) - own.min(0) if len(rows) else np.zeros(x.shape[1])
            k = int(np.argmax(spread))
            inner = len(rows) > most and spread[k] > 0
            value = 0.0
            if inner:
                line = own[:, k]
                value = float(np.partition(line, (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
                if value == line.max():
                    value = float(line[line < value].max())
            for to, what in ((self.axis, k if inner else -1), (self.value, value), (self.left, -1), (self.right, -1), (self.leaf, -1 if inner else len(self.rows))):
                to.append(what)
            if inner:
                low = line <= value
                todo += [(rows[low], node, False), (rows[~low], node, True)]
            else:
                self.rows.append(rows)
        self.axis, self.left, self.right, self.leaf = (np.array(a, dtype=np.int64) for a in (self.axis, self.left, self.right, self.leaf))
        self.value = np.array(self.value)
        self.leaves = len(self.rows)

    def without_rows(self) -> Tree:
        self.rows = []
        return self

    def own(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(x), dtype=np.int64)
        while len(go := np.flatnonzero(self.axis[at] >= 0)):
            node = at[go]
            at[go] = np.where(x[go, self.axis[node]] <= self.value[node], self.left[node], self.right[node])
        return self.leaf[at]

    def reached(self, x: np.ndarray, r: np.ndarray, pad: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves that the cube of half-width r around each point meets."""
        r = r * (1 + SLACK) + pad
        who, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        found = [(who[:0], self.leaf[:0])]
        while len(who):
            end = self.axis[at] < 0
            found.append((who[end], self.leaf[at[end]]))
            who, at = who[~end], at[~end]
            line, value = x[who, self.axis[at]], self.value[at]
            low, high = line - r[who] <= value, line + r[who] >= value
            who, at = np.concatenate([who[low], who[high]]), np.concatenate([self.left[at[low]], self.right[at[high]]])
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _sample(df: DataFrame, axes: list[str], n: int) -> np.ndarray:
    """Coordinates of at most about ``SAMPLE`` rows, drawn by the hash of their id."""
    share = min(1.0, SAMPLE / max(n, 1))
    rows = df if share == 1 else df.where(F.pmod(F.xxhash64(F.lit("tiles"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return rows.select(*axes).toPandas().to_numpy(dtype=np.float64).reshape(-1, len(axes))


class Plan:
    """The tree of tiles, and which tiles are crowded, both told by samples of the two sides (of one, when points are their own queries)."""

    def __init__(self, points: DataFrame, queries: DataFrame | None, axes: list[str], n: int, m: int, tile: int):
        x = _sample(points, axes, n)
        self.tree = Tree(x, max(1, math.ceil(len(x) / max(1, min(MOST_TILES, math.ceil(n / tile)))))).without_rows()
        own = np.bincount(self.tree.own(x), minlength=self.tree.leaves) * max(1.0, n / max(len(x), 1))
        y = _sample(queries, axes, m) if queries is not None else x
        asked = np.bincount(self.tree.own(y), minlength=self.tree.leaves) * max(1.0, m / max(len(y), 1)) if queries is not None else own
        self.points, self.queries = (np.ceil(c / MOST_ROWS).astype(int).clip(1) for c in (own, asked))

    def shares(self, rows: DataFrame, queries: str, points: str, whole: bool = False) -> DataFrame:
        """Rows with the shares of their tile's queries (q) and points (p) that a task takes: one each, but for crowded tiles; points may have to stay whole.

        ``queries`` and ``points`` tell which rows are which; a row that is both goes as either.
        """
        np_ = np.ones_like(self.points) if whole else self.points
        return _dealt(rows, [(int(t), int(self.queries[t]), int(np_[t])) for t in np.flatnonzero((self.queries > 1) | (np_ > 1))], queries, points)

    @property
    def tasks(self) -> int:
        """Bound of the task numbers that ``shares`` gives, of points that need not stay whole."""
        many = self.queries * self.points
        return self.tree.leaves + int(many[many > 1].sum())


def _dealt(rows: DataFrame, crowded: list[tuple[int, int, int]], queries: str, points: str) -> DataFrame:
    """Rows with q, p, role and a task number for each tile and share: first those of crowded tiles, then the other tiles."""
    if not crowded:
        return rows.select("*", F.lit(0).alias("q"), F.lit(0).alias("p"), F.lit(None).cast("int").alias("role"), F.col("tile").cast("int").alias("task"))
    ends = list(itertools.accumulate(nq * np_ for _, nq, np_ in crowded))
    table = rows.sparkSession.createDataFrame([(t, nq, np_, end - nq * np_) for (t, nq, np_), end in zip(crowded, ends)], "tile long, nq int, np int, first int")
    rows = rows.join(F.broadcast(table), "tile", "left").na.fill(1, ["nq", "np"])  # a row a crowded tile, MOST_TILES at most
    rows = rows.withColumn("role", F.explode(F.filter(F.array(F.when(F.expr(queries), 0), F.when(F.expr(points), 1)), lambda x: x.isNotNull())))
    place = lambda n: F.pmod(F.xxhash64(F.lit("share"), "id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("q", F.explode(F.when(F.col("role") == 0, F.array(place("nq"))).otherwise(every("nq"))))
    rows = rows.withColumn("p", F.explode(F.when(F.col("role") == 1, F.array(place("np"))).otherwise(every("np"))))
    task = F.coalesce(F.col("first") + F.col("q") * F.col("np") + F.col("p"), F.col("tile") + ends[-1]).cast("int")
    return rows.withColumn("task", task).drop("nq", "np", "first")


def _coordinates(rows, axes: list[str]) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in axes], axis=1) if len(rows) else np.zeros((0, len(axes)))


def _weights(rows, name: str = "w") -> np.ndarray | None:
    """NULL adds nothing to a sum."""
    return rows[name].fill_null(0.0).to_numpy() if name in rows.schema.names else None


def _placed(df: DataFrame, axes: list[str], tree: Tree, side: int, r: float | None = None, around: Around = OPEN) -> DataFrame:
    """df with its tile, side and image; with a radius a row for each tile that an image reaches, marked as its own or not."""
    shared = df.sparkSession.sparkContext.broadcast((tree, around))  # MOST_TILES leaves at most
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, around = shared.value
        for batch in batches:
            x = _coordinates(batch, axes)
            own = tree.own(x)
            if r is None:
                found = [(np.arange(len(x)), own, np.zeros(len(x), dtype=np.int32))]
            else:
                found = []
                for image, rows, moved in around.images(x, np.full(len(x), r)):
                    who, tile = tree.reached(moved, np.full(len(moved), r), around.pad)
                    found.append((rows[who], tile, np.full(len(who), image, dtype=np.int32)))
            who, tile, image = (np.concatenate(c) for c in zip(*found))
            at = pa.array(who)
            columns = [batch[c].take(at) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tile), pa.array(np.full(len(who), side, dtype=np.int32)), pa.array(image), pa.array((own[who] == tile) & (image == 0))], names=[*names, "tile", "side", "image", "own"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, tile long, side int, image int, own boolean")


def _sides(rows: pa.Table, queries: Callable, points: Callable) -> tuple[pa.Table, pa.Table]:
    if rows["role"].null_count == len(rows):
        return rows.filter(pa.array(queries(rows))), rows.filter(pa.array(points(rows)))
    role = rows["role"].to_numpy()
    return rows.filter(pa.array(role == 0)), rows.filter(pa.array(role == 1))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed from the first axis to the last, as the column expression sums."""
    total = None
    for k in range(a.shape[-1]):
        d = a[..., k] - b[..., k]
        total = d * d if total is None else total + d * d
    return total


class Places:
    """The different (place, image) of rows; ``rows`` by place and id, those of place k from ``start[k]`` to ``start[k + 1]``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, image: np.ndarray):
        x = x + 0.0  # no negative zeros
        order = np.lexsort([ids, image, *x.T[::-1]])
        x, image = x[order], image[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]).any(1) | (image[1:] != image[:-1])
        self.rows, self.start = order, np.append(np.flatnonzero(new), len(x))
        self.x, self.image, self.size = x[new], image[new], np.diff(self.start)

    def members(self, k: int) -> np.ndarray:
        return self.rows[self.start[k] : self.start[k + 1]]


def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0, 1: rows of a before, at, behind those of b, by the first axis on which they differ."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(a.shape[1] - 1, -1, -1):
        out = np.where(a[:, k] == b[:, k], out, np.sign(a[:, k] - b[:, k])).astype(np.int64)
    return out


def neighbours(q: np.ndarray, p: np.ndarray, r: float, around: Around = OPEN, image: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, squared distance) of all pairs within r, a bounded number at a time; in a periodic box p are the points before their images move them."""
    if not len(q) or not len(p):
        return
    still, p = p, around.moved(p, image) if around.box else p
    reach = r * (1 + SLACK) + around.pad
    low = np.minimum(q.min(0), p.min(0))
    spread = np.maximum(q.max(0), p.max(0)) - low
    axes = sorted(np.argsort(-spread, kind="stable")[:3].tolist())
    width = np.maximum(reach, spread[axes] / (1 << 19)) if len(axes) > 1 else np.array([max(reach, spread[axes[0]] / (1 << 40))])
    width = np.where(width > 0, width, 1.0)
    cells = [np.floor((x[:, axes] - low[axes]) / width).astype(np.int64) + 1 for x in (q, p)]
    radix = np.maximum(cells[0].max(0), cells[1].max(0)) + 2
    weight = np.array([math.prod(radix[k + 1 :].tolist()) for k in range(len(axes))], dtype=np.int64)
    key_q, key_p = cells[0] @ weight, cells[1] @ weight
    by_q, by_p = np.argsort(key_q, kind="stable"), np.argsort(key_p, kind="stable")
    key_q, key_p, sq, sp = key_q[by_q], key_p[by_p], q[by_q], still[by_p]
    si = image[by_p] if around.box else None
    moves = np.array([0])
    for k in range(len(axes) - 1):
        moves = (moves[:, None] + np.array([-1, 0, 1]) * weight[k]).ravel()
    for move in moves.tolist():
        start, end = np.searchsorted(key_p, key_q + (move - 1), "left"), np.searchsorted(key_p, key_q + (move + 1), "right")
        some = np.flatnonzero(end > start)
        size = (end - start)[some]
        total = np.cumsum(size)
        a = 0
        while a < len(some):
            before = int(total[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(total, before + PAIRS, "right")))
            for lo in range(0, int(size[a]) if b == a + 1 else 1, PAIRS):  # one query alone may have more
                n = np.minimum(size[a:b] - lo, PAIRS) if b == a + 1 else size[a:b]
                i = np.repeat(some[a:b], n)
                j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[some[a:b]] + lo, n)
                d2 = around.squared(sq[i], sp[j], si[j] if around.box else None)
                near = np.flatnonzero(d2 <= r * r)
                if len(near):
                    yield by_q[i[near]], by_p[j[near]], d2[near]
            a = b


def _within(points: DataFrame, queries: DataFrame | None, axes: list[str], n: int, m: int, r: float, around: Around, tile: int) -> tuple[DataFrame, int, Callable, Callable]:
    """Rows dealt to tiles, the number of tasks, and what tells queries and points of a tile; without queries the points are their own."""
    plan = Plan(points, queries, axes, n, m, tile)
    rows = _placed(points, axes, plan.tree, 0, r, around)
    if queries is not None:
        rows = rows.unionByName(_placed(queries, axes, plan.tree, 1), allowMissingColumns=True)
        return plan.shares(rows, "side = 1", "side = 0"), plan.tasks, (lambda t: t["side"].to_numpy() == 1), (lambda t: t["side"].to_numpy() == 0)
    return plan.shares(rows, "own", "true"), plan.tasks, (lambda t: t["own"].to_numpy(zero_copy_only=False)), (lambda t: np.ones(len(t), dtype=bool))


def _places(rows: pa.Table, axes: list[str]) -> Places:
    return Places(_coordinates(rows, axes), rows["id"].to_numpy(), rows["image"].to_numpy())


def _listed(i: np.ndarray, j: np.ndarray, d2: np.ndarray, a: Places, b: Places, a_ids: np.ndarray, b_ids: np.ndarray) -> Iterator[tuple[pa.ListArray, pa.ListArray, np.ndarray]]:
    """(ids of a, ids of b, squared distance) of pairs of places (i, j), whose rows all meet; a bounded number of ids at a time, at most ``LIST`` in a list."""
    a_ids, b_ids = a_ids[a.rows], b_ids[b.rows]
    na, nb = -(-a.size[i] // LIST), -(-b.size[j] // LIST)
    first = np.concatenate([[0], np.cumsum(na * nb)])
    for lo in range(0, int(first[-1]), step := PAIRS // LIST):
        hi = min(lo + step, int(first[-1]))
        k0, k1 = int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi, "left"))
        n = np.minimum(first[k0 + 1 : k1 + 1], hi) - np.maximum(first[k0:k1], lo)
        k = np.repeat(np.arange(k0, k1), n)
        x, y = np.divmod(np.arange(lo, hi) - first[k], nb[k])
        yield _lists(a_ids, a.start, i[k], x), _lists(b_ids, b.start, j[k], y), d2[k]


def _lists(ids: np.ndarray, start: np.ndarray, place: np.ndarray, part: np.ndarray) -> pa.ListArray:
    """The part-th ``LIST`` ids of each place."""
    begin = start[place] + part * LIST
    n = np.minimum(start[place + 1] - begin, LIST)
    ends = np.cumsum(n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids[np.arange(int(ends[-1])) + np.repeat(begin - ends + n, n)]))


def _numbered(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place within k) of n[k] items for each k."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)


def pairs_within(points: DataFrame, queries: DataFrame, axes: list[str], n: int, m: int, r: float, around: Around = OPEN) -> DataFrame:
    """(a_id, b_id, d2) of points and queries within r.

    Python gives pairs of places with the ids at each, and Spark makes their rows. A tile (of a crowded one a share)
    is a partition of its own there: a file has the ids of half a tile's points and of those around it, which
    Parquet's dictionaries (1 MB a column) hold; beyond that ids are written in full, which takes several times the disk.
    """
    rows, tasks, is_query, is_point = _within(points.select("id", *axes), queries.select("id", *axes), axes, n, m, r, around, max(1, TILE // 2))

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        q, p = _sides(table, is_query, is_point)
        at, to = _places(q, axes), _places(p, axes)
        qid, pid = q["id"].to_numpy(), p["id"].to_numpy()
        for i, j, d2 in neighbours(at.x, to.x, r, around, to.image):
            for b, a, far in _listed(i, j, d2, at, to, qid, pid):
                yield pa.RecordBatch.from_arrays([a, b, pa.array(far)], names=["a_ids", "b_ids", "d2"])

    lists = rows.repartitionById(tasks, "task").groupBy("task").applyInArrow(_streamed(run), "a_ids array<long>, b_ids array<long>, d2 double")
    return lists.select("a_ids", F.explode("b_ids").alias("b_id"), "d2").select(F.explode("a_ids").alias("a_id"), "b_id", "d2")


def pairs_of_one(points: DataFrame, axes: list[str], n: int, r: float, around: Around = OPEN) -> DataFrame:
    """(i, j), i < j: the unordered pairs of points within r, each point with those of smaller ids.

    A place's neighbours are sorted by id and cut into runs of ``RUN``; a run goes out with all ids of the place above it, so both
    columns repeat in ways that compress. Tiles are small, as the ids of a tile and of those around it should fit a dictionary.
    """
    rows, tasks, is_query, is_point = _within(points.select("id", *axes), None, axes, n, n, r, around, max(1, TILE // 4))

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        q, p = _sides(table, is_query, is_point)
        at, to = _places(q, axes), _places(p, axes)
        ids, rank = np.unique(np.concatenate([q["id"].to_numpy(), p["id"].to_numpy()]), return_inverse=True)
        own, all_ = rank[: len(q)][at.rows] + np.repeat(np.arange(len(at.size)), at.size) * len(ids), rank[len(q) :][to.rows]
        high = q["id"].to_numpy()[at.rows]
        for i, j, _ in neighbours(at.x, to.x, r, around, to.image):
            for key in _members(i, j, to, all_, len(ids)):
                low = ids[key % len(ids)]
                for x, y in _met(*_below(key, own, at, len(ids))):
                    yield pa.RecordBatch.from_arrays([pa.array(low[x]), pa.array(high[y])], names=["i", "j"])

    return rows.repartitionById(tasks, "task").groupBy("task").applyInArrow(_streamed(run), "i long not null, j long not null")


def _members(i: np.ndarray, j: np.ndarray, to: Places, rank: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Of pairs of places (i, j) the keys i * n + rank of j's rows, a bounded number of them at a time, sorted."""
    first = np.concatenate([[0], np.cumsum(to.size[j])])
    for lo in range(0, int(first[-1]), PAIRS):
        hi = min(lo + PAIRS, int(first[-1]))
        k0, k1 = int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi, "left"))
        k = np.repeat(np.arange(k0, k1), np.minimum(first[k0 + 1 : k1 + 1], hi) - np.maximum(first[k0:k1], lo))
        yield np.sort(i[k] * n + rank[to.start[j[k]] + np.arange(lo, hi) - first[k]])


def _below(key: np.ndarray, own: np.ndarray, at: Places, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of sorted keys of neighbours, and of the keys of the places' own rows, that all meet with the neighbour below: first whole runs, then what is left of a run, an own row at a time."""
    start = np.append(0, np.flatnonzero(np.diff(key // n)) + 1)
    size = np.diff(np.append(start, len(key)))
    g, c = _numbered(-(-size // RUN))
    a0 = start[g] + c * RUN
    a1 = np.minimum(a0 + RUN, (start + size)[g])
    some, whole, end = np.searchsorted(own, key[a0], "right"), np.searchsorted(own, key[a1 - 1], "right"), at.start[key[a0] // n + 1]
    k = np.flatnonzero(whole < end)
    m, c = _numbered(whole - some)
    one = some[m] + c
    return tuple(np.concatenate(x) for x in ((a0[k], a0[m]), (a1[k], np.searchsorted(key, own[one])), (whole[k], one), (end[k], one + 1)))


def _met(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of all items of each pair of ranges, for each b the run of a, a bounded number at a time."""
    k, c = _numbered(b1 - b0)
    n, a, b = (a1 - a0)[k], a0[k], b0[k] + c
    total = np.cumsum(n)
    lo = 0
    while lo < len(total):
        before = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + BATCH, "right")))
        end = total[lo:hi] - before
        yield np.arange(int(end[-1])) + np.repeat(a[lo:hi] - end + n[lo:hi], n[lo:hi]), np.repeat(b[lo:hi], n[lo:hi])
        lo = hi


def binned_within(points: DataFrame, queries: DataFrame | None, axes: list[str], n: int, m: int, radii: list[float], around: Around = OPEN) -> DataFrame:
    """(bin, n, w): pairs, and sums of their weights' products, by the first of the ascending radii that reaches them; no pair becomes a row.

    Pairs of places count as many times as their rows meet. Of points with themselves, the place before another is its
    point and the other its query; in one place a row meets those of smaller ids.
    """
    rows, _, is_query, is_point = _within(points, queries, axes, n, m, radii[-1], around, TILE)
    alone, squares = queries is None, np.array([r * r for r in radii])

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        q, p = _sides(table, is_query, is_point)
        at, to = _places(q, axes), _places(p, axes)
        qid, pid, wq, wp = q["id"].to_numpy(), p["id"].to_numpy(), _weights(q), _weights(p)
        weighted = wq is not None and wp is not None
        sums = [np.add.reduceat(w[x.rows], x.start[:-1]) for w, x in ((wq, at), (wp, to))] if weighted and len(wq) and len(wp) else None
        count, weight = np.zeros(len(squares), dtype=np.int64), np.zeros(len(squares))
        for i, j, d2 in neighbours(at.x, to.x, radii[-1], around, to.image):
            if alone:
                order = before(to.x[j], at.x[i])
                for x, y in zip(i[order == 0], j[order == 0]):  # a place with itself
                    mine, theirs = at.members(x), to.members(y)
                    less = np.searchsorted(pid[theirs], qid[mine])
                    count[0] += int(less.sum())
                    if weighted:
                        weight[0] += float((wq[mine] * np.concatenate([[0.0], np.cumsum(wp[theirs])])[less]).sum())
                i, j, d2 = (c[order < 0] for c in (i, j, d2))
            bins = np.searchsorted(squares, d2, "left")
            met = at.size[i] * to.size[j]
            if len(met) and float(met.max()) * len(met) < 1 << 53:
                count += np.bincount(bins, weights=met, minlength=len(squares)).astype(np.int64)
            else:
                np.add.at(count, bins, met)
            if weighted:
                weight += np.bincount(bins, weights=sums[1][j] * sums[0][i], minlength=len(squares))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(squares), dtype=np.int32)), pa.array(count), pa.array(weight)], names=["bin", "n", "w"])

    found = rows.groupBy("tile", "q", "p").applyInArrow(_streamed(run), "bin int, n long, w double")
    return found.where("n > 0").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def _streamed(run: Callable):
    """As a function of a group's batches that yields batches as they are found."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.Table.from_batches(list(batches)))

    return whole


# --- nearest -------------------------------------------------------------------------------------


def nearest_of(ids: np.ndarray, p: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None = None, around: Around = OPEN, image: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, squared distance) of the k nearest points of each query, sorted by query, distance and id; with a bound none beyond it. In a periodic box q are the queries before their images move them."""
    out: list[tuple] = []
    if not len(p) or not len(q):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    tree = Tree(p, max(NODE, 2 * k))
    place = q if image is None else around.moved(q, image)
    if bound is None:
        bound = np.full(len(q), np.inf)
        own = tree.own(q)
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(tree.leaves + 1))
        for leaf, rows in enumerate(tree.rows):  # the query's own node bounds its search
            if len(rows) < k:
                continue
            asked = order[cuts[leaf] : cuts[leaf + 1]]
            for a in range(0, len(asked), step := max(1, PAIRS // len(rows))):
                some = asked[a : a + step]
                bound[some] = np.partition(squared_distances(q[some][:, None, :], p[rows][None, :, :]), k - 1, axis=1)[:, k - 1]
    who, leaf = tree.reached(place, np.sqrt(bound), around.pad)
    order = np.argsort(leaf, kind="stable")
    who, leaf = who[order], leaf[order]
    cuts = np.searchsorted(leaf, np.arange(tree.leaves + 1))
    for at, rows in enumerate(tree.rows):
        asked = who[cuts[at] : cuts[at + 1]]
        for b in range(0, len(rows), PAIRS):  # equal points can make a node of any size
            part = rows[b : b + PAIRS]
            for a in range(0, len(asked), step := max(1, PAIRS // len(part))):
                some = asked[a : a + step]
                if image is None:
                    d2 = squared_distances(q[some][:, None, :], p[part][None, :, :])
                else:
                    d2 = around.squared(p[part][None, :, :], q[some][:, None, :], image[some][:, None])
                i, j = np.nonzero((d2 <= bound[some][:, None]) & (d2 < np.inf))
                out.append((some[i], ids[part[j]], d2[i, j]))
    who, found, d2 = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, dtype=t) for c, t in enumerate((np.int64, np.int64, np.float64)))
    order = np.lexsort((found, d2, who))
    who, found, d2 = who[order], found[order], d2[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], found[keep], d2[keep]


FOUND = "query_id long, rank int, id long, d2 double, open boolean, tile long, image int, bound double"


def nearest(points: DataFrame, queries: DataFrame, axes: list[str], n: int, m: int, k: int, around: Around = OPEN) -> DataFrame:
    """(query_id, rank, id, d2) of the k nearest points of each query; ties by id.

    In a periodic box the plain distances of the query's own tile bound its search; images of the query then ask all tiles
    within that bound, and of the own tile's points those stay that are nearest the plain way.
    """
    points, queries = points.select("id", *axes), queries.select("id", *axes)
    plan = Plan(points, queries, axes, n, m, max(TILE, 4 * k))
    shared = points.sparkSession.sparkContext.broadcast(plan.tree)
    there = _placed(points, axes, plan.tree, 0)
    if (crowded := np.flatnonzero(plan.points > 1).tolist()):  # by equal points, of which only k can matter; all of them would not fit a task
        equal = Window.partitionBy("tile", *axes).orderBy("id")
        some = there.where(F.col("tile").isin(crowded)).withColumn("r", F.row_number().over(equal)).where(F.col("r") <= k).drop("r")
        there = there.where(~F.col("tile").isin(crowded)).unionByName(some)
    asked = _placed(queries, axes, plan.tree, 1)
    is_query, is_point = (lambda t: t["side"].to_numpy() == 1), (lambda t: t["side"].to_numpy() == 0)

    def first(table: pa.Table) -> Iterator[pa.RecordBatch]:
        q, p = _sides(table, is_query, is_point)
        if not len(q):
            return
        x, names, tile = _coordinates(q, axes), q["id"].to_numpy(), table["tile"][0].as_py()
        there = _coordinates(p, axes)
        who, ids, d2 = nearest_of(p["id"].to_numpy(), there, x, k)
        size = np.bincount(who, minlength=len(q))
        last = np.cumsum(size) - 1
        bound = np.where(size == k, d2[np.maximum(last, 0)] if len(d2) else np.inf, np.inf)
        asked = []
        for image, rows, moved in around.images(x, np.sqrt(bound)):
            asks, to = shared.value.reached(moved, np.sqrt(bound[rows]), around.pad)
            new = (to != tile) | (image > 0)
            asked.append((rows[asks[new]], to[new], np.full(int(new.sum()), image)))
        asks, to, images = (np.concatenate(c) for c in zip(*asked))
        is_open = np.zeros(len(q), dtype=bool)
        is_open[asks] = True
        rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
        if around.box:  # what is nearer the other way round is found by an image; a point's place is looked up by its id
            by_id = np.argsort(p["id"].to_numpy(), kind="stable")
            at = by_id[np.searchsorted(p["id"].to_numpy()[by_id], ids)]
            plain = around.squared(there[at], x[who], np.zeros(len(who), dtype=np.int64)) < np.inf
            who, ids, d2, rank = who[plain], ids[plain], d2[plain], rank[plain]
        yield _found(names[who], rank, ids, d2, is_open[who], np.full(len(who), -1), np.zeros(len(who)), np.zeros(len(who)))
        yield _found(names[asks], np.zeros(len(asks)), asks * 0, np.zeros(len(asks)), np.ones(len(asks), dtype=bool), to, images, bound[asks])

    once = plan.shares(there.unionByName(asked), "side = 1", "side = 0", whole=True)
    got = materialize(once.groupBy("tile", "q", "p").applyInArrow(_streamed(first), FOUND), "nearest")
    closed = got.where("tile < 0 and not open").select("query_id", "rank", "id", "d2")
    again = got.where("tile >= 0").select(F.col("query_id").alias("id"), "tile", "image", "bound")
    counts = again.groupBy("tile").count().collect()  # a row a tile
    if not counts:
        return closed
    crowd = [(r["tile"], math.ceil(r["count"] / MOST_ROWS), 1) for r in counts if r["count"] > MOST_ROWS]
    again = again.join(queries.hint("merge"), "id").select("id", *axes, "tile", F.lit(1).alias("side"), "image", F.lit(True).alias("own"), "bound")
    once_more = there.withColumn("bound", F.lit(None).cast("double")).unionByName(again)

    def second(table: pa.Table) -> Iterator[pa.RecordBatch]:
        q, p = _sides(table, is_query, is_point)
        if not len(q) or not len(p):
            return
        names = q["id"].to_numpy()
        image = q["image"].to_numpy() if around.box else None
        who, ids, d2 = nearest_of(p["id"].to_numpy(), _coordinates(p, axes), _coordinates(q, axes), k, q["bound"].to_numpy(), around, image)
        yield _found(names[who], np.zeros(len(who)), ids, d2, np.ones(len(who), dtype=bool), np.full(len(who), -1), np.zeros(len(who)), np.zeros(len(who)))

    more = _dealt(once_more, crowd, "side = 1", "side = 0").groupBy("tile", "q", "p").applyInArrow(_streamed(second), FOUND)
    every = got.where("tile < 0 and open").unionByName(more).select("query_id", "id", "d2")
    best = Window.partitionBy("query_id").orderBy("d2", "id")
    return closed.unionByName(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "d2"))


def _found(query, rank, ids, d2, is_open, tile, image, bound) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c).astype(t)) for c, t in zip((query, rank, ids, d2, is_open, tile, image, bound), (np.int64, np.int32, np.int64, np.float64, bool, np.int64, np.int32, np.float64))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])
