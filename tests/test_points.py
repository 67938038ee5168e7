"""Proximity queries against numpy brute force."""

import numpy as np
import pandas as pd
import pytest

from gridloom.operators import points, tiles
from gridloom.operators.points import PointSet

RADII = [0.3, 0.05, 0.2, 0.2, 0.0]


def frame(x, w=None):
    d = {"id": np.arange(len(x)), **{f"c{i}": x[:, i] for i in range(x.shape[1])}}
    return pd.DataFrame(d | ({"w": w} if w is not None else {}))


def distances(a, b, box):
    d = a[:, None, :] - b[None, :, :]
    if box is not None:
        d = np.abs(d)
        d = np.where(d > box / 2, box - d, d)
    total = np.zeros(d.shape[:2])
    for i in range(d.shape[2]):
        total += d[:, :, i] * d[:, :, i]
    return total


def sets(spark, dim=3, n=300, m=80, periodic=None, seed=42, clustered=False):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(-1, 1, (n, dim)), rng.uniform(-1, 1, (m, dim))
    if clustered:
        a = np.round(rng.normal(0, 0.1, (n, dim)) + rng.uniform(-0.7, 0.7, (5, dim))[rng.integers(0, 5, n)], 1)
        b = np.round(b, 1)
    wa, wb = rng.random(n), rng.random(m)
    cols = [f"c{i}" for i in range(dim)]
    return a, b, wa, wb, *(PointSet(spark.createDataFrame(frame(x, w)), "id", cols, "w", periodic) for x, w in ((a, wa), (b, wb)))


@pytest.mark.parametrize("periodic,clustered", [(None, False), (None, True), (2.0, False)])
def test_joins(spark, periodic, clustered):
    a, b, wa, wb, p, q = sets(spark, periodic=periodic, clustered=clustered)
    d2 = distances(b, a, periodic)
    for r in (0.2, 0.9, 0.0):
        got = p.radius(q, r).toPandas()
        want = {(i, j) for i, j in zip(*np.nonzero(d2 <= r * r))}
        assert len(got) == len(want) and {(i, j) for i, j in zip(got.query_id, got.id)} == want
        assert np.allclose(got.distance, np.sqrt(d2[got.query_id, got.id]))
        assert {(r_.i, r_.j) for r_ in p.pairs(r, q).collect()} == {(j, i) for i, j in want}
        own = distances(a, a, periodic)
        want = {(i, j) for i, j in zip(*np.nonzero(own <= r * r)) if i < j}
        pairs = p.pairs(r).collect()
        assert len(pairs) == len(want) and {(x.i, x.j) for x in pairs} == want


@pytest.mark.parametrize("k,dim,periodic,clustered", [(1, 3, None, False), (8, 3, 2.0, False), (40, 2, None, True), (500, 2, None, False), (5, 12, None, False), (3, 1, None, True)])
def test_nearest(spark, k, dim, periodic, clustered):
    a, b, *_, p, q = sets(spark, dim=dim, periodic=periodic, clustered=clustered)
    d2 = distances(b, a, periodic)
    got = p.nearest(q, k).toPandas().sort_values(["query_id", "rank"])
    assert len(got) == len(b) * min(k, len(a))
    want = [j for i in range(len(b)) for j in np.lexsort((np.arange(len(a)), d2[i]))[:k]]
    assert got.id.tolist() == want


@pytest.mark.parametrize("periodic", [None, 2.0])
@pytest.mark.parametrize("cumulative", [True, False])
def test_counts(spark, periodic, cumulative):
    a, b, wa, wb, p, q = sets(spark, periodic=periodic)
    for other, d2, w in ((None, distances(a, a, periodic), np.outer(wa, wa)), (q, distances(a, b, periodic), np.outer(wa, wb))):
        use = np.triu(np.ones(d2.shape, bool), 1) if other is None else np.ones(d2.shape, bool)
        order = np.argsort(RADII, kind="stable")
        sq = np.array(RADII)[order] ** 2
        at = np.searchsorted(sq, d2[use])
        n = np.bincount(at, minlength=len(sq) + 1)[: len(sq)]
        s = np.bincount(at, weights=w[use], minlength=len(sq) + 1)[: len(sq)]
        if cumulative:
            n, s = n.cumsum(), s.cumsum()
        got = {r.k: (r.radius, r["count"]) for r in p.counts(RADII, other, cumulative).collect()}
        gotw = {r.k: r["count"] for r in p.counts_weighted(RADII, other, cumulative).collect()}
        for place, k in enumerate(order):
            assert got[k] == (RADII[k], n[place]) and np.isclose(gotw[k], s[place])


@pytest.mark.parametrize("clustered", [False, True])
def test_many_and_crowded_tiles(spark, monkeypatch, clustered):
    """Small tiles, with queries and points dealt to several tasks of a tile, give what one tile gives."""
    a, b, wa, wb, p, q = sets(spark, n=900, m=300, clustered=clustered)
    monkeypatch.setattr(tiles, "TILE", 60)
    monkeypatch.setattr(tiles, "MOST_ROWS", 40)
    d2, own = distances(b, a, None), distances(a, a, None)
    near = {(x.query_id, x.id) for x in p.radius(q, 0.2).collect()}
    assert near == {(i, j) for i, j in zip(*np.nonzero(d2 <= 0.2 * 0.2))}
    pairs = p.pairs(0.15).collect()
    assert len(pairs) == len(set(pairs)) and p.pairs_set(0.15) == {(x.i, x.j) for x in pairs} == {(i, j) for i, j in zip(*np.nonzero(own <= 0.15 * 0.15)) if i < j}
    assert [x["count"] for x in p.counts([0.1, 0.2], q).orderBy("k").collect()] == [(d2 <= 0.1 * 0.1).sum(), (d2 <= 0.2 * 0.2).sum()]
    for k in (3, 20):
        got = p.nearest(q, k).toPandas().sort_values(["query_id", "rank"])
        assert got.id.tolist() == [j for i in range(len(b)) for j in np.lexsort((np.arange(len(a)), d2[i]))[:k]] and got["rank"].tolist() == list(range(1, k + 1)) * len(b)


def test_sets_as_context(spark):
    p = sets(spark)[4]
    with p as open_set:
        assert open_set.df.is_cached
    assert not p.df.is_cached


def test_limits(spark):
    a, b, *_, p, q = sets(spark)
    with pytest.raises(ValueError):
        p.radius(q, -1)
    with pytest.raises(ValueError):
        p.counts([-0.1])
    with pytest.raises(ValueError):
        p.nearest(q, 0)
    with pytest.raises(ValueError):
        PointSet(spark.createDataFrame(frame(a)), "id", ["c0", "c1", "c2"], periodic=1.0)
    with pytest.raises(ValueError):
        PointSet(spark.createDataFrame(frame(a)), "id", ["c0", "c1", "c2"]).counts_weighted([0.1])
    with pytest.raises(ValueError):
        p.pairs(0.1, PointSet(spark.createDataFrame(frame(b)), "id", ["c0", "c1"]))
    empty = PointSet(spark.createDataFrame(frame(b)).where("id < 0"), "id", ["c0", "c1", "c2"])
    assert p.radius(empty, 0.5).count() == 0 and empty.nearest(q, 3).count() == 0
    assert {r["count"] for r in empty.counts([0.1, 0.5]).collect()} == {0}
    lists = {r.query_id: r.neighbours for r in p.radius_lists(q, 0.3).collect()}
    assert len(lists) == len(b) and any(not x for x in lists.values()) and all(x == sorted(x) for x in lists.values())
    assert p.has_neighbour(q, 0.3).count() == sum(bool(x) for x in lists.values())


def test_mixed_box_and_far_sets(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 1, (120, 2)), rng.uniform(0, 1, (50, 2)) + [3.0, 0.0]  # three boxes away on the periodic axis
    p, q = (PointSet(spark.createDataFrame(frame(x)), "id", ["c0", "c1"], periodic=(1.0, None)) for x in (a, b))
    d0 = np.abs((b[:, None, 0] - 3.0) - a[None, :, 0])
    d2 = np.where(d0 > 0.5, 1 - d0, d0) ** 2 + (b[:, None, 1] - a[None, :, 1]) ** 2
    for r in (0.15, 0.4, 0.8):
        got = {(x.query_id, x.id) for x in p.radius(q, r).collect()}
        assert got == {(i, j) for i, j in zip(*np.nonzero(d2 <= r * r))}


def test_duplicates_nan_and_tree(spark):
    x = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 1.0], [np.nan, 0.0]])
    p = PointSet(spark.createDataFrame(frame(x)), "id", ["c0", "c1"])
    assert {(r.i, r.j) for r in p.pairs(0.0).collect()} == {(0, 1)}
    assert [r.id for r in p.nearest(p, 4).where("query_id = 2").orderBy("rank").collect()] == [2, 0, 1]
    a, *_, q, _ = sets(spark, n=500)
    nodes = {r.idx: r for r in q.kd_nodes(leaf_size=40).collect()}
    assert nodes[0].num == 500 and sum(r.num for r in nodes.values() if r.axis < 0) == 500
    assert all(nodes[r.left].num + nodes[r.right].num == r.num for r in nodes.values() if r.axis >= 0)
    assert q.stats(0.5).agg({"num": "sum"}).first()[0] == 500
    assert {r.axis for r in q.bbox().collect()} == {0, 1, 2}


def test_tree_splits_to_the_leaf_size(spark, monkeypatch):
    rng = np.random.default_rng(6)
    tied = np.concatenate([np.full((700, 2), [1.0, 2.0]), np.stack([np.ones(500), rng.uniform(0, 9, 500)], 1), rng.uniform(0, 1, (60, 2))])
    for x, leaf in ((rng.uniform(0, 1, (2500, 2)), 1), (tied, 2)):
        monkeypatch.setattr(points, "BROADCAST_NODES", 4)
        p = PointSet(spark.createDataFrame(frame(x)), "id", ["c0", "c1"])
        rows = p.kd_nodes(leaf_size=leaf).collect()
        nodes = {r.idx: r for r in rows}
        leaves = sorted((r for r in rows if r.axis < 0), key=lambda r: r.beg)
        assert [r.idx for r in rows] == sorted(nodes) and all(r.num <= leaf or r.bbox_min == r.bbox_max for r in leaves)
        assert [r.beg for r in leaves] == [0, *[r.end for r in leaves[:-1]]] and leaves[-1].end == len(x)
        for r in rows:
            inside = (x >= r.bbox_min).all(1) & (x <= r.bbox_max).all(1)
            assert r.end - r.beg == r.num <= inside.sum() and (r.axis < 0) == (r.left < 0)
            if r.axis >= 0:
                a, b = nodes[r.left], nodes[r.right]
                assert (a.beg, a.end, b.end) == (r.beg, b.beg, r.end) and a.bbox_max[r.axis] <= r.value <= b.bbox_min[r.axis] and a.depth == b.depth == r.depth + 1
        assert max(r.num for r in leaves) == (1 if leaf == 1 else 700) and max(r.depth for r in rows) <= 24


@pytest.mark.parametrize("box", [(2.0, 2.5), (2.0, None)])
def test_periodic_sets_in_tiles(spark, monkeypatch, box):
    """Copies, small and crowded tiles, and images that share a tile with their point: every pair once, by the shorter way round."""
    monkeypatch.setattr(tiles, "TILE", 80)
    monkeypatch.setattr(tiles, "MOST_ROWS", 60)
    rng = np.random.default_rng(8)
    a = np.repeat(np.round(rng.uniform(-1, 1, (120, 2)), 1), 4, axis=0)
    w = rng.random(len(a))
    p = PointSet(spark.createDataFrame(frame(a, w)), "id", ["c0", "c1"], "w", box)
    d = np.abs(a[:, None] - a[None])
    d = np.where(d > np.array([s or np.inf for s in box]) / 2, np.array([s or 0 for s in box]) - d, d)
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]
    up = np.triu(np.ones(d2.shape, bool), 1)
    for r in (0.25, 1.3):
        pairs = [(x.i, x.j) for x in p.pairs(r).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == set(zip(*np.nonzero(up & (d2 <= r * r))))
    radii = [0.0, 0.15, 0.45, 1.2]
    assert [x["count"] for x in p.counts(radii).orderBy("k").collect()] == [int((up & (d2 <= r * r)).sum()) for r in radii]
    assert np.allclose([x["count"] for x in p.counts_weighted(radii).orderBy("k").collect()], [np.outer(w, w)[up & (d2 <= r * r)].sum() for r in radii])
    for k in (3, 50):
        got = p.nearest(p, k).toPandas().sort_values(["query_id", "rank"])
        assert got.id.tolist() == [j for i in range(len(a)) for j in np.lexsort((np.arange(len(a)), d2[i]))[:k]]


def test_periodic_joins_broadcast_no_rows(spark, tmp_path):
    from gridloom.plans import queries as core

    spark.range(2000).selectExpr("id p_partkey", "cast(id % 50 + 1 as int) p_size", "900 + id * 37 % 1000 / 10.0D p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    plan = core.queries()["knn_periodic"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
    for name in ("counts_periodic", "pairs_periodic", "rdf"):
        plan = core.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "Generate" not in plan and plan.count("Join") == (0 if name == "pairs_periodic" else 1)  # the radii


def test_equal_points_count_as_one_place(spark, monkeypatch):
    """Pairs looked at go by places: copies of a point add none; weights of either sign, and a NULL, which adds nothing."""
    rng = np.random.default_rng(9)
    a = np.repeat(rng.integers(0, 6, (40, 2)) / 10, 50, axis=0)
    w = rng.normal(size=len(a))
    rows = frame(a, w)
    rows["w"] = rows["w"].astype(object).where(rows["id"] != 7, None)
    p = PointSet(spark.createDataFrame(rows, "id long, c0 double, c1 double, w double"), "id", ["c0", "c1"], "w")
    w[7] = 0
    d2 = distances(a, a, None)
    up = np.triu(np.ones(d2.shape, bool), 1)
    radii = [0.0, 0.1, 0.25]
    assert [x["count"] for x in p.counts(radii).orderBy("k").collect()] == [int((up & (d2 <= r * r)).sum()) for r in radii]
    assert np.allclose([x["count"] for x in p.counts_weighted(radii).orderBy("k").collect()], [np.outer(w, w)[up & (d2 <= r * r)].sum() for r in radii])
    places = tiles.Places(a, np.arange(len(a)), np.zeros(len(a), dtype=np.int32))
    assert len(places.x) <= 36 and sum(len(i) for i, *_ in tiles.neighbours(places.x, places.x, 0.25)) <= 36 * 36
    monkeypatch.setattr(tiles, "PAIRS", 1000)  # places are expanded in parts
    pairs = [(x.i, x.j) for x in p.pairs(0.1).collect()]
    assert len(pairs) == len(set(pairs)) == int((up & (d2 <= 0.1 * 0.1)).sum())


def test_pairs_of_one_set_go_out_by_tile(spark, monkeypatch, tmp_path):
    """A file of pairs has the larger ids of one tile, and the rows of equal points come from ranges of ids that all meet."""
    monkeypatch.setattr(tiles, "TILE", 400)
    rng = np.random.default_rng(12)
    a = np.repeat(rng.integers(0, 40, (120, 2)) / 40, 9, axis=0)[rng.permutation(1080)]
    up = np.triu(np.ones((1080, 1080), bool), 1)
    for box in (None, 1.0):
        p = PointSet(spark.createDataFrame(frame(a, np.ones(len(a)))), "id", ["c0", "c1"], periodic=box)
        want = sorted(zip(*(c.tolist() for c in np.nonzero(up & (distances(a, a, box) <= 0.1 * 0.1)))))
        p.pairs(0.1).write.parquet(path := str(tmp_path / f"{box}"))
        rows = spark.read.parquet(path).selectExpr("*", "_metadata.file_name f").toPandas()
        assert sorted(zip(rows["i"], rows["j"])) == want
        held = rows.groupby("f")["j"].nunique()
        assert len(held) >= len(a) / 100 and held.max() <= 100
    with monkeypatch.context() as m:
        m.setattr(tiles, "MOST_ROWS", 30)  # crowded tiles
        assert sorted((x.i, x.j) for x in p.pairs(0.1).collect()) == want
    monkeypatch.setattr(tiles, "RUN", 8)
    monkeypatch.setattr(tiles, "PAIRS", 100)
    monkeypatch.setattr(tiles, "BATCH", 50)
    at, d2 = tiles.Places(a, np.arange(1080), np.zeros(1080, dtype=np.int32)), distances(a, a, None)
    own, got, most = at.rows + np.repeat(np.arange(len(at.size)), at.size) * 1080, [], 0
    for i, j, _ in tiles.neighbours(at.x, at.x, 0.1):
        for key in tiles._members(i, j, at, at.rows, 1080):
            for x, y in tiles._met(*tiles._below(key, own, at, 1080)):
                most = max(most, len(x))
                got += zip((key[x] % 1080).tolist(), at.rows[y].tolist())
    assert sorted(got) == sorted(zip(*(c.tolist() for c in np.nonzero(up & (d2 <= 0.1 * 0.1))))) and most <= 50


def test_radius_rows_go_out_by_tile(spark, monkeypatch, tmp_path):
    """A file of a radius join has one tile's queries, and rows of equal points are made from lists, also in parts and of crowded tiles."""
    monkeypatch.setattr(tiles, "TILE", 200)
    rng = np.random.default_rng(10)
    a = np.repeat(rng.integers(0, 40, (120, 2)) / 40, 9, axis=0)
    p = PointSet(spark.createDataFrame(frame(a, np.ones(len(a)))), "id", ["c0", "c1"])
    near = distances(a, a, None) <= 0.1 * 0.1
    want = sorted(zip(*(c.tolist() for c in np.nonzero(near))))
    p.radius(p, 0.1).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).selectExpr("*", "_metadata.file_name f").toPandas()
    assert sorted(zip(rows["query_id"], rows["id"])) == want
    held = rows.groupby("f")["query_id"].nunique()
    assert len(held) >= len(a) / 100 and held.max() <= 200
    monkeypatch.setattr(tiles, "LIST", 4)
    monkeypatch.setattr(tiles, "MOST_ROWS", 30)
    assert sorted((x.query_id, x.id) for x in p.radius(p, 0.1).collect()) == want
