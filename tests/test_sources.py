"""Files, dumps, training and streams."""

import numpy as np
import pandas as pd
import pytest

from gridloom.operators.points import PointSet
from gridloom.operators.tensor import Tensor
from gridloom.operators.training import accuracy, mlp_loss, sgd, softmax_loss
from gridloom.sources import dump, npy
from gridloom.streaming.proximity import stream_radius


def test_npy(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(2, 3)
    for name, x in (("c", a), ("f", np.asfortranarray(a)), ("i", a.astype("<i8")), ("s", np.array(42.0, dtype="<f4"))):
        np.save(tmp_path / f"{name}.npy", x)
        got = npy.load(spark, str(tmp_path / f"{name}.npy"))
        assert got.shape == x.shape and np.array_equal(got.numpy(), x)
    npy.save(Tensor.of(spark, a), str(tmp_path / "out"))
    back = np.load(tmp_path / "out.npy")
    assert back.dtype == np.float32 and np.array_equal(back, a)
    (tmp_path / "many").mkdir()
    big = np.arange(35.0).reshape(7, 5)
    for r in npy.shards(Tensor.of(spark, big), 3).collect():
        (tmp_path / "many" / f"{r.part:03}.npy").write_bytes(r.content)
    got = npy.load(spark, str(tmp_path / "many"))
    assert got.shape == (7, 5) and np.array_equal(got.numpy(), big)
    with pytest.raises(ValueError):
        npy.load(spark, str(tmp_path / "[cs].npy"))


def test_dump(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-1, 1, (200, 2))
    p = PointSet(spark.createDataFrame(pd.DataFrame({"id": range(200), "a": x[:, 0], "b": x[:, 1]})), "id", ["a", "b"])
    nodes = p.kd_nodes(leaf_size=30)
    dump.write_nodes(nodes, str(tmp_path / "tree"), 2)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(dump.read_nodes(spark, str(tmp_path / "tree"), 2)) == key(nodes)


def test_xor_and_softmax(spark):
    rows = spark.createDataFrame([([0.0, 0.0], 0.0), ([0.0, 1.0], 1.0), ([1.0, 0.0], 1.0), ([1.0, 1.0], 0.0)], "x array<double>, y double").coalesce(1).persist()
    rng = np.random.default_rng(1)
    start = {"w1": rng.normal(size=(2, 4)), "b1": np.zeros(4), "w2": rng.normal(size=(4, 1)), "b2": np.zeros(1)}
    _, history = sgd(rows, "x", "y", start, mlp_loss, rate=1.0, momentum=0.9, epochs=25)
    assert history[-1] < history[0]
    x = rng.normal(size=(120, 3))
    data = spark.createDataFrame([(i, r.tolist(), float(np.argmax(r))) for i, r in enumerate(x)], "k long, x array<double>, y double").coalesce(2).persist()
    p, history = sgd(data, "x", "y", {"w": np.zeros((3, 3)), "b": np.zeros(3)}, softmax_loss, rate=1.0, epochs=3, batches=3, key=["k"])
    assert history[-1] < history[0] and accuracy(data, "x", "y", p, lambda q, z: (z @ q["w"] + q["b"]).argmax(1)) > 0.8


def test_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 1, (100, 2)), rng.uniform(0, 1, (30, 2))
    frame = lambda x: pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]})
    points = PointSet(spark.createDataFrame(frame(a)), "id", ["a", "b"])
    spark.createDataFrame(frame(b)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, a double, b double").parquet(str(tmp_path / "in"))
    q = stream_radius(points, stream, "id", ["a", "b"], 0.2).writeStream.format("memory").queryName("near").start()
    q.processAllAvailable()
    q.stop()
    d2 = ((b[:, None] - a[None]) ** 2).sum(2)
    assert {(r.query_id, r.id) for r in spark.table("near").collect()} == {(i, j) for i, j in zip(*np.nonzero(d2 <= 0.2 * 0.2))}
