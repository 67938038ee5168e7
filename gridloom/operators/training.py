"""Data-parallel training by stochastic gradient descent.

Parameters live on the driver as numpy arrays and go out with each step.
Partitions compute loss and gradient sums of their rows of the batch in blocks;
Spark adds them up per parameter element, and the driver moves the
parameters. Only sums of the parameters' size travel. A batch is a range of the
rows' keyed hash, so batches are alike on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Params = dict[str, np.ndarray]
#: (parameters, x [n, d], y [n]) to (loss sum, gradients of that sum)
Loss = Callable[[Params, np.ndarray, np.ndarray], tuple[float, Params]]


def gradient_sums(rows: DataFrame, features: str, target: str, params: Params, loss: Loss) -> tuple[float, int, Params]:
    """Loss sum, number of rows and gradient sums over all rows; features is an array column."""
    names = sorted(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, grads = 0.0, 0, {k: np.zeros_like(params[k]) for k in names}
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["x"].to_pylist(), dtype=np.float64)
            part, own = loss(params, x, np.asarray(batch["y"], dtype=np.float64))
            total, n = total + part, n + len(batch)
            for k in names:
                grads[k] += own[k]
        if n:
            flat = np.concatenate([[total, n], *(grads[k].reshape(-1) for k in names)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    sums = rows.select(F.col(features).alias("x"), F.col(target).cast("double").alias("y")).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(2 + sum(params[k].size for k in names))
    flat[sums["at"].to_numpy(dtype=int)] = sums["v"].to_numpy()
    out, at = {}, 2
    for k in names:
        out[k] = flat[at : at + params[k].size].reshape(params[k].shape)
        at += params[k].size
    return float(flat[0]), int(flat[1]), out


def sgd(rows: DataFrame, features: str, target: str, params: Params, loss: Loss, rate: float = 0.1, momentum: float = 0.0, epochs: int = 1, batches: int = 1, seed: int = 0, key: Sequence[str] = ()) -> tuple[Params, list[float]]:
    """Parameters after training, and the mean loss of each epoch. ``key`` names the columns that tell rows apart (needed for several batches)."""
    params = {k: np.array(v, dtype=np.float64) for k, v in params.items()}
    speed = {k: np.zeros_like(v) for k, v in params.items()}
    history = []
    for epoch in range(epochs):
        total, seen = 0.0, 0
        for b in range(batches):
            part = rows.where(F.pmod(F.xxhash64(F.lit(seed + epoch), *key), F.lit(batches)) == b) if batches > 1 else rows
            s, n, grads = gradient_sums(part, features, target, params, loss)
            if not n:
                continue
            total, seen = total + s, seen + n
            for k in params:
                speed[k] = momentum * speed[k] + grads[k] / n
                params[k] = params[k] - rate * speed[k]
        history.append(total / max(seen, 1))
    return params, history


def softmax_loss(params: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Linear classifier: w [d, c], b [c]; cross-entropy."""
    z = x @ params["w"] + params["b"]
    z = z - z.max(axis=1, keepdims=True)
    log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    at = np.arange(len(y)), y.astype(int)
    g = np.exp(log)
    g[at] -= 1
    return -log[at].sum(), {"w": x.T @ g, "b": g.sum(axis=0)}


def mlp_loss(params: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Two layers with tanh and sigmoid: w1 [d, h], b1 [h], w2 [h, 1], b2 [1]; squared error."""
    h = np.tanh(x @ params["w1"] + params["b1"])
    p = 1 / (1 + np.exp(-(h @ params["w2"] + params["b2"])))
    d = p - y[:, None]
    g = 2 * d * p * (1 - p)
    gh = g @ params["w2"].T * (1 - h * h)
    return float((d * d).sum()), {"w1": x.T @ gh, "b1": gh.sum(0), "w2": h.T @ g, "b2": g.sum(0)}


def accuracy(rows: DataFrame, features: str, target: str, params: Params, classify: Callable[[Params, np.ndarray], np.ndarray]) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                good = classify(params, np.array(batch["x"].to_pylist(), dtype=np.float64)) == np.asarray(batch["y"])
                yield pa.RecordBatch.from_arrays([pa.array([int(good.sum())]), pa.array([len(good)])], names=["good", "n"])

    r = rows.select(F.col(features).alias("x"), F.col(target).cast("double").alias("y")).mapInArrow(run, "good long, n long").agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    return (r.g or 0) / max(r.n or 0, 1)
