"""NumPy files as tensors, in both directions.

Reading goes through Spark's binary file source, so any store that Spark reads
will do; the element type and Fortran order of the header are honoured. A folder
of files stacks along the first axis in order of their names. ``shards`` gives the
bytes of float32 C-order files, one for each range of the first axis, as rows
for any sink; ``write`` puts them under a path of any Hadoop file system, file by
file; ``save`` writes one small file from the driver.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tensor import Tensor, decoded, flat_index


def read_shapes(spark: SparkSession, path: str) -> list[tuple[str, tuple[int, ...]]]:
    """(path, shape) of each file, in order of paths; only headers reach the driver."""

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, list(np.load(io.BytesIO(b), allow_pickle=False).shape)) for p, b in zip(frame["path"], frame["content"])]
            yield pd.DataFrame(rows, columns=["path", "shape"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(shapes, "path string, shape array<long>").collect()
    return sorted((r.path, tuple(r["shape"])) for r in found)


def load(spark: SparkSession, path: str) -> Tensor:
    """A tensor from one file, or from several whose shapes differ in the first axis at most."""
    files = read_shapes(spark, path)
    if not files:
        raise ValueError(f"no file at {path}")
    if len(files) > 1 and (any(not s for _, s in files) or len({s[1:] for _, s in files}) > 1):
        raise ValueError("files differ in shape")
    shape = files[0][1] if len(files) == 1 else (sum(s[0] for _, s in files), *files[0][1][1:])
    starts, at = {}, 0
    for p, s in files:
        starts[p] = at
        at += int(np.prod(s))

    def elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, b in zip(frame["path"], frame["content"]):
                v = np.load(io.BytesIO(b), allow_pickle=False).astype(np.float64).reshape(-1)
                for a in range(0, len(v), 1 << 16):
                    yield pd.DataFrame({"f": starts[p] + np.arange(a, min(a + (1 << 16), len(v))), "v": v[a : a + (1 << 16)]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(elements, "f long, v double")
    return Tensor(rows.select(*decoded(F.col("f"), shape), "v"), shape)


def save(tensor: Tensor, path: str) -> None:
    """One float32 file from the driver; for small tensors and local paths."""
    np.save(path if path.endswith(".npy") else f"{path}.npy", tensor.numpy().astype("<f4"))


def write(tensor: Tensor, path: str, rows_a_file: int) -> None:
    """Files ``part-00000000.npy``, ... under ``path``, whose order of names is that of the rows.

    Bytes pass from the tasks to the file system by way of the driver, one file at a time, so its memory holds one.
    """
    spark = tensor.df.sparkSession
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in shards(tensor, rows_a_file).toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/part-{r['part']:08}.npy")
        out = where.getFileSystem(settings).create(where, True)
        out.write(bytearray(r["content"]))
        out.close()


def shards(tensor: Tensor, rows_a_file: int) -> DataFrame:
    """(part, content): NPY bytes of consecutive ranges of the first axis, each of ``rows_a_file`` rows at most."""
    if not tensor.ndim:
        raise ValueError("a scalar has no first axis")
    tail, shape = tensor.shape[1:], tensor.shape
    row = int(np.prod(tail)) if tail else 1

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        n = min(rows_a_file, shape[0] - part * rows_a_file)
        out = np.zeros(n * row, dtype="<f4")
        out[frame["f"].to_numpy()] = frame["v"].to_numpy()
        buffer = io.BytesIO()
        np.save(buffer, out.reshape(n, *tail))
        return pd.DataFrame({"part": [part], "content": [buffer.getvalue()]})

    part = F.floor(F.col("i0") / rows_a_file).cast("long")
    rows = tensor.df.select(part.alias("part"), (flat_index(shape) - part * rows_a_file * row).alias("f"), "v")
    return rows.groupBy("part").applyInPandas(pack, "part long, content binary")
