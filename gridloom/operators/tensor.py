"""Dense arrays as relations, with reverse-mode gradients.

A ``Tensor`` is a lazy DataFrame with a BIGINT column an axis (i0, i1, ...) and a
DOUBLE value ``v``, one row an element, and its shape on the driver, where all
shape checks happen without a job. Movement is projection, broadcasting is an
equality join on shared axes, reductions are partial aggregates, products are
joins of blocks that numpy multiplies. Operations on tensors that need gradients record how to pass
gradients back; ``backward`` turns that into further plans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce as fold

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as E
from ..functions.permutation import permuted
from .lifecycle import no_grad, recording

#: Operands of up to this many elements are broadcast in joins; sizes are known from shapes.
BROADCAST_ELEMENTS = 200_000
#: Rows and columns of the blocks in which matrices are multiplied.
MATRIX_BLOCK = 64
#: Shares of a side's blocks where two large matrices are multiplied; their square is the least number of keys, and each side is shuffled so many times.
DEALS = 8
MOST_AXES = 8


def axes(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def strides(shape: Sequence[int]) -> list[int]:
    return [math.prod(shape[k + 1 :]) for k in range(len(shape))]


def flat_index(shape: Sequence[int], names: Sequence[str] | None = None) -> Column:
    names = names or axes(len(shape))
    return fold(lambda a, b: a + b, [F.col(n) * s for n, s in zip(names, strides(shape))], F.lit(0).cast("long"))


def decoded(flat: Column, shape: Sequence[int]) -> list[Column]:
    out = []
    for k, (s, d) in enumerate(zip(strides(shape), shape)):
        at = ((flat - flat % s) / s).cast("long")
        out.append((at % d if k else at).alias(f"i{k}"))
    return out


def _axis(axis: int, n: int) -> int:
    if not -n <= axis < n:
        raise ValueError(f"axis {axis} of {n}")
    return axis % n


def broadcast_shape(*shapes: Sequence[int]) -> tuple[int, ...]:
    n = max(map(len, shapes))
    out = []
    for k in range(n):
        sizes = {s[k - n + len(s)] for s in shapes if k - n + len(s) >= 0} - {1}
        if len(sizes) > 1:
            raise ValueError(f"shapes {shapes} do not broadcast")
        out.append(sizes.pop() if sizes else 1)
    return tuple(out)


class _Sheet:
    """A relation of index columns and ``v``, with the columns that element-wise functions of it add, so that these meet without a join.

    A column is computed once, in a projection behind those that it uses.
    """

    def __init__(self, rows: DataFrame):
        self.rows, self.made = rows, {}

    def add(self, value: Column, used: set[str]) -> str:
        level = 1 + max((self.made[u][2] for u in used if u in self.made), default=0)
        name = f"_{len(self.made)}"
        self.made[name] = (value, used, level)
        return name

    def with_columns(self, names: Sequence[str]) -> DataFrame:
        wanted, todo = set(), list(names)
        while todo:
            if (name := todo.pop()) in self.made and name not in wanted:
                wanted.add(name)
                todo += self.made[name][1]
        out = self.rows
        for level in sorted({self.made[n][2] for n in wanted}):
            out = out.select("*", *[self.made[n][0].alias(n) for n in self.made if n in wanted and self.made[n][2] == level])
        return out


class Tensor:
    """``df`` has a row an element. A tensor that repeats along axes knows the ``narrow`` one, of size 1 there; one of a single number knows its ``literal``."""

    def __init__(self, df: DataFrame | None, shape: Sequence[int], parents: Sequence[Tensor] = (), back: Callable | None = None, *, at: tuple[_Sheet, str] | None = None, narrow: Tensor | None = None, literal: Column | None = None):
        self.shape = tuple(int(d) for d in shape)
        if len(self.shape) > MOST_AXES or any(d <= 0 for d in self.shape):
            raise ValueError(f"bad shape {self.shape}")
        self.narrow, self.literal, self._at, self._df = narrow, literal, at, None
        if df is not None:
            self._at = (_Sheet(df.select(*axes(len(self.shape)), F.col("v").cast("double").alias("v"))), "v")
        live = recording() and any(p.needs_grad for p in parents)
        self.parents, self.back = (tuple(parents), back) if live else ((), None)
        self.needs_grad = live
        self._grad: Tensor | None = None

    @property
    def at(self) -> tuple[_Sheet, str]:
        """The sheet and the column that hold the elements."""
        if self._at is None:
            self._at = (_Sheet(self.narrow._spread(self.shape)), "v")
        return self._at

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            sheet, name = self.at
            self._df = sheet.with_columns([name]).select(*self.names, F.col(name).alias("v"))
        return self._df

    def _spread(self, shape: Sequence[int]) -> DataFrame:
        """Repeated along axes of size 1 to a shape of as many axes. Small ones meet a range of all places, so that all tasks have a share and the planner knows the size."""
        wide = [k for k, d in enumerate(shape) if self.shape[k] != d]
        if self.numel <= BROADCAST_ELEMENTS:
            own = [k for k in range(self.ndim) if k not in wide]
            places = self.df.sparkSession.range(math.prod(shape)).select(*decoded(F.col("id"), shape))
            rows = F.broadcast(self.df.select(*[f"i{k}" for k in own], "v"))  # of checked size
            return (places.join(rows, [f"i{k}" for k in own]) if own else places.crossJoin(rows)).select(*axes(len(shape)), "v")
        rows = self.df
        for k in wide:
            rows = rows.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shape[k] - 1).cast("long"))))
        return rows

    # --- creation -----------------------------------------------------------------------------

    @staticmethod
    def generate(spark: SparkSession, shape: Sequence[int], value: Column, partitions: int = 8) -> Tensor:
        """One row an element of ``spark.range``; the number of partitions is fixed, as random columns depend on it."""
        shape = tuple(shape)
        rows = spark.range(0, math.prod(shape), 1, partitions).select("id", value.cast("double").alias("v"))
        return Tensor(rows.select(*decoded(F.col("id"), shape), "v"), shape)

    @staticmethod
    def fill(spark, shape, value: float) -> Tensor:
        out = Tensor.generate(spark, shape, F.lit(float(value)))
        out.literal = F.lit(float(value))
        return out

    @staticmethod
    def zeros(spark, shape) -> Tensor:
        return Tensor.fill(spark, shape, 0.0)

    empty = zeros

    @staticmethod
    def ones(spark, shape) -> Tensor:
        return Tensor.fill(spark, shape, 1.0)

    @staticmethod
    def scalar(spark, value: float) -> Tensor:
        return Tensor.fill(spark, (), value)

    @staticmethod
    def rand(spark, shape, seed: int = 0) -> Tensor:
        """Uniform in [0, 1)."""
        return Tensor.generate(spark, shape, F.rand(seed))

    @staticmethod
    def uniform(spark, shape, low: float, high: float, seed: int = 0) -> Tensor:
        return Tensor.generate(spark, shape, F.lit(float(low)) + F.rand(seed) * float(high - low))

    @staticmethod
    def randn(spark, shape, seed: int = 0) -> Tensor:
        return Tensor.generate(spark, shape, F.randn(seed))

    @staticmethod
    def normal(spark, shape, mean: float, std: float, seed: int = 0) -> Tensor:
        return Tensor.generate(spark, shape, F.lit(float(mean)) + F.randn(seed) * float(std))

    @staticmethod
    def of(spark: SparkSession, data) -> Tensor:
        """From a small driver-side array."""
        a = np.asarray(data, dtype=np.float64)
        frame = pd.DataFrame({"f": np.arange(a.size, dtype=np.int64), "v": a.reshape(-1)})
        rows = spark.createDataFrame(frame, "f long, v double")
        return Tensor(rows.select(*decoded(F.col("f"), a.shape), "v"), a.shape)

    @staticmethod
    def wrap(df: DataFrame, shape: Sequence[int], index: Sequence[str] | None = None, value: str = "v") -> Tensor:
        """A relation that already has one row an element, under index columns counted from 0."""
        index = index or axes(len(shape))
        return Tensor(df.select(*[F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(index)], F.col(value).alias("v")), shape)

    @staticmethod
    def rows(df: DataFrame, row: str, array: str, shape: tuple[int, int]) -> Tensor:
        """From rows numbered from 0 with an array column each."""
        return Tensor(df.select(F.col(row).cast("long").alias("i0"), F.posexplode(array).alias("p", "v")).select("i0", F.col("p").cast("long").alias("i1"), "v"), shape)

    # --- metadata -----------------------------------------------------------------------------

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def numel(self) -> int:
        return math.prod(self.shape)

    @property
    def stride(self) -> tuple[int, ...]:
        return tuple(strides(self.shape))

    @property
    def names(self) -> list[str]:
        return axes(self.ndim)

    def numpy(self) -> np.ndarray:
        """To the driver; for small tensors."""
        frame = self.df.select(flat_index(self.shape).alias("f"), "v").toPandas()
        out = np.full(self.numel, np.nan)
        out[frame["f"].to_numpy()] = frame["v"].to_numpy()
        return out.reshape(self.shape)

    def item(self) -> float:
        return float(self.numpy().reshape(-1)[0])

    def show_text(self) -> str:
        return f"shape={self.shape} stride={self.stride}\n" + np.array2string(self.numpy(), formatter={"float": lambda x: f"{x:.8g}"})

    def requires_grad(self) -> Tensor:
        self.needs_grad = True
        return self

    @property
    def grad(self) -> Tensor | None:
        return self._grad

    def zero_grad(self) -> None:
        self._grad = None

    def _next(self, df: DataFrame, shape: Sequence[int], parents: Sequence[Tensor], back: Callable) -> Tensor:
        return Tensor(df, shape, parents, back)

    # --- movement -----------------------------------------------------------------------------

    def clone(self) -> Tensor:
        return self._as(self.shape, [self], lambda g, out: [g])

    contiguous = clone

    def _as(self, shape: Sequence[int], parents: Sequence[Tensor], back: Callable | None) -> Tensor:
        return Tensor(None, shape, parents, back, at=self._at, narrow=self.narrow, literal=self.literal)

    def detach(self) -> Tensor:
        return self._as(self.shape, (), None)

    def reshape(self, *shape: int) -> Tensor:
        shape = list(shape[0]) if len(shape) == 1 and not isinstance(shape[0], int) else list(shape)
        if shape.count(-1) > 1:
            raise ValueError("more than one free size")
        if -1 in shape:
            rest = math.prod(d for d in shape if d != -1)
            if rest <= 0 or self.numel % rest:
                raise ValueError(f"{self.shape} does not fill {shape}")
            shape[shape.index(-1)] = self.numel // rest
        if math.prod(shape) != self.numel:
            raise ValueError(f"{self.shape} does not fill {shape}")
        rows = self.df.select(flat_index(self.shape).alias("f"), "v")
        out = self._next(rows.select(*decoded(F.col("f"), shape), "v"), shape, [self], lambda g, out: [g.reshape(self.shape)])
        out.literal = self.literal
        return out

    def flatten(self, begin: int = 0, end: int = -1) -> Tensor:
        if not self.ndim:
            return self.reshape(1)
        b, e = _axis(begin, self.ndim), _axis(end, self.ndim)
        if b > e:
            raise ValueError("begin behind end")
        return self.reshape(*self.shape[:b], math.prod(self.shape[b : e + 1]), *self.shape[e + 1 :])

    def squeeze(self, axis: int | None = None) -> Tensor:
        if axis is None:
            return self.reshape(tuple(d for d in self.shape if d != 1))
        k = _axis(axis, self.ndim)
        if self.shape[k] != 1:
            raise ValueError("only axes of size 1 can go")
        return self.reshape(self.shape[:k] + self.shape[k + 1 :])

    def unsqueeze(self, axis: int) -> Tensor:
        k = _axis(axis, self.ndim + 1)
        return self.reshape(self.shape[:k] + (1,) + self.shape[k:])

    def permute(self, *order: int) -> Tensor:
        order = [_axis(o, self.ndim) for o in (order[0] if len(order) == 1 and not isinstance(order[0], int) else order)]
        if sorted(order) != list(range(self.ndim)):
            raise ValueError("not a permutation")
        back = lambda g, out: [g.permute([order.index(k) for k in range(len(order))])]
        shape = [self.shape[o] for o in order]
        if self.narrow is not None:
            return Tensor(None, shape, [self], back, narrow=self.narrow.detach().permute(order), literal=self.literal)
        rows = self.df.select(*[F.col(f"i{o}").alias(f"i{k}") for k, o in enumerate(order)], "v")
        return self._next(rows, shape, [self], back)

    def transpose(self, a: int, b: int) -> Tensor:
        order = list(range(self.ndim))
        a, b = _axis(a, self.ndim), _axis(b, self.ndim)
        order[a], order[b] = order[b], order[a]
        return self.permute(order)

    def slice(self, axis: int, begin: int | None = None, end: int | None = None, step: int = 1) -> Tensor:
        """As x[begin:end:step]; an end of -1 means before the first element, as negative steps need, and isn't counted from the back."""
        k, size = _axis(axis, self.ndim), self.shape[axis]
        if step == 0:
            raise ValueError("step 0")
        begin = (0 if step > 0 else size - 1) if begin is None else begin + size if begin < 0 else begin
        end = (size if step > 0 else -1) if end is None else end + size if end < -1 else end
        end = min(end, size)
        if not 0 <= begin < size:
            raise ValueError("begin outside the axis")
        n = max(0, -(-(end - begin) // step))
        if n == 0:
            raise ValueError("an empty slice")
        i = F.col(f"i{k}")
        inside = (i >= begin) & (i < end) & ((i - begin) % step == 0) if step > 0 else (i <= begin) & (i > end) & ((begin - i) % -step == 0)
        rows = self.df.where(inside).withColumn(f"i{k}", ((i - begin) / step).cast("long"))

        def back(g: Tensor, out: Tensor):
            placed = g.df.withColumn(f"i{k}", i * step + begin)
            return [g._completed(placed, self.shape)]

        return self._next(rows, [*self.shape[:k], n, *self.shape[k + 1 :]], [self], back)

    def select(self, axis: int, index: int) -> Tensor:
        k = _axis(axis, self.ndim)
        at = index % self.shape[k] if -self.shape[k] <= index < self.shape[k] else None
        if at is None:
            raise ValueError("index outside the axis")
        return self.slice(k, at, at + 1).squeeze(k)

    def _completed(self, rows: DataFrame, shape: Sequence[int]) -> Tensor:
        """A full tensor from some elements, summed where they repeat; the others are 0."""
        if not shape:
            return Tensor(rows.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")), shape)
        spark = rows.sparkSession
        grid = spark.range(math.prod(shape)).select(*decoded(F.col("id"), shape), F.lit(0.0).alias("v"))
        return Tensor(rows.select(*axes(len(shape)), "v").unionByName(grid).groupBy(*axes(len(shape))).agg(F.sum("v").alias("v")), shape)

    def expand(self, *shape: int) -> Tensor:
        shape = list(shape[0]) if len(shape) == 1 and not isinstance(shape[0], int) else list(shape)
        lead = len(shape) - self.ndim
        if lead < 0:
            raise ValueError("fewer axes")
        out = []
        for k, d in enumerate(shape):
            own = self.shape[k - lead] if k >= lead else 1
            d = own if d == -1 else d
            if own not in (1, d) or d <= 0:
                raise ValueError(f"{self.shape} does not expand to {shape}")
            out.append(d)
        back = lambda g, o: [g._unbroadcast(self.shape)]
        source = self.detach() if self.narrow is None else self.narrow.detach()
        source = source.reshape((1,) * lead + source.shape) if lead else source
        if source.shape == tuple(out):
            return source._as(out, [self], back)
        return Tensor(None, out, [self], back, narrow=source, literal=self.literal)

    def _unbroadcast(self, shape: Sequence[int]) -> Tensor:
        lead = self.ndim - len(shape)
        gone = [k for k in range(self.ndim) if k < lead or (shape[k - lead] == 1 and self.shape[k] != 1)]
        if not gone:
            return self.reshape(shape) if tuple(shape) != self.shape else self
        return self.sum(gone, keepdim=True).reshape(shape)

    def shuffle(self, axis: int = 0, seed: int = 0) -> Tensor:
        return shuffle([self], axis, seed)[0]

    # --- element by element -------------------------------------------------------------------

    def _unary(self, f: Callable, back: Callable | None) -> Tensor:
        return _pointwise([self], f, [self] if back else [], back)

    def neg(self):
        return self._unary(E.neg, lambda g, out: [g.neg()])

    def abs(self):
        return self._unary(E.absolute, lambda g, out: [g.mul(self.detach().sign())])

    def sign(self):
        return self._unary(E.sign, None)

    def square(self):
        return self.mul(self)

    def sqrt(self):
        return self._unary(E.sqrt, lambda g, out: [g.mul(0.5).div(out)])

    def rsqrt(self):
        return self._unary(E.rsqrt, lambda g, out: [g.mul(out.mul(out).mul(out)).mul(-0.5)])

    def exp(self):
        return self._unary(E.exp, lambda g, out: [g.mul(out)])

    def log(self):
        return self._unary(E.log, lambda g, out: [g.div(self.detach())])

    def relu(self):
        return self._unary(E.relu, lambda g, out: [g.mul(out.sign())])

    def sigmoid(self):
        return self._unary(E.sigmoid, lambda g, out: [g.mul(out._unary(lambda v: v * (F.lit(1.0) - v), None))])

    def tanh(self):
        return self._unary(E.tanh, lambda g, out: [g.mul(out._unary(lambda v: F.lit(1.0) - v * v, None))])

    def _like(self, other) -> Tensor:
        return other if isinstance(other, Tensor) else Tensor.scalar(self.df.sparkSession, other)

    def _binary(self, other, f: Callable, back: Callable) -> Tensor:
        if not isinstance(other, Tensor):  # a number joins nothing
            value = F.lit(float(other))
            return _pointwise([self], lambda v: f(v, value), [self], lambda g, out: back(g, out, self.detach(), float(other))[:1])
        return _pointwise([self, other], f, [self, other], lambda g, o: [x._unbroadcast(p.shape) for x, p in zip(back(g, o, self.detach(), other.detach()), (self, other))])

    def add(self, other):
        return self._binary(other, E.add, lambda g, out, a, b: [g, g])

    def sub(self, other):
        return self._binary(other, E.sub, lambda g, out, a, b: [g, g.neg()])

    def mul(self, other):
        return self._binary(other, E.mul, lambda g, out, a, b: [g.mul(b), g.mul(a)])

    def div(self, other):
        return self._binary(other, E.div, lambda g, out, a, b: [g.div(b), g.mul(out).div(b).neg()] if isinstance(b, Tensor) else [g.div(b)])

    def pow(self, other):
        def back(g, out, a, b):
            first = g.mul(b).mul(a.pow(b.sub(1.0) if isinstance(b, Tensor) else b - 1.0))
            return [first, g.mul(out).mul(a.log())] if isinstance(b, Tensor) else [first]

        return self._binary(other, E.power, back)

    __add__, __sub__, __mul__, __truediv__, __neg__, __pow__ = add, sub, mul, div, neg, pow

    def where(self, a, b) -> Tensor:
        """self is the condition."""
        a, b = self._like(a), self._like(b)
        cond = self.detach()
        return _pointwise([self, a, b], E.where, [a, b], lambda g, o: [cond.where(g, 0.0)._unbroadcast(a.shape), cond.where(0.0, g)._unbroadcast(b.shape)])

    def clamp(self, low, high) -> Tensor:
        low, high = self._like(low), self._like(high)

        def back(g, o):
            moved = o.sub(self.detach()).sign()  # 1: raised to low, -1: lowered to high
            parts = [moved._unary(lambda v, t=t: (v == t).cast("double"), None) for t in (0.0, 1.0, -1.0)]
            return [g.mul(p)._unbroadcast(x.shape) for p, x in zip(parts, (self, low, high))]

        return _pointwise([self, low, high], E.clamp, [self, low, high], back)

    # --- reductions ---------------------------------------------------------------------------

    def _kept(self, axis) -> tuple[list[int], list[int]]:
        gone = list(range(self.ndim)) if axis is None else sorted({_axis(a, self.ndim) for a in ([axis] if isinstance(axis, int) else axis)})
        return gone, [k for k in range(self.ndim) if k not in gone]

    def _reduce(self, axis, keepdim: bool, total: Column, back: Callable) -> Tensor:
        gone, kept = self._kept(axis)
        rows = self.df.groupBy(*[f"i{k}" for k in kept]).agg(total.alias("v"))
        full = [1 if k in gone else d for k, d in enumerate(self.shape)]
        rows = rows.select(*[F.lit(0).cast("long").alias(f"i{k}") if k in gone else F.col(f"i{k}") for k in range(self.ndim)], "v")
        n = math.prod(self.shape[k] for k in gone)
        wide = Tensor(rows, full, [self], lambda g, out: [back(g, out, n)])
        return wide if keepdim else wide.reshape([self.shape[k] for k in kept])

    def sum(self, axis=None, keepdim=False):
        return self._reduce(axis, keepdim, F.sum("v"), lambda g, out, n: g.expand(self.shape))

    def mean(self, axis=None, keepdim=False):
        return self._reduce(axis, keepdim, F.avg("v"), lambda g, out, n: g.mul(1.0 / n).expand(self.shape))

    def var(self, axis=None, keepdim=False):
        """Of the population."""
        return self._reduce(axis, keepdim, F.var_pop("v"), lambda g, out, n: self.detach().sub(self.detach().mean(axis, True)).mul(2.0 / n).mul(g))

    def std(self, axis=None, keepdim=False):
        return self.var(axis, keepdim).sqrt()

    def norm(self, axis=None, keepdim=False):
        return self.square().sum(axis, keepdim).sqrt()

    def _extreme(self, axis, keepdim, f):
        skip = F.when(~F.isnan("v"), F.col("v"))  # NaN only where there is nothing else

        def back(g, out, n):
            mask = _pointwise([self.detach(), out.detach()], lambda a, b: (a == b).cast("double"), (), None)
            return g.mul(mask.div(mask.sum(axis, True)))  # ties share equally

        return self._reduce(axis, keepdim, F.coalesce(f(skip), F.lit(float("nan"))), back)

    def min(self, axis=None, keepdim=False):
        return self._extreme(axis, keepdim, F.min)

    def max(self, axis=None, keepdim=False):
        return self._extreme(axis, keepdim, F.max)

    def _arg(self, axis: int | None, largest: bool) -> DataFrame:
        kept = [] if axis is None else self._kept(axis)[1]
        at = flat_index(self.shape) if axis is None else F.col(f"i{_axis(axis, self.ndim)}")
        v = F.when(~F.isnan("v"), F.col("v"))
        best = F.max(F.struct(v.alias("v"), (-at).alias("at"))) if largest else F.min(F.struct(v.isNull().alias("none"), v.alias("v"), at.alias("at")))
        found = self.df.groupBy(*[f"i{k}" for k in kept]).agg(best.alias("b"))
        return found.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)], (-F.col("b.at") if largest else F.col("b.at")).alias("idx"))

    def argmin(self, axis: int | None = None) -> DataFrame:
        """Index of the first smallest element: (kept axes..., idx), the flat index without an axis."""
        return self._arg(axis, False)

    def argmax(self, axis: int | None = None) -> DataFrame:
        return self._arg(axis, True)

    def softmax(self, axis: int = -1) -> Tensor:
        shifted = self.sub(self.max(axis, True).detach()).exp()
        return shifted.div(shifted.sum(axis, True))

    # --- products -----------------------------------------------------------------------------

    def _thin(self, other: Tensor) -> Tensor | None:
        """The product, narrow in turn, if a factor repeats along one of its last axes: sums of the other factor, or the product of what repeats."""
        a, c = self.narrow, other.narrow
        if a is not None and a.shape[-1] < self.shape[-1]:
            return a.mul(other.sum(-2, True))
        if c is not None and c.shape[-2] < other.shape[-2]:
            return self.sum(-1, True).mul(c)
        if a is not None and a.shape[-2] < self.shape[-2]:
            return a.matmul(other)
        return self.matmul(c) if c is not None and c.shape[-1] < other.shape[-1] else None

    def matmul(self, other: Tensor) -> Tensor:
        """[..., n, k] by [..., k, m]; leading axes broadcast."""
        if self.ndim < 2 or other.ndim < 2 or self.shape[-1] != other.shape[-2]:
            raise ValueError(f"cannot multiply {self.shape} by {other.shape}")
        lead = broadcast_shape(self.shape[:-2], other.shape[:-2])
        b, shape = len(lead), (*lead, self.shape[-2], other.shape[-1])

        def back(g, out):
            a, c = self.detach(), other.detach()
            return [g.matmul(c.transpose(-1, -2))._unbroadcast(self.shape), a.transpose(-1, -2).matmul(g)._unbroadcast(other.shape)]

        with no_grad():
            thin = self.detach()._thin(other.detach())
            if thin is not None:
                thin = thin.expand(shape)
        if thin is not None:
            return thin._as(shape, [self, other], back)
        left, right, keys, own = _blocks(self, b, "l", False), _blocks(other, b, "r", True), [], []
        for k in range(b):
            in_l, in_r = f"l{k}" in left.columns, f"r{k}" in right.columns
            if in_l and in_r:
                keys.append(left[f"l{k}"] == right[f"r{k}"])
            own.append((left[f"l{k}"] if in_l else right[f"r{k}"] if in_r else F.lit(0).cast("long")).alias(f"i{k}"))
        on = fold(lambda x, y: x & y, keys, left["linner"] == right["rinner"])
        if other.numel <= BROADCAST_ELEMENTS:
            right = F.broadcast(right)
        elif self.numel <= BROADCAST_ELEMENTS:
            left = F.broadcast(left)
        else:
            # few inner blocks make few keys, so blocks are dealt to a square of shares, each side repeated along the other's
            share, every = (lambda c: F.pmod(F.col(c), F.lit(DEALS)).cast("int")), F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))
            left = left.withColumn("la", share("louter")).withColumn("lb", every)
            right = right.withColumn("rb", share("router")).withColumn("ra", every)
            on = on & (F.col("la") == F.col("ra")) & (F.col("lb") == F.col("rb"))
            right = right.hint("merge")  # blocks are larger than the planner takes them for
        n, m = shape[-2:]
        lead_names = axes(b)
        inner = self.shape[-1]
        schema = "".join(f"{c} long, " for c in lead_names) + "i long, j long, v array<double>"

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(len(batch)):
                    one = batch.slice(at, 1)
                    lo, ro, k = (one[c][0].as_py() for c in ("lo", "ro", "inner"))
                    x, y = _dense(one["le"][0], lo, k, n, inner), _dense(one["re"][0], ro, k, m, inner)
                    out = x @ y.T
                    value = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(y)), pa.array(out.reshape(-1)))
                    same = pa.array(np.zeros(len(x), dtype=np.int64))
                    place = [pa.array(lo * MATRIX_BLOCK + np.arange(len(x))), pa.array(np.full(len(x), ro * MATRIX_BLOCK))]
                    yield pa.RecordBatch.from_arrays([*(one[c].take(same) for c in lead_names), *place, value], names=[*lead_names, "i", "j", "v"])

        met = left.join(right, on).select(*own, F.col("louter").alias("lo"), F.col("router").alias("ro"), F.col("linner").alias("inner"), "le", "re").mapInArrow(products, schema)
        rows = met.select(*lead_names, F.col("i").alias(f"i{b}"), "j", F.posexplode("v").alias("p", "v")).select(*lead_names, f"i{b}", (F.col("j") + F.col("p")).alias(f"i{b + 1}"), "v")
        if self.shape[-1] > MATRIX_BLOCK:
            rows = rows.groupBy(*axes(b + 2)).agg(F.sum("v").alias("v"))
        return self._next(rows, shape, [self, other], back)

    __matmul__ = matmul

    def _patches(self, kh: int, kw: int, stride: int, padding: int, oh: int, ow: int) -> DataFrame:
        """(n, ci, ky, kx, oy, ox, v): every element under every tap that meets it."""
        ky, kx = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))) for k in (kh, kw))
        rows = self.df.withColumn("ky", ky).withColumn("kx", kx)
        y, x = F.col("i2") + padding - F.col("ky"), F.col("i3") + padding - F.col("kx")
        rows = rows.where((y >= 0) & (x >= 0) & (y % stride == 0) & (x % stride == 0))
        rows = rows.select(F.col("i0").alias("n"), F.col("i1").alias("ci"), "ky", "kx", (y / stride).cast("long").alias("oy"), (x / stride).cast("long").alias("ox"), "v")
        return rows.where((F.col("oy") < oh) & (F.col("ox") < ow))

    def conv2d(self, weight: Tensor, bias: Tensor | None = None, stride: int = 1, padding: int = 0) -> Tensor:
        """[n, ci, h, w] with [co, ci, kh, kw]: cross-correlation with zero padding."""
        if self.ndim != 4 or weight.ndim != 4 or self.shape[1] != weight.shape[1] or stride < 1 or padding < 0:
            raise ValueError(f"cannot convolve {self.shape} with {weight.shape}")
        n, _, h, w = self.shape
        co, ci, kh, kw = weight.shape
        oh, ow = (h + 2 * padding - kh) // stride + 1, (w + 2 * padding - kw) // stride + 1
        if oh < 1 or ow < 1 or (bias is not None and bias.shape != (co,)):
            raise ValueError("the kernel or the bias doesn't fit")
        shape = (n, co, oh, ow)
        taps = weight.df.select(F.col("i0").alias("co"), F.col("i1").alias("ci"), F.col("i2").alias("ky"), F.col("i3").alias("kx"), F.col("v").alias("wv"))
        taps = F.broadcast(taps) if weight.numel <= BROADCAST_ELEMENTS else taps
        met = self._patches(kh, kw, stride, padding, oh, ow).join(taps, ["ci", "ky", "kx"])
        rows = met.select(F.col("n").alias("i0"), F.col("co").alias("i1"), F.col("oy").alias("i2"), F.col("ox").alias("i3"), (F.col("v") * F.col("wv")).alias("v"))
        rows = self._completed(rows, shape).df  # an output whose taps all lie in the padding is 0
        src, ker = self.detach(), weight.detach()

        def back(g, out):
            grad = g.df.select(F.col("i0").alias("n"), F.col("i1").alias("co"), F.col("i2").alias("oy"), F.col("i3").alias("ox"), F.col("v").alias("gv"))
            y, x = F.col("oy") * stride + F.col("ky") - padding, F.col("ox") * stride + F.col("kx") - padding
            to_src = grad.join(ker.df.select(F.col("i0").alias("co"), F.col("i1").alias("ci"), F.col("i2").alias("ky"), F.col("i3").alias("kx"), F.col("v").alias("wv")), "co")
            to_src = to_src.select(F.col("n").alias("i0"), F.col("ci").alias("i1"), y.alias("i2"), x.alias("i3"), (F.col("gv") * F.col("wv")).alias("v")).where(f"i2 >= 0 and i3 >= 0 and i2 < {h} and i3 < {w}")
            to_ker = src._patches(kh, kw, stride, padding, oh, ow).join(grad, ["n", "oy", "ox"]).select(F.col("co").alias("i0"), F.col("ci").alias("i1"), F.col("ky").alias("i2"), F.col("kx").alias("i3"), (F.col("v") * F.col("gv")).alias("v"))
            return [g._completed(to_src, src.shape), g._completed(to_ker, ker.shape)]

        out = self._next(rows, shape, [self, weight], back)
        return out if bias is None else out.add(bias.reshape(1, co, 1, 1))

    # --- losses -------------------------------------------------------------------------------

    def mse(self, target) -> Tensor:
        return self.sub(target).square().mean()

    def cross_entropy(self, label: Tensor) -> Tensor:
        """Logits [b, c] and class ids [b]; mean of the negative log-softmax. Class ids outside the classes are an error."""
        if self.ndim != 2 or label.shape != self.shape[:1]:
            raise ValueError("logits [b, c] and labels [b] wanted")
        b, c = self.shape
        odd = label.df.where((F.col("v") < 0) | (F.col("v") >= c) | (F.col("v") != F.floor("v")))
        if not odd.isEmpty():
            raise ValueError("a label is no class")
        picked = label.df.select("i0", F.col("v").cast("long").alias("i1"), F.lit(1.0).alias("v"))
        one_hot = self._completed(picked, self.shape).detach()
        shifted = self.sub(self.max(1, True).detach())
        total = shifted.exp().sum(1).log()
        return total.sub(shifted.mul(one_hot).sum(1)).mean()

    # --- gradients ----------------------------------------------------------------------------

    def backward(self, grad: Tensor | None = None) -> None:
        """Adds the gradient of this tensor (seeded with ones) to every leaf it was made from."""
        spark = self.df.sparkSession
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p in node.parents if p.needs_grad]
        with no_grad():
            grads: dict[int, Tensor] = {id(self): grad.reshape(self.shape) if grad is not None else Tensor.ones(spark, self.shape)}
            for node in reversed(order):
                g = grads.pop(id(node), None)
                if g is None:
                    continue
                if not node.parents:
                    if g.narrow is not None:  # over the elements that the leaf has
                        g = _pointwise([node.detach(), g.detach()], lambda _, v: v, (), None)
                    node._grad = g if node._grad is None else summed([node._grad, g])
                    continue
                for parent, part in zip(node.parents, node.back(g, node.detach())):
                    if parent.needs_grad:
                        grads[id(parent)] = part if id(parent) not in grads else summed([grads[id(parent)], part])


def _pointwise(operands: Sequence[Tensor], f: Callable, parents: Sequence[Tensor], back: Callable | None) -> Tensor:
    """f of the operands, element by element. Columns of one sheet, and numbers, need no join; what repeats along axes is joined in its narrow form."""
    shape = broadcast_shape(*[t.shape for t in operands])
    lean = [t if t.narrow is None else t.narrow for t in operands]
    literal = f(*[t.literal for t in operands]) if all(t.literal is not None for t in operands) else None
    least = broadcast_shape(*[t.shape for t in lean])
    if least != shape:
        narrow = _pointwise([t.detach() for t in lean], f, (), None)
        return Tensor(None, shape, parents, back, narrow=narrow.reshape((1,) * (len(shape) - len(least)) + least) if len(least) < len(shape) else narrow, literal=literal)
    first = max(lean, key=lambda t: t.numel)
    (sheet, _), direct = first.at, first.shape == shape and all(t.literal is not None or (t.shape == shape and t.at[0] is first.at[0]) for t in lean)
    if direct:
        names = [None if t.literal is not None and t is not first else t.at[1] for t in lean]
    else:
        sheet, names = _Sheet(aligned(lean, shape)), [f"v{p}" for p in range(len(lean))]
    value = f(*[t.literal if n is None else F.col(n) for t, n in zip(lean, names)])
    return Tensor(None, shape, parents, back, at=(sheet, sheet.add(value, {n for n in names if n})), literal=literal)


def summed(parts: Sequence[Tensor]) -> Tensor:
    """Sum of tensors of one shape: added where they share a sheet or are small when narrow, else without a join."""
    shape, out = parts[0].shape, []
    for p in parts:
        for k, q in enumerate(out):
            if p.literal is not None or q.literal is not None or any(t.narrow is not None and t.narrow.numel <= BROADCAST_ELEMENTS for t in (p, q)) or (p.narrow is None and q.narrow is None and p.at[0] is q.at[0]):
                out[k] = q.add(p)
                break
        else:
            out.append(p)
    if len(out) == 1:
        return out[0]
    rows = fold(lambda a, b: a.unionByName(b), [p.df for p in out])
    return Tensor(rows.groupBy(*axes(len(shape))).agg(F.sum("v").alias("v")), shape)


def _blocks(t: Tensor, lead: int, side: str, swap: bool) -> DataFrame:
    """A factor as square blocks, under its side's letter: leading axes that aren't broadcast, the block's place on the outer and the inner axis, its elements as bytes."""
    off = lead - (t.ndim - 2)
    outer, inner = (t.ndim - 1, t.ndim - 2) if swap else (t.ndim - 2, t.ndim - 1)
    own = [f"{side}{k + off}" for k in range(t.ndim - 2) if t.shape[k] != 1]
    block = lambda k: F.floor(F.col(f"i{k}") / MATRIX_BLOCK).cast("long")
    place = (F.col(f"i{outer}") % MATRIX_BLOCK * MATRIX_BLOCK + F.col(f"i{inner}") % MATRIX_BLOCK).cast("int")
    lead_axes = [F.col(f"i{k}").alias(f"{side}{k + off}") for k in range(t.ndim - 2) if t.shape[k] != 1]
    lists = t.df.groupBy(*lead_axes, block(outer).alias(f"{side}outer"), block(inner).alias(f"{side}inner")).agg(F.collect_list(F.struct(place.alias("p"), "v")).alias("elements"))
    names, n, m = [*own, f"{side}outer", f"{side}inner"], t.shape[outer], t.shape[inner]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                rows, columns = (_extent(one[f"{side}{c}"][0].as_py(), size) for c, size in (("outer", n), ("inner", m)))
                yield pa.RecordBatch.from_arrays([*(one[c] for c in names), pa.array([_packed(one["elements"], rows, columns)], pa.binary())], names=[*names, f"{side}e"])

    return lists.mapInArrow(packed, "".join(f"{c} long, " for c in names) + f"{side}e binary")


def _extent(block: int, size: int) -> int:
    return min(MATRIX_BLOCK, size - block * MATRIX_BLOCK)


def _packed(elements: pa.Array, rows: int, columns: int) -> bytes:
    """A block from its elements, row by row; what isn't there is 0. In single precision if that holds every element exactly."""
    flat = elements.flatten()
    out = np.zeros(MATRIX_BLOCK * MATRIX_BLOCK)
    out[flat.field("p").to_numpy()] = flat.field("v").to_numpy(zero_copy_only=False)
    out = out.reshape(MATRIX_BLOCK, MATRIX_BLOCK)[:rows, :columns]
    with np.errstate(over="ignore", invalid="ignore"):
        short = out.astype(np.float32)
    return (short if np.array_equal(short, out, equal_nan=True) else out).tobytes()


def _dense(block: pa.Scalar, outer: int, inner: int, n: int, m: int) -> np.ndarray:
    """The matrix that ``_packed`` wrote, in double precision."""
    rows, columns, data = _extent(outer, n), _extent(inner, m), block.as_buffer()
    return np.frombuffer(data, dtype=np.float32 if data.size == rows * columns * 4 else np.float64).reshape(rows, columns).astype(np.float64)


def aligned(operands: Sequence[Tensor], shape: Sequence[int]) -> DataFrame:
    """i0.. and v0, v1, ..: all operands broadcast to one shape, joined on the axes that they share."""
    n = len(shape)

    def own(t: Tensor) -> set[int]:
        return {k for k in range(n) if k - n + t.ndim >= 0 and t.shape[k - n + t.ndim] != 1}

    def rows(t: Tensor, place: int) -> DataFrame:
        return t.df.select(*[F.col(f"i{k - n + t.ndim}").alias(f"i{k}") for k in sorted(own(t))], F.col("v").alias(f"v{place}"))

    by_size = sorted(range(len(operands)), key=lambda p: -operands[p].numel)
    have, out = own(operands[by_size[0]]), rows(operands[by_size[0]], by_size[0])
    for p in by_size[1:]:
        t = operands[p]
        other = rows(t, p)
        on = [f"i{k}" for k in sorted(have & own(t))]
        # by the shape: the planner doesn't see what generators and joins multiply, and would broadcast large sides
        other = F.broadcast(other) if t.numel <= BROADCAST_ELEMENTS else other.hint("merge") if on else other.hint("shuffle_replicate_nl")
        out = out.join(other, on) if on else out.crossJoin(other)
        have |= own(t)
    return out.select(*[F.col(f"i{k}") if k in have else F.lit(0).cast("long").alias(f"i{k}") for k in range(n)], *[f"v{p}" for p in range(len(operands))])


def cat(parts: Sequence[Tensor], axis: int = 0) -> Tensor:
    k = _axis(axis, parts[0].ndim)
    if any(p.shape[:k] + p.shape[k + 1 :] != parts[0].shape[:k] + parts[0].shape[k + 1 :] for p in parts):
        raise ValueError("shapes differ beyond the axis")
    starts = [sum(p.shape[k] for p in parts[:i]) for i in range(len(parts))]
    rows = fold(lambda a, b: a.unionByName(b), [p.df.withColumn(f"i{k}", F.col(f"i{k}") + s) for p, s in zip(parts, starts)])
    shape = list(parts[0].shape)
    shape[k] = sum(p.shape[k] for p in parts)
    return Tensor(rows, shape, list(parts), lambda g, out: [g.slice(k, s, s + p.shape[k]) for p, s in zip(parts, starts)])


def stack(parts: Sequence[Tensor], axis: int = 0) -> Tensor:
    return cat([p.unsqueeze(axis) for p in parts], axis)


def shuffle(parts: Sequence[Tensor], axis: int = 0, seed: int = 0) -> list[Tensor]:
    """One keyed permutation of an axis, the same for all tensors: an expression of the index, without a sort or a join."""
    k = _axis(axis, parts[0].ndim)
    size = parts[0].shape[k]
    if any(p.shape[k] != size for p in parts):
        raise ValueError("the axis differs in size")
    to = permuted(F.col(f"i{k}"), F.lit(size).cast("long"), F.lit(seed))
    return [Tensor(p.df.withColumn(f"i{k}", to), p.shape) for p in parts]
