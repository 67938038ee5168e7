"""Element-wise functions on double columns with IEEE results.

Spark raises on division by zero, gives NULL for the logarithm of a non-positive
number and orders NaN above everything; these functions give infinities and NaN
instead. A NULL stays NULL.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _c(x: Column | float | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def neg(x):
    return -_c(x)


def absolute(x):
    return F.abs(_c(x))


def sign(x):
    """-1, 0 or 1; 0 for NaN."""
    x = _c(x)
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.signum(x))


def square(x):
    x = _c(x)
    return x * x


def sqrt(x):
    return F.sqrt(_c(x))


def rsqrt(x):
    x = _c(x)
    return F.when(x == 0, F.lit(INF)).otherwise(F.try_divide(F.lit(1.0), F.sqrt(x)))


def exp(x):
    return F.exp(_c(x))


def log(x):
    x = _c(x)
    return F.when(x == 0, F.lit(-INF)).when(F.isnan(x) | (x < 0), F.lit(NAN)).otherwise(F.log(x))


def relu(x):
    """0 for NaN."""
    x = _c(x)
    return F.when((x > 0) & ~F.isnan(x), x).when(x.isNotNull(), F.lit(0.0))


def sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def tanh(x):
    return F.tanh(_c(x))


def add(a, b):
    return _c(a) + _c(b)


def sub(a, b):
    return _c(a) - _c(b)


def mul(a, b):
    return _c(a) * _c(b)


def div(a, b):
    """x / 0 is an infinity of x's sign, 0 / 0 and NaN / 0 are NaN; the sign of a zero divisor isn't seen."""
    a, b = _c(a), _c(b)
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def power(a, b):
    """1 to the power of anything, and -1 to that of an infinity, are 1."""
    a, b = _c(a), _c(b)
    one = ((a == 1) & b.isNotNull()) | ((a == -1) & (F.abs(b) == INF))
    return F.when(one, F.lit(1.0)).otherwise(F.pow(a, b))


def _libm(x: float, y: float) -> float:
    try:
        return math.pow(x, y)
    except (OverflowError, ValueError):  # infinities and NaN, which have no last bits
        with np.errstate(all="ignore"):
            return float(np.power(x, y))


def power_libm(a, b):
    """As power, by the C library of the workers: SQL engines in C give these bits, Spark's own can differ in the last one."""

    @F.arrow_udf("double")
    def powers(x: pa.Array, y: pa.Array) -> pa.Array:
        p, q = (c.to_numpy(zero_copy_only=False).tolist() for c in (x, y))  # a NULL is NaN there
        try:
            out = list(map(math.pow, p, q))
        except (OverflowError, ValueError):
            out = list(map(_libm, p, q))
        return pa.array(np.array(out, dtype=np.float64), mask=np.logical_or(*(c.is_null().to_numpy(zero_copy_only=False) for c in (x, y))))

    return powers(_c(a), _c(b))


def rounded(x, digits: int):
    """To digits after the point in binary arithmetic, halves away from 0, as SQL engines in C round; Spark rounds the shortest decimal form."""
    x, scale = _c(x), 10.0**digits
    y = x * scale
    r = F.rint(y)
    r = F.when(F.abs(y - r) == 0.5, y + F.signum(y) * 0.5).otherwise(r)
    return F.when(F.isnan(y) | (F.abs(y) == INF), x).otherwise(r / scale)


def where(condition, a, b):
    """a where the condition is true or a number other than 0 (NaN is), else b."""
    c = condition if isinstance(condition, Column) else F.col(condition)
    c = c.cast("double")
    return F.when((c != 0) | F.isnan(c), _c(a)).otherwise(_c(b))


def clamp(x, low, high):
    """greatest(low, least(high, x)): NaN becomes high."""
    x, low, high = _c(x), _c(low), _c(high)
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


UNARY = {f.__name__: f for f in (neg, absolute, sign, square, sqrt, rsqrt, exp, log, relu, sigmoid, tanh)}
BINARY = {f.__name__: f for f in (add, sub, mul, div, power)}
TERNARY = {f.__name__: f for f in (where, clamp)}
