"""Squared Euclidean distances and histogram bins as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float | None, ...] | None
#: Up to this many bins are a CASE chain, which stays inside generated code.
CASE_BINS = 100


def box_of(periodic: float | Sequence[float | None] | None, dim: int) -> Box:
    """One length an axis; None or infinity is an open axis; None when all are open."""
    if periodic is None:
        return None
    sides = (periodic,) * dim if isinstance(periodic, (int, float)) else tuple(periodic)
    if len(sides) != dim:
        raise ValueError(f"{len(sides)} box lengths for {dim} dimensions")
    sides = tuple(None if s is None or math.isinf(s) else float(s) for s in sides)
    if any(s is not None and not s > 0 for s in sides):
        raise ValueError("box lengths must be positive")
    return None if all(s is None for s in sides) else sides


def axis_distance(a: Column, b: Column, side: float | None) -> Column:
    """|a - b|, or in a periodic box the shorter way round (both within one box length of each other)."""
    if side is None:
        return a - b
    d = F.abs(a - b)
    return F.when(d > F.lit(side / 2), F.lit(side) - d).otherwise(d)


def squared_distance(a: Sequence[Column], b: Sequence[Column], box: Box = None) -> Column:
    """Unrolled, summed from the first axis to the last."""
    parts = [axis_distance(x, y, box[i] if box else None) for i, (x, y) in enumerate(zip(a, b))]
    return reduce(lambda t, d: t + d * d, parts[1:], parts[0] * parts[0])


def bin_index(d2: Column, radii: Sequence[float]) -> Column:
    """Index of the first of the ascending radii with radius² >= d2; NULL beyond the last."""
    squares = [r * r for r in radii]
    if len(squares) <= CASE_BINS:
        out = F.when(d2 <= F.lit(squares[0]), F.lit(0))
        for k, s in enumerate(squares[1:], 1):
            out = out.when(d2 <= F.lit(s), F.lit(k))
        return out
    below = F.size(F.filter(F.array(*map(F.lit, squares)), lambda s: s < d2))
    return F.when(d2 <= F.lit(squares[-1]), below)
