"""Keyed permutations of a range as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 32
SEED = 20240501


def permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Swap-or-not: each round reflects the index below n at a keyed point, or not, by one bit that both ends share."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, r), n) - x, n)
        bit = F.xxhash64(F.lit(SEED + 1), key, r, F.greatest(x, other)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), step)
