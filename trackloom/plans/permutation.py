"""Keyed permutations of row numbers: where a row goes follows from its number alone, without a shuffle.

The numbers below ``n`` are laid out in a grid of ``a`` columns and just enough rows. Each round of the
network (Feistel's, for grids that are no powers of two: Black and Rogaway, 2002) shifts one coordinate by a
hash of the other, which can be undone, so every round permutes the grid. A number that lands in the unfilled
end of the grid walks on until it is inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647     # the product of two residues fits a long
FACTOR = 48271
ROUNDS = 6
STEPS = 64             # the unfilled end has fewer than sqrt(n) places: no walk is longer up to n = 4096, nor likely above


def grid_side(n: int) -> int:
    return max(math.isqrt(max(n - 1, 0)) + 1, 1)


def permuted(row: Column, n: int, seed: int, repeat: int) -> Column:
    """The place, below ``n``, of row number ``row`` in permutation ``repeat`` of ``seed``; ``n`` below 2^53."""
    a = grid_side(n)
    b = -(-n // a)
    keys = F.array(*[F.lit((seed * 1299709 + repeat * 104729 + turn * 7919 + 1) % PRIME).cast("long")
                     for turn in range(ROUNDS)])

    def mix(value: Column, key: Column) -> Column:
        once = (value % PRIME * FACTOR + key) % PRIME
        return (once * once + key) % PRIME

    def turn(at: Column, step: Column) -> Column:
        key = F.element_at(keys, step + 1)
        return (F.when(step % 2 == 0, F.struct(((at["l"] + mix(at["r"], key)) % a).alias("l"), at["r"].alias("r")))
                 .otherwise(F.struct(at["l"].alias("l"), ((at["r"] + mix(at["l"], key)) % b).alias("r"))))

    def network(value: Column) -> Column:
        value = value.cast("long")
        start = F.struct((value % a).alias("l"), ((value - value % a) / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda at: at["r"] * a + at["l"])

    def walked(at: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(STEPS))
        return F.when(at < n, at).otherwise(F.aggregate(steps, at, lambda on, _: F.when(on < n, on).otherwise(network(on))))

    return F.element_at(F.transform(F.array(network(row)), walked), 1)     # few rows walk on
