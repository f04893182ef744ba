"""Seeded choices in whole-number arithmetic that any SQL engine repeats: hashes, draws, and permutations of 0..n-1.

A permutation is a Feistel network over pairs of digits of a square a little
larger than n; places that land beyond n go through it again until they do not.
It is a one-to-one map, so shuffling a column is one equi-join on row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647
KEYS = (7_919, 104_729, 1_299_709, 15_485_863)
# A place lands beyond n with a probability below 2 / sqrt(n) + 1 / n, so this many passes are never all needed.
PASSES = 32


def mixed(x: Column, key: Column | int) -> Column:
    """A hash below ``PRIME`` of a whole number and a key; no step leaves 64 bits."""
    key = F.lit(key) if isinstance(key, int) else key
    z = F.pmod(F.pmod(x, F.lit(PRIME)) * F.lit(48_271) + key, F.lit(PRIME))
    steps = F.array(F.lit(16_807), F.lit(39_373), F.lit(69_621))
    return F.aggregate(steps, z.cast("long"), lambda a, s: F.pmod(a * a + a * s + key, F.lit(PRIME)).cast("long"))


def mixed_sql(x: str, key: str) -> str:
    z = f"((({x}) % {PRIME}) * 48271 + ({key})) % {PRIME}"
    return f"list_reduce([CAST({z} AS BIGINT), 16807, 39373, 69621], lambda a, s: (a * a + a * s + ({key})) % {PRIME})"


def permuted_place(place: Column, n: Column, seed: Column) -> Column:
    """Where ``place`` (0 to n - 1) goes; one-to-one for each seed."""
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def rounds(x: Column) -> Column:
        keys = F.array(*[F.lit(k) for k in KEYS])
        return F.aggregate(
            keys, x, lambda v, k: F.pmod(v, side) * side + F.pmod(F.floor(v / side) + mixed(F.pmod(v, side), k + seed), side)
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), rounds(place.cast("long")), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))


def permuted_place_sql(place: str, n: str, seed: str) -> str:
    side = f"CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)"

    def rounds(x: str) -> str:
        keys = ", ".join(map(str, KEYS))
        return f"list_reduce([CAST({x} AS BIGINT), {keys}], lambda v, k: (v % {side}) * {side} + (v // {side} + {mixed_sql(f'v % {side}', f'k + {seed}')}) % {side})"

    passes = ", ".join(["1"] * PASSES)
    return f"list_reduce([{rounds(place)}, {passes}], lambda x, t: CASE WHEN x < {n} THEN x ELSE {rounds('x')} END)"
