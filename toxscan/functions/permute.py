"""A keyed permutation of 0..n-1 in column expressions: a random order without a sort.

A place ``i`` is written as two digits ``(i div b, i mod b)`` with ``a * b >= n`` and ``a``, ``b`` next to the root of ``n``. Each
round adds a keyed hash of one digit to the other, modulo that digit's base (a Feistel network over mixed bases), which is a
bijection of 0..a*b-1. Where a result is not below ``n`` the network is applied to it again (cycle walking), which makes
a bijection of 0..n-1; fewer than ``b`` places lie beyond ``n``, so this is rare and short.

Everything is integer arithmetic below 2**63, so any engine can compute the same order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Steps of cycle walking. Up to ``n`` = 4,096 no more than 64 places lie beyond ``n``, so no walk is longer; for greater ``n`` they
#: are less than a 64th of all places, and a walk of 64 steps has a chance below 64**-64. One that is longer stops the job.
WALK = 64
# Odd multipliers of the round hash.
MIX = (2654435761, 2246822519)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """31-bit keys from a seed."""
    return [int.from_bytes(hashlib.md5(f"{seed}:{r}".encode()).digest()[:4], "big") >> 1 for r in range(rounds)]


def bases(n: int) -> tuple[int, int]:
    """``(a, b)``: the least bases next to the root of ``n`` with ``a * b >= n``."""
    b = max(1, math.isqrt(n))
    return -(-n // b), b


def network(n: int, seed: int) -> Callable[[Column], Column]:
    """One pass of the network, as a function of a column with values in 0..a*b-1."""
    a, b = bases(n)

    def once(i: Column) -> Column:
        keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(r % 2).alias("side")) for r, k in enumerate(round_keys(seed))])

        def step(s: Column, k: Column) -> Column:
            left = F.when(k["side"] == 0, (s["l"] + _keyed(s["r"], k["k"])) % F.lit(a).cast("long")).otherwise(s["l"])
            right = F.when(k["side"] == 1, (s["r"] + _keyed(s["l"], k["k"])) % F.lit(b).cast("long")).otherwise(s["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        start = F.struct(((i - i % b) / b).cast("long").alias("l"), (i % b).cast("long").alias("r"))
        end = F.aggregate(keys, start, step)
        return end["l"] * F.lit(b).cast("long") + end["r"]

    return once


def _keyed(digit: Column, key: Column) -> Column:
    low = F.lit((1 << 31) - 1).cast("long")
    x = digit.bitwiseAND(low).bitwiseXOR(key) * F.lit(MIX[0]).cast("long")
    x = x.bitwiseXOR(F.shiftright(x, 29)).bitwiseAND(low) * F.lit(MIX[1]).cast("long")
    return x.bitwiseXOR(F.shiftright(x, 31)).bitwiseAND(low)


def permuted(place: Column, n: int, seed: int) -> Column:
    """The position of the row at ``place`` (0..n-1, unique) in a random order of ``n`` rows that ``seed`` fixes."""
    if n < 2:
        return place.cast("long")
    once = network(n, seed)
    steps = F.sequence(F.lit(1), F.lit(WALK))
    walked = F.aggregate(steps, once(place.cast("long")), lambda p, _: F.when(p < n, p).otherwise(once(p)))
    lost = F.raise_error(F.lit("a place was walked without an end")).cast("long")
    return F.when(walked < n, walked).otherwise(lost)
