"""A seeded permutation of row numbers that can be looked up in either direction without sorting.

Numbers below n are written as pairs (left, right) of an a x b grid that is
little larger than n. Each Feistel round adds a draw of one half to the
other, which can be undone, so the rounds permute the grid. A number that
leaves the first n goes through the rounds again ("cycle walking"); as only
a * b - n numbers lie outside, so many further steps always suffice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: How many widths of the grid are tried for one that leaves few numbers outside.
WIDTHS = 50_000


def grid(n: int) -> tuple[int, int]:
    """a and b with a * b >= n, as few over as a width near the root allows; the wider one of equal ones."""
    top = max(1, math.isqrt(n))
    widths = range(max(1, top // 2, top - WIDTHS), top + 1)
    a = min(widths, key=lambda a: (-n % a, -a))
    return a, -(-n // a)


class Permutation:
    """Places 0 to n - 1 of rows 0 to n - 1 under a key."""

    def __init__(self, n: int, key: str, rounds: int = ROUNDS) -> None:
        if n < 0:
            raise ValueError("a permutation needs a number of rows")
        self.n, self.key, self.rounds = n, key, rounds
        self.a, self.b = grid(max(1, n))
        self.outside = self.a * self.b - max(1, n)

    def _draw(self, i: Column, half: Column) -> Column:
        text = F.concat_ws("|", F.lit(self.key), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

    def _rounds(self, x: Column, back: bool) -> Column:
        order = F.sequence(F.lit(self.rounds - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(self.rounds - 1))
        sign = -1 if back else 1
        right = x % F.lit(self.b)
        start = F.struct(((x - right) / F.lit(self.b)).cast("long").alias("l"), right.alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.lit(sign) * (self._draw(i, s["r"]) % F.lit(self.a)), F.lit(self.a)).cast("long")
            right = F.pmod(s["r"] + F.lit(sign) * (self._draw(i, s["l"]) % F.lit(self.b)), F.lit(self.b)).cast("long")
            even = i % 2 == 0
            return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

        return F.aggregate(order, start, turn, lambda s: s["l"] * F.lit(self.b) + s["r"])

    def _walk(self, x: Column, back: bool) -> Column:
        once = self._rounds(x, back)
        if not self.outside:
            return once
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.outside)), once, lambda y, _: F.when(y >= self.n, self._rounds(y, back)).otherwise(y))

    def place(self, row: Column) -> Column:
        """Where a row comes in the order."""
        return self._walk(row.cast("long"), False)

    def row(self, place: Column) -> Column:
        """Which row comes at a place."""
        return self._walk(place.cast("long"), True)
