"""Seeded uniforms that any engine with md5 can reproduce.

A draw depends on the seed and the row's own key only, never on the
partition, the task or the row order, so a lost executor replays the
same draws.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbench.functions.literals import array_literal

TWO_32 = 4294967296.0


def uniform(seed: str | int, *keys: Column) -> Column:
    """Uniform double in [0, 1) drawn from ``md5(seed|key|...)``."""
    return uniform_of(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform_of(text: Column) -> Column:
    """The draw of a text ``seed|key|...`` that the caller has put together."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def normal(seed: str | int, *keys: Column) -> Column:
    """Standard normal by Box-Muller over two seeded uniforms."""
    u1 = F.greatest(uniform(f"{seed}.a", *keys), F.lit(1e-12))
    u2 = uniform(f"{seed}.b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def choice(u: Column, values: list) -> Column:
    """Pick one of ``values`` with equal probability from a uniform."""
    return F.get(array_literal(values), F.floor(u * F.lit(float(len(values)))).cast("int"))
