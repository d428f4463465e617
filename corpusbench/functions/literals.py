"""Fixed arrays and maps as one SQL literal each.

A column per element would cost a driver round trip per element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value) -> str:
    """SQL text of a Python scalar or nested list; floats are doubles."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(text(v) for v in value) + ")"
    return str(value)


def array_literal(values: list) -> Column:
    return F.expr(text(values))


def map_literal(mapping: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in mapping.items()) + ")")
