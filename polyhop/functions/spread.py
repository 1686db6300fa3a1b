"""A hash of ids in integer arithmetic that any SQL engine gives alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime; hashes are from 0 to it, exclusive.
RANGE = 2_147_483_647


def spread_sql(key: str, seed: int) -> str:
    """SQL for the hash of an integer expression: a linear step, a square and a linear step, none beyond 63 bits."""
    x = f"(((({key}) % {RANGE} + {RANGE}) % {RANGE}) * 48271 + {seed % 10_007 * 7919 + 1}) % {RANGE}"
    return f"((({x}) * ({x}) + ({x}) + {seed % 10_007}) % {RANGE} * 69621 + 1) % {RANGE}"


def spread(key: str, seed: int) -> Column:
    return F.expr(spread_sql(key, seed))
