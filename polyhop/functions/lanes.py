"""The lane algebra: operations on K instance columns, plain or only on the lanes of a mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Lanes = list[Column]
BINARY = {
    "set": lambda a, b: b, "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b,
    "min": F.least, "max": F.greatest, "or": lambda a, b: a | b, "and": lambda a, b: a & b, "andnot": lambda a, b: a & ~b,
    "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "eq": lambda a, b: a == b, "neq": lambda a, b: a != b,
    "bit_or": Column.bitwiseOR, "bit_and": Column.bitwiseAND, "bit_xor": Column.bitwiseXOR,
}


def lanes(prefix: str, k: int) -> Lanes:
    return [F.col(f"{prefix}{i}") for i in range(k)]


def set_all(k: int, value) -> Lanes:
    return [F.lit(value)] * k


def set_single(a: Lanes, i: int, value) -> Lanes:
    return [F.lit(value) if j == i else x for j, x in enumerate(a)]


def op(name: str, a: Lanes, b: Lanes | Column, mask: Lanes | None = None) -> Lanes:
    """b: lanes, or one column for all. Lanes outside the mask keep a."""
    b = b if isinstance(b, list) else [b] * len(a)
    out = [BINARY[name](x, y) for x, y in zip(a, b, strict=True)]
    return out if mask is None else [F.when(m, o).otherwise(x) for m, o, x in zip(mask, out, a, strict=True)]


def negate(a: Lanes, mask: Lanes | None = None) -> Lanes:
    return [~x if mask is None else F.when(m, ~x).otherwise(x) for x, m in zip(a, mask or a, strict=True)]


def or_update(a: Lanes, b: Lanes, mask: Lanes | None = None) -> tuple[Lanes, Column]:
    """The new lanes, and whether any lane is newly set."""
    new = op("or", a, b, mask)
    return new, reduce(Column.__or__, [n & ~x for n, x in zip(new, a, strict=True)])


def all_zeros(a: Lanes) -> Column:
    return ~reduce(Column.__or__, a)


def named(a: Lanes, prefix: str) -> Lanes:
    return [x.alias(f"{prefix}{i}") for i, x in enumerate(a)]
