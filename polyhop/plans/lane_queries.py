"""Queries for each operation of the lane algebra, on four lanes a vertex of the main graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lanes as L
from .queries import E, V, graph, query

K = 4
#: Lane i of a and of b, and the mask, at a vertex.
NUMBERS = {"a": lambda i: f"id * {7 + i} % 10 + 1", "b": lambda i: f"id * {3 + i} % 10 + 1"}
FLAGS = {"a": lambda i: f"id * {7 + i} % 3 = 0", "b": lambda i: f"id * {3 + i} % 2 = 0"}
MASK = lambda i: f"(id + {i}) % 2 = 0"
#: SQL of each operation on x and y, and whether its lanes are flags.
OPERATIONS = {
    "set": ("{y}", False), "add": ("{x} + {y}", False), "sub": ("({x}) - ({y})", False), "mul": ("({x}) * ({y})", False),
    "div": ("({x}) / CAST({y} AS DOUBLE)", False), "min": ("least({x}, {y})", False), "max": ("greatest({x}, {y})", False),
    "gt": ("({x}) > ({y})", False), "ge": ("({x}) >= ({y})", False), "lt": ("({x}) < ({y})", False), "le": ("({x}) <= ({y})", False),
    "eq": ("({x}) = ({y})", False), "neq": ("({x}) <> ({y})", False),
    "bit_or": ("({x}) | ({y})", False), "bit_and": ("({x}) & ({y})", False), "bit_xor": ("xor({x}, {y})", False),
    "or": ("({x}) OR ({y})", True), "and": ("({x}) AND ({y})", True), "andnot": ("({x}) AND NOT ({y})", True),
}


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).vertices.select("id")


def _lanes(kind: dict, name: str) -> list:
    return [F.expr(kind[name](i)) for i in range(K)]


def _sql(parts: list[str], prefix: str = "r") -> str:
    return f"WITH {E}, {V} SELECT id, " + ", ".join(f"{x} AS {prefix}{i}" for i, x in enumerate(parts)) + " FROM v"


def _register(name: str, parts: list[str], lanes) -> None:
    query(name, _sql(parts))(lambda s, d: _vertices(s, d).select("id", *L.named(lanes(), "r")))


def _operation(op: str, sql: str, flags: bool) -> None:
    kind = FLAGS if flags else NUMBERS
    each = [sql.format(x=kind["a"](i), y=kind["b"](i)) for i in range(K)]
    _register(f"lanes_{op}", [f"round({x}, 9)" if op == "div" else x for x in each], lambda: [F.round(c, 9) if op == "div" else c for c in L.op(op, _lanes(kind, "a"), _lanes(kind, "b"))])
    if op in ("set", "add", "min", "max", "mul", "or", "andnot"):
        masked = [f"CASE WHEN {MASK(i)} THEN {x} ELSE {kind['a'](i)} END" for i, x in enumerate(each)]
        _register(f"lanes_{op}_masked", masked, lambda: L.op(op, _lanes(kind, "a"), _lanes(kind, "b"), [F.expr(MASK(i)) for i in range(K)]))


for _op, (_form, _flags) in OPERATIONS.items():
    _operation(_op, _form, _flags)

_register("lanes_negate", [f"NOT ({FLAGS['a'](i)})" for i in range(K)], lambda: L.negate(_lanes(FLAGS, "a")))
_register("lanes_set_all", ["5"] * K, lambda: L.set_all(K, 5))
_register("lanes_set_single", [NUMBERS["a"](i) if i != 2 else "CAST(0 AS BIGINT)" for i in range(K)], lambda: L.set_single(_lanes(NUMBERS, "a"), 2, F.lit(0).cast("bigint")))
_register("lanes_get_single", [NUMBERS["a"](1)], lambda: [_lanes(NUMBERS, "a")[1]])
_zeros = " OR ".join(FLAGS["a"](i) for i in range(K))
_register("lanes_all_zeros", [f"NOT ({_zeros})"], lambda: [L.all_zeros(_lanes(FLAGS, "a"))])


@query("lanes_or_update", _sql([f"({FLAGS['a'](i)}) OR ({FLAGS['b'](i)})" for i in range(K)] + [" OR ".join(f"(({FLAGS['b'](i)}) AND NOT ({FLAGS['a'](i)}))" for i in range(K))]))
def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new lanes, and as the last one whether any is newly set."""
    new, any_ = L.or_update(_lanes(FLAGS, "a"), _lanes(FLAGS, "b"))
    return _vertices(spark, sf_dir).select("id", *L.named([*new, any_], "r"))
