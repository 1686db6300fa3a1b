"""Block-centric programs: a block of vertices converges by itself before anything is sent to other blocks.

Modes: ``V`` sends along every edge each superstep, as vertex programs do; ``B`` lets blocks converge and sends along edges
between blocks; ``VB`` does a superstep of V, then lets blocks converge. Values are longs that combine by their minimum,
NULL for a vertex not reached, so the three modes end in the same state. A block is one task's work and should fit its
memory; blocks are as the caller makes them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Direction, Graph
from ..tables import cut, release, ship
from .bsp import Result

MODES = ("V", "B", "VB")
_FAR = np.int64(2**62)


def converge(ids: np.ndarray, values: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The fixpoint of values[dst] = min(values[dst], values[src] + weight) in one block. ids are ascending."""
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    values = values.copy()
    live = np.ones(len(ids), bool)
    while live.any():
        go = live[s] & (values[s] < _FAR)
        new = values.copy()
        np.minimum.at(new, d[go], values[s[go]] + weight[go])
        live, values = new < values, new
    return values


def run_blocks(graph: Graph, blocks: DataFrame, start: DataFrame, weight: str | None = None, mode: str = "B", direction: Direction = Direction.IN, max_iterations: int = 100) -> Result:
    """blocks: (id, block). start: (id, value) of the vertices that begin. weight: an edge column that is added on the way,
    by default 0. The result's rows are (id, value) of the vertices reached."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    ship(graph.spark)
    cost = F.col(weight).cast("bigint") if weight else F.lit(0).cast("bigint")
    ends = [blocks.select(F.col("id").alias(e), F.col("block").alias(f"{e}_block")) for e in ("src", "dst")]
    edges = graph.along(direction).select("src", "dst", cost.alias("cost")).join(ends[0], "src").join(ends[1], "dst")
    edges = cut(edges, "edges")
    inner = edges.where(F.col("src_block") == F.col("dst_block")).select(F.col("src_block").alias("block"), "src", "dst", "cost")
    sends = edges if "V" in mode else edges.where(F.col("src_block") != F.col("dst_block"))
    state = graph.vertices.select("id").join(blocks, "id").join(start.select("id", F.col("value").cast("bigint").alias("value")), "id", "left")
    state = cut(state.withColumn("changed", F.col("value").isNotNull()))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        left = left.sort_by("id")
        ids, before = left.column("id").to_numpy(), left.column("value").fill_null(int(_FAR)).to_numpy()
        after = converge(ids, before, *(right.column(c).to_numpy() for c in ("src", "dst", "cost")))
        changed = left.column("changed").to_numpy(zero_copy_only=False) | (after < before)
        return pa.table({"id": ids, "block": left.column("block"), "value": pa.array(after, mask=after >= _FAR), "changed": changed})

    status, step = "max_iterations", 0
    for step in range(max_iterations + 1):
        if "B" in mode:
            before = state
            state = cut(state.groupBy("block").cogroup(inner.groupBy("block")).applyInArrow(local, "id bigint, block bigint, value bigint, changed boolean"))
            release(before)
        if state.where("changed").isEmpty():
            status = "task_depletion"
            break
        if step == max_iterations:
            break
        sent = state.where("changed").join(sends, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min(F.col("value") + F.col("cost")).alias("acc"))
        both = state.join(sent, F.col("id") == F.col("to"), "left")
        better = F.col("acc").isNotNull() & (F.col("value").isNull() | (F.col("acc") < F.col("value")))
        before = state
        state = cut(both.select("id", "block", F.when(better, F.col("acc")).otherwise(F.col("value")).alias("value"), better.alias("changed")))
        release(before)
    release(edges)
    return Result(state.where(F.col("value").isNotNull()).select("id", "value"), status, step)
