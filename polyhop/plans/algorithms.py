"""Vertex programs and graph algorithms."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spread import RANGE, spread
from ..sources.graph import Direction, Graph
from ..tables import cut, release, ship
from .bsp import Result, VertexProgram, run

DAMP = 0.15
LATENT, STEP, DECAY = 5, 1e-3, 1e-3
#: Gradient steps at most.
MAX_UPDATES = 20
#: Edges, or vertices and edges, that one task takes in order.
BATCH = 2**20


def bbfs(directed: bool = True) -> VertexProgram:
    """Reachability."""
    return VertexProgram("bbfs", lambda v, e: v, "or", lambda old, acc, s: F.coalesce(old, acc), F.lit(True), "boolean", _way(directed))


def ibfs(directed: bool = True) -> VertexProgram:
    """Hops from the source."""
    return VertexProgram("ibfs", lambda v, e: v + 1, "min", lambda old, acc, s: F.coalesce(old, acc), F.lit(0), "bigint", _way(directed))


def sssp(directed: bool = True, weight: str = "w") -> VertexProgram:
    """Shortest distances; sums are 64-bit and an absent row is unreached."""
    return VertexProgram("sssp", lambda v, e: v + e(weight), "min", lambda old, acc, s: F.least(old, acc), F.lit(0), "bigint", _way(directed))


def spmv(weight: str = "w") -> VertexProgram:
    """x <- A'x at every vertex, from the source's unit vector."""
    return VertexProgram("spmv", lambda v, e: v * e(weight), "sum", lambda old, acc, s: F.coalesce(acc, F.lit(0.0)), F.lit(1.0), "double", dense=True, default=F.lit(0.0))


def ppr(damp: float = DAMP) -> VertexProgram:
    """r <- damp P'r + (1 - damp) e_s, from (1 - damp) e_s."""
    back = F.lit(1 - damp)
    new = lambda old, acc, s: F.coalesce(acc, F.lit(0.0)) * F.lit(damp) + F.when(s, back).otherwise(F.lit(0.0))
    return VertexProgram("ppr", lambda v, e: v / e("src_deg"), "sum", new, back, "double", dense=True, default=F.lit(0.0), degree=True)


def lowest_free(mask: Column) -> Column:
    """The lowest bit that a mask of 62 bits doesn't have."""
    return (mask + 1).bitwiseAND(F.bitwise_not(mask))


def coloring() -> VertexProgram:
    """Each vertex with coloured neighbours takes the lowest colour bit that none of them has, all at once; odd
    structures may swap colours for ever, so the number of iterations is given."""
    new = lambda old, acc, s: F.when(F.coalesce(acc, F.lit(0)) != 0, lowest_free(acc)).otherwise(old)
    return VertexProgram("coloring", lambda v, e: v, "bit_or", new, F.lit(1), "bigint", Direction.ALL, dense=True, default=F.lit(0))


def _way(directed: bool) -> Direction:
    return Direction.IN if directed else Direction.ALL


def proper_coloring(graph: Graph, max_iterations: int = 1000) -> Result:
    """A valid colouring: in the order of their hashes, vertices take the lowest colour that no neighbour has. (id, color):
    colours count from 0, NULL is uncoloured. A round colours the next vertices of the order, as many as have at most
    BATCH edges among them: those with such edges one by one in one task, from the colours that earlier rounds left
    them, and the others by themselves. Only a single hash's vertices may have more edges than that."""
    order = lambda c: F.struct(spread(c, 0), F.col(c))
    pairs = graph.undirected().edges.where(order("src") < order("dst")).select(F.col("src").alias("a"), spread("src", 0).alias("ha"), F.col("dst").alias("b"), spread("dst", 0).alias("hb"))
    edges = cut(pairs.repartitionByRange("hb", "b", "a").sortWithinPartitions("hb"))
    left = cut(graph.vertices.select("id", spread("id", 0).alias("h")))
    done, low, step = [], 0, 0
    while low < RANGE and step < max_iterations:
        high, step = _until(edges, low), step + 1
        inner = edges.where((F.col("ha") >= low) & (F.col("hb") < high))
        ends = inner.select(F.col("b").alias("id"), "a").union(inner.select("a", F.lit(None).cast("bigint")))
        ends = ends.groupBy("id").agg(F.collect_set("a").alias("near"))
        both = left.where((F.col("h") >= low) & (F.col("h") < high)).join(ends, "id", "left")
        few = F.lit(0)
        if done:
            taken = edges.where((F.col("ha") < low) & (F.col("hb") >= low) & (F.col("hb") < high)).join(reduce(DataFrame.union, done).withColumnRenamed("id", "a"), "a")
            taken = taken.select(F.col("b").alias("id"), "color").distinct().groupBy("id").agg(F.collect_list("color").alias("taken"))
            both, few = both.join(taken, "id", "left"), F.coalesce(F.size("taken"), F.lit(0))
        # as many free colours as the neighbours of this round can take, and one more
        most = F.coalesce(F.size("near"), F.lit(0)) + 1
        free = F.sequence(F.lit(0).cast("bigint"), (few + most - 1).cast("bigint"))
        free = F.slice(F.array_except(free, F.coalesce("taken", F.array().cast("array<bigint>"))) if done else free, F.lit(1), most)
        both = cut(both.select("id", "h", "near", free.alias("free")))
        one = _in_one_task(both.where("near IS NOT NULL"), _colors, "id bigint, color bigint")
        done = _piled(done, cut(both.where("near IS NULL").select("id", F.element_at("free", 1).alias("color")).union(one)))
        release(both)
        low = high
    rest = left.where(F.col("h") >= low).select("id", F.lit(None).cast("bigint").alias("color"))
    release(edges)
    return Result(reduce(DataFrame.union, [*done, rest]), "task_depletion" if low == RANGE else "max_iterations", step)


def color_bit(color: Column) -> Column:
    """A colour's number as a bit; a bigint has 63."""
    return F.when(color < 63, F.call_function("shiftleft", F.lit(1).cast("bigint"), color.cast("int"))).when(color >= 63, F.raise_error(F.lit("more than 63 colours: no bit is left")).cast("bigint"))


def _until(edges: DataFrame, low: int, parts: int = 4096) -> int:
    """The end of the hashes from low that have at most BATCH edges among them, found in some thousandths of the range, or
    of its first such part and so on, if that has too many; one hash at least."""
    rows, width = edges.where(F.col("ha") >= low), RANGE - low
    while True:
        size = -(-width // parts)
        part = F.floor((F.col("hb") - low) / size)
        counts = rows.where(F.col("hb") < low + width).groupBy(part.alias("part")).count().collect()  # a row a part
        total = 0
        for at, n in sorted(counts):
            total += n
            if total > BATCH:
                break
        else:
            return low + width
        if at or size == 1:
            return low + max(at, 1) * size
        width = size


def _in_one_task(df: DataFrame, f, schema: str) -> DataFrame:
    """f of all rows, which must be few."""
    ship(df.sparkSession)
    return df.groupBy().applyInArrow(f, schema)


def _lists(column: pa.ChunkedArray) -> tuple[list[int], list[int]]:
    """All numbers of a column of lists, and where each list begins, and the end."""
    ends = np.cumsum(pc.list_value_length(column).to_numpy())
    return pc.list_flatten(column).to_numpy().tolist(), [0, *ends.tolist()]


def _colors(rows: pa.Table) -> pa.Table:
    """rows (id, h, near, free): by h and id each takes its first free colour that no earlier one of near has taken."""
    rows = rows.sort_by([("h", "ascending"), ("id", "ascending")])
    ids, (near, n), (free, f), color = rows.column("id").to_pylist(), _lists(rows.column("near")), _lists(rows.column("free")), {}
    for i, v in enumerate(ids):
        taken = {color[u] for u in near[n[i] : n[i + 1]]}
        color[v] = next(c for c in free[f[i] : f[i + 1]] if c not in taken)
    return pa.table({"id": pa.array(ids, pa.int64()), "color": pa.array(color.values(), pa.int64())})


def _piled(tables: list[DataFrame], more: DataFrame) -> list[DataFrame]:
    """Tables of ``cut`` and one more, in few tables."""
    tables = [*tables, more]
    if len(tables) < 16:
        return tables
    out = cut(reduce(DataFrame.union, tables))
    release(*tables)
    return [out]


def pagerank(graph: Graph, iterations: int = 10, tolerance: float | None = None) -> Result:
    """0.15 + 0.85 sum(rank / out-degree) from 1 at every vertex; with a tolerance only vertices whose in-neighbours moved
    by more are counted anew, and each keeps its sum up to date by the changes."""
    edges = cut(graph.with_out_degree().select("src", "dst", "src_deg"))
    state = cut(graph.vertices.select("id", F.lit(1.0).alias("rank"), F.lit(0.0).alias("acc"), F.lit(1.0).alias("delta")))
    for step in range(iterations):
        moved = state if tolerance is None else state.where(F.abs("delta") > tolerance)
        if tolerance is not None and moved.isEmpty():
            return Result(state.select("id", F.col("rank").alias("value")), "task_depletion", step)
        sent = moved.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("delta") / F.col("src_deg")).alias("more"))
        both = state.join(sent, F.col("id") == F.col("to"), "left").withColumn("sum", F.col("acc") + F.coalesce("more", F.lit(0.0)))
        both = both.withColumn("new", F.lit(0.15) + F.lit(0.85) * F.col("sum"))
        if tolerance is not None:  # what was too small to send stays due
            due = F.when(F.abs("delta") > tolerance, F.lit(0.0)).otherwise(F.col("delta"))
        else:
            due = F.lit(0.0)
        before, state = state, cut(both.select("id", F.col("new").alias("rank"), F.col("sum").alias("acc"), (F.col("new") - F.col("rank") + due).alias("delta")))
        release(before)
    return Result(state.select("id", F.col("rank").alias("value")), "max_iterations", iterations)


def components(graph: Graph, max_iterations: int = 100) -> Result:
    """The smallest id of each vertex' component, over edges of either direction. Vertices of one label are a tree; each
    round a tree takes the smallest label next to any of its vertices, and then that label's new one, so that trees merge
    whole and the rounds grow with the logarithm of their number, not with the hops."""
    pairs = cut(graph.undirected().edges)
    state, status, step = cut(graph.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("changed"))), "max_iterations", 0
    for step in range(max_iterations + 1):
        if state.where("changed").isEmpty():
            status = "task_depletion"
            break
        if step == max_iterations:
            break
        near = state.join(pairs, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("label").alias("near"))
        touched = state.join(near, F.col("id") == F.col("to"))
        hooks = cut(touched.groupBy("label").agg(F.min("near").alias("low")).where(F.col("low") < F.col("label")))
        first = state.join(hooks, "label", "left").select("id", F.col("label").alias("was"), F.coalesce("low", "label").alias("label"))
        new = first.join(hooks, "label", "left").select("id", "was", F.coalesce("low", "label").alias("label"))
        before, state = state, cut(new.select("id", "label", (F.col("label") < F.col("was")).alias("changed")))
        release(before, hooks)
    release(pairs)
    return Result(state.select("id", "label"), status, step)


def toposort(graph: Graph, max_iterations: int = 10_000) -> DataFrame:
    """(id, level), the longest path from a vertex without in-edges; raises if there is a cycle or if vertices are left
    after max_iterations levels. A round settles the vertices without in-edges and, in one task, what follows from them
    among those with the fewest in-edges, BATCH vertices and edges at most; so a dense graph takes few rounds, whatever
    its levels, and a round settles a level at least."""
    left = cut(graph.vertices.select("id", F.lit(0).cast("bigint").alias("level")))
    edges, done = cut(graph.edges.select("src", "dst").distinct()), []

    def settled(new: DataFrame) -> None:
        nonlocal done
        if not new.where(F.col("level") >= max_iterations).isEmpty():
            raise ValueError(f"vertices are left after {max_iterations} levels")
        done = _piled(done, new)

    while not left.isEmpty():
        free = cut(left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        # the others, with the number of their in-edges from others
        ends = edges.join(free.select(F.col("id").alias("src"), "level"), "src", "left").groupBy(F.col("dst").alias("id"))
        ends = ends.agg(F.max(F.col("level") + 1).alias("up"), F.count_if(F.col("level").isNull()).alias("n"))
        rest = cut(left.join(ends, "id").select("id", F.greatest("level", "up").alias("level"), "n"))
        inner = cut(edges.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        release(left, edges)
        most, total = -1, 0
        for n, vertices in rest.groupBy("n").count().orderBy("n").limit(2048).collect():  # as many different numbers go beyond BATCH
            total += (n + 1) * vertices
            if total > BATCH:
                break
            most = n
        few = rest.where(F.col("n") <= most)
        near = inner.join(few.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.collect_list("src").alias("near"))
        near = few.join(near, "id", "left").select("id", "level", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
        next_ = cut(_in_one_task(near, _levels, "id bigint, level bigint"))
        ends = inner.join(next_.select(F.col("id").alias("src"), F.col("level").alias("from")), "src").groupBy(F.col("dst").alias("id")).agg((F.max("from") + 1).alias("up"))
        left = rest.join(next_.select("id"), "id", "left_anti").join(ends, "id", "left")
        left = cut(left.select("id", F.greatest("level", "up").alias("level")))
        edges = cut(inner.join(next_.select(F.col("id").alias("src")), "src", "left_anti"))
        release(rest, inner)
        settled(free)
        settled(next_)
    release(edges)
    return reduce(DataFrame.union, [*done, left])


def _levels(rows: pa.Table) -> pa.Table:
    """rows (id, level, near): the ids that are reached when all of near are among the rows and reached, with the largest of
    their own level and those of near plus one."""
    ids, level, (near, n) = rows.column("id").to_pylist(), rows.column("level").to_pylist(), _lists(rows.column("near"))
    at, out = {v: i for i, v in enumerate(ids)}, [[] for _ in ids]
    waits = [n[i + 1] - n[i] for i in range(len(ids))]
    for i in range(len(ids)):
        for u in near[n[i] : n[i + 1]]:
            if u in at:
                out[at[u]].append(i)
    found = [i for i, x in enumerate(waits) if not x]
    for i in found:  # grows
        for j in out[i]:
            level[j] = max(level[j], level[i] + 1)
            waits[j] -= 1
            if not waits[j]:
                found.append(j)
    return pa.table({"id": pa.array([ids[i] for i in found], pa.int64()), "level": pa.array([level[i] for i in found], pa.int64())})


# matrix factorisation by gradient steps


def start_factors(ratings: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, f0...): arithmetic in the ids, so that any engine gives the same start."""
    ids = ratings.select(F.col("src").alias("id")).union(ratings.select("dst")).distinct()
    rows = ids.join(F.broadcast(queries.select("qid")))  # the instances of one run
    return rows.select("qid", "id", *[(F.pmod(F.col("id") * 31 + k * 17 + F.col("qid") * 7, F.lit(1000)) / 1000.0).alias(f"f{k}") for k in range(LATENT)])


def _predicted(low: float, high: float) -> Column:
    dot = sum((F.col(f"s{k}") * F.col(f"d{k}") for k in range(1, LATENT)), F.col("s0") * F.col("d0"))
    return F.greatest(F.lit(low), F.least(F.lit(high), dot))


def _with_factors(ratings: DataFrame, factors: DataFrame) -> DataFrame:
    u = factors.select("qid", F.col("id").alias("src"), *[F.col(f"f{k}").alias(f"s{k}") for k in range(LATENT)])
    v = factors.select("qid", F.col("id").alias("dst"), *[F.col(f"f{k}").alias(f"d{k}") for k in range(LATENT)])
    return ratings.join(u, "src").join(v, ["qid", "dst"])


def sgd(ratings: DataFrame, factors: DataFrame, steps: int = 1, low: float = 1.0, high: float = 5.0, rate: float = STEP, decay: float = DECAY) -> DataFrame:
    """Gradient steps over the TRAIN edges, MAX_UPDATES at most, both sides at once: p += rate (sum(err q) - decay p)."""
    for _ in range(min(steps, MAX_UPDATES)):
        rows = _with_factors(ratings.where(F.col("role") == "TRAIN"), factors).withColumn("err", F.col("obs") - _predicted(low, high))
        ends = [rows.select("qid", F.col(me).alias("id"), *[(F.col("err") * F.col(f"{other}{k}")).alias(f"g{k}") for k in range(LATENT)]) for me, other in (("src", "d"), ("dst", "s"))]
        sums = ends[0].union(ends[1]).groupBy("qid", "id").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(LATENT)])
        new = [(F.col(f"f{k}") + F.lit(rate) * (F.coalesce(f"g{k}", F.lit(0.0)) - F.lit(decay) * F.col(f"f{k}"))).alias(f"f{k}") for k in range(LATENT)]
        factors = factors.join(sums, ["qid", "id"], "left").select("qid", "id", *new)
        if steps > 1:
            factors = cut(factors)
    return factors


def rmse(ratings: DataFrame, factors: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    err = F.col("obs") - _predicted(low, high)
    return _with_factors(ratings, factors).groupBy("qid", "role").agg(F.sqrt(F.avg(err * err)).alias("rmse"))


# blocks


def voronoi(graph: Graph, rate: float = 0.01, growth: float = 2.0, max_hops: int = 10, rounds: int = 6, seed: int = 7) -> DataFrame:
    """(id, block): sampled seeds spread up to max_hops; what stays uncoloured samples seeds at a growing rate, and what is
    left after the rounds forms components."""
    pairs = cut(graph.undirected().edges)
    state = cut(graph.vertices.select("id", F.lit(None).cast("bigint").alias("block")))

    def step(new: DataFrame) -> None:
        nonlocal state
        before, state = state, cut(new)
        release(before)

    for r in range(rounds):
        pick = spread("id", seed + r) < int(min(1.0, rate * growth**r) * RANGE)
        step(state.select("id", F.when(F.col("block").isNull() & pick, F.col("id")).otherwise(F.col("block")).alias("block")))
        for _ in range(max_hops):
            near = state.where(F.col("block").isNotNull()).join(pairs, F.col("id") == F.col("src"))
            near = near.join(state.where(F.col("block").isNull()).select(F.col("id").alias("dst")), "dst", "left_semi")
            near = cut(near.groupBy(F.col("dst").alias("to")).agg(F.min("block").alias("near")))
            over = near.isEmpty()
            if not over:
                step(state.join(near, F.col("id") == F.col("to"), "left").select("id", F.coalesce("block", "near").alias("block")))
            release(near)
            if over:
                break
    rest = state.where(F.col("block").isNull()).select("id")
    inner = pairs.join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(rest.select(F.col("id").alias("dst")), "dst", "left_semi")
    found = components(Graph(rest, inner), 10_000)
    if found.status != "task_depletion":
        raise ValueError("a component is wider than 10,000 hops")
    return state.join(found.df, "id", "left").select("id", F.coalesce("block", "label").alias("block"))


def assign_blocks(sizes: dict[int, int], workers: int) -> dict[int, int]:
    """Largest block first to the least loaded worker."""
    load = [(0, w) for w in range(workers)]
    out = {}
    for b, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        total, w = heapq.heappop(load)
        out[b] = w
        heapq.heappush(load, (total + n, w))
    return out


def str_partition(points: DataFrame, xs: int, ys: int, accuracy: int = 100_000) -> DataFrame:
    """points (id, x, y): x-stripes at quantiles, cut at quantiles of y; adds block. A quantile is the smallest value that
    has its share of the points at or below it, exact on tables of up to ``accuracy`` points and within one part in so
    many of the ranks beyond."""
    at = lambda column, n: F.percentile_approx(column, [i / n for i in range(1, n)], accuracy)
    cuts = points.agg(at("x", xs).alias("cuts")).first()["cuts"] or [] if xs > 1 else []
    stripe = sum((F.when(F.col("x") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = points.withColumn("stripe", stripe)
    if ys > 1:
        inner = rows.groupBy("stripe").agg(at("y", ys).alias("ycuts"))
        rows = rows.join(F.broadcast(inner), "stripe")  # a row a stripe
        rows = rows.withColumn("block", F.col("stripe") * ys + F.size(F.filter("ycuts", lambda c: c < F.col("y")))).drop("ycuts")
    else:
        rows = rows.withColumn("block", F.col("stripe"))
    return rows.drop("stripe")


def topk(values: DataFrame, k: int) -> DataFrame:
    """The k largest values of each query."""
    w = Window.partitionBy("qid").orderBy(F.col("value").desc(), "id")
    return values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


PROGRAMS = {"bbfs": bbfs, "ibfs": ibfs, "sssp": sssp, "spmv": spmv, "ppr": ppr, "coloring": coloring}
__all__ = ["PROGRAMS", "run"]
