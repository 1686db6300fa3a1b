"""Multi-instance supersteps: K instances of a vertex program share one edge scan and one shuffle a superstep.

A program says, in Column expressions, what an edge carries, how messages combine, and what a vertex makes of them. The
driver loop runs it in one of three plans:

* ``long``: rows (qid, id, value), exactly the active (instance, vertex) pairs. Absent rows are unreached.
* ``lanes``: a row a vertex and a column an instance; one frontier for all lanes (allowed where recomputing an idle lane
  changes nothing), in chunks of lanes so that generated code stays small.
* ``single``: one instance after another, the baseline.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.graph import Direction, Graph
from ..tables import bucketed, cut, laid, release, unlaid

COMBINE: dict[str, Callable[[Column], Column]] = {
    "min": F.min, "max": F.max, "sum": F.sum, "product": F.product, "bit_or": F.bit_or, "or": F.bool_or, "and": F.bool_and,
}
IDEMPOTENT = {"min", "max", "bit_or", "or", "and"}
LANES = 32
#: Engines and schedulers that callers may name. All are supersteps here: an order of execution has no part in a result.
ENGINES = ("sync", "async", "plsync", "plasync")
SCHEDULERS = ("fifo", "sweep", "priority", "queued_fifo")


@dataclass
class VertexProgram:
    """message(value, edge): what goes along an edge, edge being a function from a column's name to it; NULL for none.
    apply(old, acc, seed): the new value; old is NULL for a vertex not reached yet, acc NULL without messages; seed
    tells the query's source. Programs with ``dense`` apply at every vertex for a number of iterations, others run on the
    frontier until it is empty. seed: the source's value at the start; default: an absent row's value. key(value, edge): a
    message's secondary key; only messages of one key combine, and acc is a map from key to combined message. A vertex
    should get few keys. Such programs run in the plans ``long`` and ``single``."""

    name: str
    message: Callable[[Column, Callable[[str], Column]], Column]
    combine: str
    apply: Callable[[Column, Column, Column], Column]
    seed: Column
    type: str = "bigint"
    direction: Direction = Direction.IN
    dense: bool = False
    default: Column | None = None
    degree: bool = False
    key: Callable[[Column, Callable[[str], Column]], Column] | None = None

    @property
    def track_free(self) -> bool:
        return self.key is None and (self.dense or self.combine in IDEMPOTENT)

    def gathered(self, sent: DataFrame) -> DataFrame:
        """sent: a row an active row and edge. (qid, id, acc)"""
        key = [] if self.key is None else [self.key(F.col("value"), F.col).alias("key")]
        sent = sent.select("qid", F.col("dst").alias("id"), self.message(F.col("value"), F.col).alias("m"), *key).where(F.col("m").isNotNull())
        got = sent.groupBy("qid", "id", *(["key"] if key else [])).agg(COMBINE[self.combine]("m").alias("acc"))
        if key:
            got = got.groupBy("qid", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "acc"))).alias("acc"))
        return got


@dataclass
class Watch:
    """What a run reports and what ends it early.

    timeout: seconds after which no superstep begins. stop_when: an aggregate over the state (qid, id, value, changed)
    that ends the run. aggregates: named aggregates of each instance's state, taken after every superstep. stop_query: of
    an instance's aggregates, whether it ends here; the others go on. post_round(state, superstep): called after every
    superstep; a frame that it returns replaces the state, so that it may add vertices, wake all or change values.
    periodic(superstep): what else is due then, such as Aggregators.tick on a graph. snapshots: the state goes to
    snapshot_path/superstep=n every ``snapshot_every`` supersteps (0: before the first one only)."""

    timeout: float | None = None
    stop_when: Column | None = None
    aggregates: dict[str, Column] = field(default_factory=dict)
    stop_query: Callable[[dict], bool] | None = None
    post_round: Callable[[DataFrame, int], DataFrame | None] | None = None
    periodic: Callable[[int], dict] | None = None
    snapshot_every: int | None = None
    snapshot_path: str | None = None
    began: float = field(default_factory=time.monotonic)

    def ends(self, state: DataFrame) -> str | None:
        """The status that ends the run before its next superstep."""
        if self.timeout is not None and time.monotonic() - self.began > self.timeout:
            return "timeout"
        if self.stop_when is not None and state.agg(self.stop_when.alias("stop")).first()["stop"]:
            return "forced_abort"
        return None

    def see(self, state: DataFrame, step: int, row: dict) -> dict:
        """Takes the aggregates and snapshots that are due; row with the time and the aggregates, a dict an instance."""
        every = self.snapshot_every
        if every is not None and (step == 0 or (every > 0 and step % every == 0)):
            state.write.mode("overwrite").parquet(f"{self.snapshot_path}/superstep={step}")
        out = {"superstep": step, **row, "seconds": time.monotonic() - self.began}
        if self.aggregates:  # a row an instance
            got = state.groupBy("qid").agg(*[c.alias(k) for k, c in self.aggregates.items()]).collect()
            out["aggregates"] = {r["qid"]: {k: r[k] for k in self.aggregates} for r in got}
        if self.periodic is not None and (due := self.periodic(step)):
            out["periodic"] = due
        return out

    def ended(self, row: dict) -> list[int]:
        """The instances that stop_query ends."""
        return [q for q, a in row.get("aggregates", {}).items() if self.stop_query is not None and self.stop_query(a)]


@dataclass
class Result:
    """status: task_depletion, max_iterations, timeout or forced_abort. stats: superstep, active vertices, vertices that
    got messages in it, seconds since the beginning, and aggregates."""

    df: DataFrame
    status: str
    supersteps: int
    stats: list[dict] = field(default_factory=list)


def _edges(program: VertexProgram, graph: Graph) -> DataFrame:
    if program.degree:
        return graph.with_out_degree()
    return graph.along(program.direction)


#: Out-edges above which a vertex is a hub.
HUB = 1 << 20


@dataclass
class Layout:
    """Edges in buckets of their source. A hub's edges are dealt into parts, each in a bucket of its own, and what a hub
    sends is copied to its parts, so that no task has all of them."""

    edges: DataFrame
    hubs: DataFrame | None = None

    def sent(self, frontier: DataFrame) -> DataFrame:
        """A row an active row and out-edge."""
        if self.hubs is None:
            return frontier.join(self.edges, F.col("id") == F.col("src"))
        copies = frontier.join(self.hubs, F.col("id") == F.col("hub"), "left")
        copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hub", "parts")
        return copies.join(self.edges, (F.col("id") == F.col("src")) & (F.col("copy") == F.col("part")))


@contextmanager
def layout(edges: DataFrame, hub: int = HUB) -> Iterator[Layout]:
    """The edges as a Layout for the length of a ``with`` block."""
    with bucketed(edges, "src") as plain:
        if plain.count() <= hub:
            yield Layout(plain)
            return
        hubs = plain.groupBy("src").count().where(F.col("count") > hub)
        hubs = cut(hubs.select(F.col("src").alias("hub"), F.ceil(F.col("count") / hub).cast("int").alias("parts")), "hubs")
        if hubs.isEmpty():
            yield Layout(plain)
        else:
            dealt = plain.join(hubs, F.col("src") == F.col("hub"), "left")
            dealt = dealt.withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("hub", "parts")
            with bucketed(dealt, "src", "part") as parts:
                yield Layout(parts, hubs)
        release(hubs)


def _worst(parts: list[Result]) -> str:
    return next((s for s in ("forced_abort", "timeout", "max_iterations") if any(p.status == s for p in parts)), "task_depletion")


def run(
    program: VertexProgram, graph: Graph, queries: DataFrame, mode: str = "long", max_iterations: int = 100,
    present_only: bool = True, stop_when: Column | None = None, watch: Watch | None = None, start: DataFrame | None = None,
    engine: str = "sync", scheduler: str = "fifo", hub: int = HUB,
) -> Result:
    """queries: (qid, source). present_only: sources that aren't vertices give no row. hub: as in layout. stop_when: as in Watch. start: a
    state (qid, id, value) to go on from with all its vertices awake, such as an earlier phase's result or a snapshot.

    The edges are laid out by source once and the state as it is written, by instance and vertex (in lanes by vertex), so
    that a superstep shuffles its frontier to the edges and the combined messages, in lanes the messages alone."""
    if engine not in ENGINES or scheduler not in SCHEDULERS:
        raise ValueError(f"no such engine or scheduler: {engine}, {scheduler}")
    watch = watch or Watch(stop_when=stop_when)
    if mode == "lanes" and watch.post_round is not None:
        raise ValueError("lanes have no rows of instances that a hook could change")
    if present_only:
        queries = queries.join(graph.vertices.select(F.col("id").alias("source")), "source", "left_semi").select("qid", "source")
    step = _dense if program.dense else _long
    with layout(_edges(program, graph), hub) as edges:
        if mode == "long":
            return step(program, edges, queries, max_iterations, watch, start)
        if mode == "single":
            ids = queries.select("qid").distinct().orderBy("qid").toLocalIterator()
            mine = lambda df, q: df if df is None else df.where(F.col("qid") == q)
            parts = [step(program, edges, mine(queries, r[0]), max_iterations, watch, mine(start, r[0])) for r in ids]
        else:
            cells = [(r[0], r[1]) for r in queries.orderBy("qid").collect()]  # the instances of one run: a column each
            if mode != "lanes" or not program.track_free:
                raise ValueError(f"{program.name} can't run in the plan {mode}")
            parts = [_lanes(program, graph, edges, cells[i : i + LANES], max_iterations, watch, start) for i in range(0, len(cells), LANES)]
        if not parts:
            return Result(_seeds(program, queries), "task_depletion", 0)
        n = [p.supersteps for p in parts]
        return Result(reduce(DataFrame.union, [p.df for p in parts]), _worst(parts), sum(n) if mode == "single" else max(n), [s for p in parts for s in p.stats])


def _seeds(program: VertexProgram, queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.col("source").alias("id"), program.seed.cast(program.type).alias("value"))


def _first(program: VertexProgram, queries: DataFrame, start: DataFrame | None) -> DataFrame:
    return _seeds(program, queries) if start is None else start.select("qid", "id", F.col("value").cast(program.type).alias("value"))


def _observed(df: DataFrame) -> tuple[DataFrame, dict]:
    """df without ``got``, written, and its changed rows and those that got messages, counted as it was written."""
    counts = Observation()
    out = laid(df.observe(counts, F.count_if("changed").alias("active"), F.count_if("got").alias("messages")).drop("got"), "qid", "id")
    return out, counts.get


def _long(program: VertexProgram, edges: Layout, queries: DataFrame, max_iterations: int, watch: Watch, start: DataFrame | None) -> Result:
    state = laid(_first(program, queries, start).withColumn("changed", F.lit(True)), "qid", "id", deal=True)
    row = {"active": state.count(), "messages": 0}
    stats, status, over = [], "max_iterations", []
    for step in range(max_iterations + 1):
        stats.append(watch.see(state, step, row))
        over += [q for q in watch.ended(stats[-1]) if q not in over]
        if not row["active"]:
            status = "task_depletion"
            break
        if early := watch.ends(state):
            status = early
            break
        if step == max_iterations:
            break
        awake = state.where("changed")
        if over:
            awake = awake.where(~F.col("qid").isin(over))
        got = program.gathered(edges.sent(awake))
        both = state.drop("changed").join(got, ["qid", "id"], "full")
        new = F.when(F.col("acc").isNull(), F.col("value")).otherwise(program.apply(F.col("value"), F.col("acc"), F.lit(False))).cast(program.type)
        new = both.select("qid", "id", F.col("value").alias("old"), new.alias("value"), F.col("acc").isNotNull().alias("got"))
        before = state
        state, row = _observed(new.select("qid", "id", "value", (~F.col("value").eqNullSafe(F.col("old"))).alias("changed"), "got"))
        release(before)
        if watch.post_round is not None and (new := watch.post_round(state, step + 1)) is not None:
            before, state = state, laid(new.select("qid", "id", F.col("value").cast(program.type).alias("value"), "changed"), "qid", "id", deal=True)
            release(before)
            row["active"] = state.where("changed").count()
    return Result(unlaid(state).select("qid", "id", "value"), status, step, stats)


def _dense(program: VertexProgram, edges: Layout, queries: DataFrame, iterations: int, watch: Watch, start: DataFrame | None) -> Result:
    """A seed's row says so, so that the state alone tells which vertices are sources."""
    seeds = queries.select("qid", F.col("source").alias("id"), F.lit(True).alias("seed"))
    state = _first(program, queries, start).join(seeds, ["qid", "id"], "full")
    state = laid(state.select("qid", "id", "value", F.coalesce("seed", F.lit(False)).alias("seed")), "qid", "id", deal=True)
    stats = [watch.see(state, 0, {})]
    status, step = "max_iterations", 0
    for step in range(iterations + 1):
        if step == iterations:
            break
        if early := watch.ends(state):
            status = early
            break
        got = program.gathered(edges.sent(state.where(F.col("value").isNotNull())))
        both = got.join(state, ["qid", "id"], "full")
        seed = F.coalesce("seed", F.lit(False))
        rows = both.select("qid", "id", program.apply(F.col("value"), F.col("acc"), seed).cast(program.type).alias("value"), seed.alias("seed"))
        keep = F.col("value").isNotNull()
        if program.default is not None:
            keep = keep & (F.col("value") != program.default)
        before, state = state, laid(rows.where(keep | F.col("seed")), "qid", "id")
        release(before)
        stats.append(watch.see(state, step + 1, {}))
    out = unlaid(state).where(F.col("value").isNotNull())
    if program.default is not None:
        out = out.where(F.col("value") != program.default)
    return Result(out.select("qid", "id", "value"), status, step, stats)


def _lanes(program: VertexProgram, graph: Graph, edges: Layout, ids: list[tuple[int, int]], iterations: int, watch: Watch, start: DataFrame | None) -> Result:
    """Lane columns v0...; NULL is unreached. A vertex is active if any lane changed. Aggregates, snapshots and conditions
    see the lanes as rows, ``changed`` being the vertex'."""
    lanes = [f"v{i}" for i in range(len(ids))]
    seed = lambda i: F.col("id") == F.lit(ids[i][1])
    if start is None:
        state = graph.vertices.select("id", *[F.when(seed(i), program.seed).cast(program.type).alias(v) for i, v in enumerate(lanes)])
    else:
        given = start.groupBy("id").agg(*[F.max(F.when(F.col("qid") == q, F.col("value"))).cast(program.type).alias(v) for (q, _), v in zip(ids, lanes, strict=True)])
        state = graph.vertices.select("id").join(given, "id", "left")
    state = laid(state.withColumn("changed", reduce(Column.__or__, [F.col(v).isNotNull() for v in lanes])), "id", deal=True)
    cells = F.array(*[F.struct(F.lit(q).alias("qid"), F.col(v).alias("value")) for (q, _), v in zip(ids, lanes, strict=True)])

    def rows(table: DataFrame) -> DataFrame:
        out = table.select("id", "changed", F.explode(cells).alias("c")).select(F.col("c.qid").alias("qid"), "id", F.col("c.value").alias("value"), "changed")
        out = out.where(F.col("value").isNotNull())
        return out if program.default is None else out.where(F.col("value") != program.default)

    stats, status, step, over = [], "max_iterations", 0, set()
    for step in range(iterations + 1):
        stats.append(watch.see(rows(state), step, {}))
        over |= set(watch.ended(stats[-1]))
        if not program.dense and (len(over) == len(ids) or state.where("changed").isEmpty()):
            status = "task_depletion"
            break
        if early := watch.ends(rows(state)):
            status = early
            break
        if step == iterations:
            break
        sent = edges.sent(state if program.dense else state.where("changed"))
        along = lambda i, v: F.lit(None).cast(program.type) if ids[i][0] in over else program.message(F.col(v), F.col)
        sent = sent.select(F.col("dst").alias("to"), *[along(i, v).alias(f"m_{v}") for i, v in enumerate(lanes)])
        got = sent.groupBy("to").agg(*[COMBINE[program.combine](f"m_{v}").alias(f"a_{v}") for v in lanes])
        both = state.join(got, F.col("id") == F.col("to"), "left")
        new = []
        for i, v in enumerate(lanes):
            acc = F.col(f"a_{v}")
            value = program.apply(F.col(v), acc, seed(i))
            new.append((value if program.dense else F.when(acc.isNull(), F.col(v)).otherwise(value)).cast(program.type).alias(v))
        both = both.select("id", *new, *[F.col(v).alias(f"o_{v}") for v in lanes])
        changed = reduce(Column.__or__, [~F.col(v).eqNullSafe(F.col(f"o_{v}")) for v in lanes])
        before, state = state, laid(both.select("id", *lanes, changed.alias("changed")), "id")
        release(before)
    return Result(rows(unlaid(state)).select("qid", "id", "value"), status, step, stats)
