"""A query server: source queries come in while others run, and all that are in flight share each superstep."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bsp import VertexProgram, layout
from ..sources.graph import Graph
from ..tables import cut, laid, release

EXIT = "server_exit"


class QueryServer:
    """submit() queues sources, tick() admits up to ``capacity`` in flight and runs one superstep for them, drain() ticks
    until none is left. A query ends when its frontier is empty; its rows then move to the answers. The edges lie in a
    table that close() drops, with the state; answers and stats stay.

    aggregates: named aggregates of each query's state (qid, id, value, changed), taken after every superstep and kept in
    its statistics; stop: of a query's aggregates, whether it ends there. The frontier and the touched vertices are
    counted by the same scan."""

    def __init__(self, graph: Graph, program: VertexProgram, capacity: int = 8, aggregates: dict[str, Column] | None = None, stop: Callable[[dict], bool] | None = None):
        if program.dense:
            raise ValueError("only frontier programs end by themselves")
        self.graph, self.program, self.capacity = graph, program, capacity
        self.aggregates, self.stop = aggregates or {}, stop
        self._table = ExitStack()
        self.edges = self._table.enter_context(layout(graph.with_out_degree() if program.degree else graph.along(program.direction)))
        self.waiting: deque[tuple[int, int]] = deque()
        self.live: dict[int, dict] = {}
        self.done: list[dict] = []
        self.answers: list[DataFrame] = []
        self.state: DataFrame | None = None
        self.gone: list[int] = []  # ended queries with rows in the state's table
        self._next, self._size, self.closed, self.ticks = 0, None, False, 0

    def submit(self, source) -> int | None:
        if source == EXIT:
            self.closed = True
            return None
        if self.closed:
            raise RuntimeError("the server is closing")
        self.waiting.append((self._next, int(source)))
        self._next += 1
        return self._next - 1

    def force_terminate(self, qid: int) -> None:
        if qid in self.live:
            self.live[qid]["stop"] = True

    def tick(self) -> None:
        spark, p = self.graph.spark, self.program
        self.ticks += 1
        new = []
        while self.waiting and len(self.live) + len(new) < self.capacity:
            new.append(self.waiting.popleft())
        for q, _ in new:
            self.live[q] = {"qid": q, "supersteps": 0, "began": time.time()}
        if new:
            rows = spark.createDataFrame(new, "qid int, id bigint").join(self.graph.vertices.select("id"), "id", "left_semi")
            seeds = rows.select("qid", "id", p.seed.cast(p.type).alias("value"), F.lit(True).alias("changed"))
        if self.state is None and not new or not self.live:
            return
        table, kept = self.state, self.state
        if kept is not None and self.gone:
            kept, self.gone = kept.where(~F.col("qid").isin(self.gone)), []
        state = kept if not new else seeds if kept is None else kept.union(seeds)
        got = p.gathered(self.edges.sent(state.where("changed")))
        both = state.select("qid", "id", F.col("value").alias("old")).join(got, ["qid", "id"], "full")
        value = F.when(F.col("acc").isNull(), F.col("old")).otherwise(p.apply(F.col("old"), F.col("acc"), F.lit(False))).cast(p.type)
        both = both.select("qid", "id", "old", value.alias("value"))
        state = laid(both.select("qid", "id", "value", (~F.col("value").eqNullSafe(F.col("old"))).alias("changed")), "qid", "id")
        if table is not None:
            release(table)
        counts = {"active": F.count_if("changed"), "touched": F.count(F.lit(1))} | self.aggregates
        rows = {r["qid"]: r.asDict() for r in state.groupBy("qid").agg(*[c.alias(k) for k, c in counts.items()]).collect()}
        ended = []
        for q, info in self.live.items():
            info["supersteps"] += 1
            row = rows.get(q)
            info["touched"] = row["touched"] if row else 0
            info["aggregates"] = {k: row[k] for k in self.aggregates} if row else {}
            done = row is None or not row["active"] or info.get("stop")
            if done or (self.stop is not None and self.stop(info["aggregates"])):
                ended.append(q)
        self.state = state
        if ended:
            # the rows of ended queries stay in the state's table, unread, until the next superstep writes it anew
            self.answers.append(cut(state.where(F.col("qid").isin(ended)).select("qid", "id", "value")))
            if len(self.answers) == 16:
                self.answers = [cut(reduce(DataFrame.union, before := self.answers))]
                release(*before)
            for q in ended:
                info = self.live.pop(q)
                self.done.append(info | {"seconds": time.time() - info.pop("began")})
            self.gone = ended

    def close(self) -> None:
        self.closed = True
        self._table.close()
        if self.state is not None:
            release(self.state)
            self.state = None

    def drain(self) -> DataFrame:
        while self.waiting or self.live:
            self.tick()
        if not self.answers:
            return self.graph.spark.createDataFrame([], f"qid int, id bigint, value {self.program.type}")
        return reduce(DataFrame.union, self.answers)

    def save(self, path: str) -> None:
        """Writes what a server of the same graph and program needs to go on to path/tick=n. The driver's part comes last,
        so that a folder without it doesn't count."""
        spark, at = self.graph.spark, f"{path}/tick={self.ticks:09d}"
        none = spark.createDataFrame([], f"qid int, id bigint, value {self.program.type}, changed boolean")
        state = none if self.state is None else self.state.where(~F.col("qid").isin(self.gone)) if self.gone else self.state
        state.write.mode("overwrite").parquet(f"{at}/state")
        answers = reduce(DataFrame.union, self.answers) if self.answers else none.drop("changed")
        answers.write.mode("overwrite").parquet(f"{at}/answers")
        meta = {"ticks": self.ticks, "next": self._next, "waiting": list(self.waiting), "live": list(self.live.values()), "done": self.done}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/driver")

    @classmethod
    def restore(cls, graph: Graph, program: VertexProgram, path: str, **options) -> QueryServer:
        """A server that goes on from the last tick saved under path."""
        spark, server = graph.spark, cls(graph, program, **options)
        found = spark.read.text(f"{path}/*/driver").collect()  # a row a tick saved
        meta = max((json.loads(r["value"]) for r in found), key=lambda m: m["ticks"])
        at = f"{path}/tick={meta['ticks']:09d}"
        server.ticks, server._next, server.done = meta["ticks"], meta["next"], meta["done"]
        server.waiting = deque((q, s) for q, s in meta["waiting"])
        server.live = {info["qid"]: info for info in meta["live"]}
        server.state = laid(spark.read.parquet(f"{at}/state"), "qid", "id", deal=True)
        server.answers = [cut(spark.read.parquet(f"{at}/answers"))]
        return server

    def stats(self) -> DataFrame:
        """qid, supersteps, touched, access_rate (touched vertices of all) and seconds of the ended queries."""
        if self._size is None:
            self._size = self.graph.vertices.count()
        rows = [(d["qid"], d["supersteps"], d["touched"], d["touched"] / max(1, self._size), d["seconds"]) for d in self.done]
        return self.graph.spark.createDataFrame(rows, "qid int, supersteps int, touched bigint, access_rate double, seconds double")


def serve(server: QueryServer, lines: DataFrame, checkpoint: str, state: str | None = None):
    """Feeds a streaming frame of text lines, one source id each, to a server; returns the streaming query. Each arrival
    runs one superstep, which what came before and is still in flight shares; drain() ends the rest. state: a folder to
    which the server is saved after each arrival; after a restart QueryServer.restore goes on from there."""

    def batch(df: DataFrame, _: int) -> None:
        for r in df.select(F.trim("value").alias("v")).where(F.col("v") != "").toLocalIterator():
            server.submit(EXIT if r["v"] == EXIT else int(r["v"]))
        server.tick()
        if state is not None:
            server.save(state)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
