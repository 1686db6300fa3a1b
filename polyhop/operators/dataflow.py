"""Graph dataflow operators: transforms, folds, vertex sets, joins between graphs and neighbourhood operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bsp import COMBINE
from ..sources.graph import Direction, Graph
from ..tables import laid


def transform_vertices(graph: Graph, columns: dict[str, Column], vset: DataFrame | None = None) -> Graph:
    """New or changed vertex columns; with a set, other vertices keep what they had (NULL for new columns)."""
    v = graph.vertices
    if vset is None:
        return Graph(v.withColumns(columns), graph.edges)
    v = v.join(vset.select("id").distinct().withColumn("__in", F.lit(True)), "id", "left")
    v = v.withColumns({k: F.when(F.col("__in"), c).otherwise(F.col(k) if k in graph.vertices.columns else F.lit(None)) for k, c in columns.items()})
    return Graph(v.drop("__in"), graph.edges)


def triplets(graph: Graph) -> DataFrame:
    """Edges with the vertex columns of both ends as src_* and dst_*."""
    rest = [c for c in graph.vertices.columns if c != "id"]
    out = graph.edges
    for end in ("src", "dst"):
        if rest:
            out = out.join(graph.vertices.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in rest]), end)
    return out


def transform_edges(graph: Graph, columns: dict[str, Column], vset: DataFrame | None = None, direction: Direction = Direction.ALL, endpoints: bool = False) -> Graph:
    """New or changed edge columns, on the edges around a set if one is given; with endpoints src_* and dst_* can be read."""
    e = triplets(graph) if endpoints else graph.edges
    keep = list(dict.fromkeys([*graph.edges.columns, *columns]))
    if vset is None:
        return Graph(graph.vertices, e.withColumns(columns).select(*keep))
    hit = F.lit(False)
    ids = vset.select("id").distinct()
    for end, ways in (("dst", (Direction.IN, Direction.ALL)), ("src", (Direction.OUT, Direction.ALL))):
        if direction in ways:
            e = e.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
            hit = hit | F.coalesce(f"__{end}", F.lit(False))
    new = {k: F.when(hit, c).otherwise(F.col(k) if k in graph.edges.columns else F.lit(None)) for k, c in columns.items()}
    return Graph(graph.vertices, e.withColumns(new).select(*keep))


def select(graph: Graph, predicate: Column) -> DataFrame:
    return graph.vertices.where(predicate).select("id")


def map_reduce_vertices(graph: Graph, value: Column, combine: str, identity, vset: DataFrame | None = None, name: str = "value") -> DataFrame:
    """One row; the identity for an empty set."""
    v = graph.vertices if vset is None else graph.vertices.join(vset.select("id"), "id", "left_semi")
    return v.agg(F.coalesce(COMBINE[combine](value), F.lit(identity)).alias(name))


def map_reduce_edges(graph: Graph, value: Column, combine: str, identity, vset: DataFrame | None = None, direction: Direction = Direction.IN, name: str = "value") -> DataFrame:
    """Over the in-, out- or all edges of the vertices of a set; ALL visits an edge from both of its ends."""
    ends = {Direction.IN: ("dst",), Direction.OUT: ("src",), Direction.ALL: ("src", "dst"), Direction.NONE: ()}[direction]
    parts = [graph.edges if vset is None else graph.edges.join(vset.select(F.col("id").alias(e)), e, "left_semi").select(*graph.edges.columns) for e in ends]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else graph.edges.limit(0)
    return rows.agg(F.coalesce(COMBINE[combine](value), F.lit(identity)).alias(name))


fold_vertices, fold_edges = map_reduce_vertices, map_reduce_edges


class Aggregators:
    """Named aggregates over vertices or edges, run at once or every n supersteps."""

    def __init__(self) -> None:
        self._of: dict[str, tuple[str, Column, Callable | None, int | None]] = {}

    def add(self, key: str, over: str, aggregate: Column, finalize: Callable | None = None) -> None:
        if over not in ("vertices", "edges"):
            raise ValueError(over)
        self._of[key] = (over, aggregate, finalize, None)

    def periodic(self, key: str, supersteps: int) -> None:
        if supersteps < 0:
            raise ValueError("a period can't be negative")
        self._of[key] = (*self._of[key][:3], max(1, supersteps))

    def frame(self, graph: Graph, key: str) -> DataFrame:
        over, aggregate, _, _ = self._of[key]
        return getattr(graph, over).agg(aggregate.alias("value"))

    def now(self, graph: Graph, key: str):
        value, finalize = self.frame(graph, key).first()["value"], self._of[key][2]
        return finalize(value) if finalize else value

    def tick(self, graph: Graph, superstep: int) -> dict:
        return {k: self.now(graph, k) for k, (_, _, _, every) in self._of.items() if every and superstep % every == 0}


# vertex sets: frames of one column, id


def empty_set(graph: Graph) -> DataFrame:
    return graph.vertices.select("id").limit(0)


def complete_set(graph: Graph) -> DataFrame:
    return graph.vertices.select("id")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))


def invert(graph: Graph, a: DataFrame) -> DataFrame:
    return difference(graph.vertices, a)


def neighbors(graph: Graph, vset: DataFrame, direction: Direction = Direction.ALL) -> DataFrame:
    """Ids at the other end of the in-, out- or all edges of a set, once each."""
    e = graph.along(direction)  # from the neighbour to the vertex that gathers
    return e.join(vset.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def num_neighbors(graph: Graph) -> DataFrame:
    return graph.undirected().edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))


# joins between graphs


def injective_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, columns: dict[str, Column], check: bool = True) -> DataFrame:
    """The left vertices with columns that may read the right vertex (right_*) of the same key. Key -1 takes no part; other
    keys must be unique on either side."""
    r = right.withColumn("__k", right_key).where(F.col("__k") != -1)
    lk = left.withColumn("__k", left_key)
    if check:
        for side in (r, lk.where(F.col("__k") != -1)):
            if not side.groupBy("__k").count().where("count > 1").isEmpty():
                raise ValueError("keys of an injective join repeat")
    r = r.select("__k", F.lit(True).alias("matched"), *[F.col(c).alias(f"right_{c}") for c in right.columns])
    keep = list(dict.fromkeys([*left.columns, *columns]))
    return lk.join(r, "__k", "left").withColumns(columns).select(*keep)


def request_respond(vertices: DataFrame, requests: DataFrame, columns: list[str]) -> DataFrame:
    """requests: (id, target): the target's columns for each request, NULL if there is no such vertex."""
    return requests.join(vertices.select(F.col("id").alias("target"), *columns), "target", "left")


# neighbourhoods


def gather_apply(graph: Graph, message: Column, combine: str, identity, apply: Column, name: str, direction: Direction = Direction.IN, vset: DataFrame | None = None) -> DataFrame:
    """One gather over the edges of each vertex (message reads src_* and the edge), then apply, which reads ``acc``."""
    rest = [c for c in graph.vertices.columns if c != "id"]
    e = graph.along(direction).join(graph.vertices.select(F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in rest]), "src")
    got = e.groupBy(F.col("dst").alias("id")).agg(COMBINE[combine](message).alias("acc"))
    v = graph.vertices if vset is None else graph.vertices.join(vset.select("id"), "id", "left_semi")
    return v.join(got, "id", "left").withColumn("acc", F.coalesce("acc", F.lit(identity))).withColumn(name, apply).drop("acc")


def map_reduce_neighborhood(graph: Graph, message: Column, combine: str, direction: Direction = Direction.IN) -> DataFrame:
    """(id, value) for the vertices that have such edges."""
    return graph.along(direction).groupBy(F.col("dst").alias("id")).agg(COMBINE[combine](message).alias("value"))


def transform_neighborhood(graph: Graph, vset: DataFrame, columns: dict[str, Column], direction: Direction = Direction.OUT) -> Graph:
    return transform_edges(graph, columns, vset, direction)


def broadcast_neighborhood(graph: Graph, vset: DataFrame, payload: Column, combine: str) -> DataFrame:
    """Messages of the set's vertices to their out-neighbours, combined: (id, value)."""
    return vset.join(graph.edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(COMBINE[combine](payload).alias("value"))


def out_to_in(graph: Graph) -> DataFrame:
    """(id, out_nbs, in_nbs), sorted."""
    lists = lambda key, other, name: graph.edges.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(other)).alias(name))
    none = F.array().cast("array<bigint>")
    got = graph.vertices.select("id").join(lists("src", "dst", "out_nbs"), "id", "left").join(lists("dst", "src", "in_nbs"), "id", "left")
    return got.select("id", F.coalesce("out_nbs", none).alias("out_nbs"), F.coalesce("in_nbs", none).alias("in_nbs"))


def adjacency_lines(graph: Graph, weight: str | None = None) -> DataFrame:
    """``v<tab>n nb [w] ...`` lines, neighbours in order."""
    cell = F.struct("dst", weight) if weight else F.struct("dst")
    text = (lambda x: F.concat_ws(" ", x["dst"], x[weight])) if weight else (lambda x: x["dst"].cast("string"))
    got = graph.edges.groupBy("src").agg(F.sort_array(F.collect_list(cell)).alias("nbs"))
    return got.select(F.concat(F.col("src"), F.lit("\t"), F.concat_ws(" ", F.size("nbs").cast("string"), F.array_join(F.transform("nbs", text), " "))).alias("value"))


def neighbor_info(graph: Graph, columns: list[str]) -> DataFrame:
    """Edges with what their targets say."""
    return graph.edges.join(graph.vertices.select(F.col("id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in columns]), "dst")


class Index:
    """Vertices by a column of theirs, laid out by it once."""

    def __init__(self, vertices: DataFrame, column: str):
        self.column = column
        self.table = laid(vertices.select(column, "id"), column, deal=True)

    def lookup(self, keys: list | DataFrame) -> DataFrame:
        """(key, id) of the vertices with these keys: a list, or a frame with the column."""
        if isinstance(keys, DataFrame):
            return self.table.join(keys.select(self.column).distinct(), self.column, "left_semi")
        return self.table.where(F.col(self.column).isin(keys))
