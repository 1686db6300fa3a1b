"""The property graph: a vertices table (id, ...) and an edges table (src, dst, ...)."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id that no vertex may have.
RESERVED = -1


class Direction(Enum):
    NONE = 0
    IN = 1
    OUT = 2
    ALL = 3


@dataclass
class Graph:
    """Edges imply their endpoints; self loops and reserved ids are dropped; parallel edges stay."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None, combine: dict[str, str] | None = None) -> Graph:
        """combine: {column: aggregate} for vertices given several times; by default any one of them."""
        edges = edges.withColumn("src", F.col("src").cast("bigint")).withColumn("dst", F.col("dst").cast("bigint"))
        edges = edges.where((F.col("src") != F.col("dst")) & (F.col("src") != RESERVED) & (F.col("dst") != RESERVED))
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        if vertices is None:
            return Graph(ids.distinct(), edges)
        vertices = vertices.withColumn("id", F.col("id").cast("bigint")).where(F.col("id") != RESERVED)
        rest = [c for c in vertices.columns if c != "id"]
        if rest:
            aggs = [getattr(F, (combine or {}).get(c, "any_value"))(c).alias(c) for c in rest]
            vertices = vertices.groupBy("id").agg(*aggs)
        ids = ids.union(vertices.select("id")).distinct()
        return Graph(ids.join(vertices, "id", "left") if rest else ids, edges)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def reversed(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def both_ways(self) -> DataFrame:
        """Each edge once from either end."""
        return self.edges.unionByName(self.reversed().edges)

    def undirected(self) -> Graph:
        """Neighbour pairs both ways, once each."""
        return Graph(self.vertices, self.both_ways().select("src", "dst").distinct())

    def along(self, direction: Direction) -> DataFrame:
        """Edges as (src, dst, ...) such that messages go from src to dst when a vertex gathers over ``direction``."""
        if direction is Direction.IN:
            return self.edges
        if direction is Direction.OUT:
            return self.reversed().edges
        if direction is Direction.ALL:
            return self.both_ways()
        return self.edges.limit(0)

    def degrees(self) -> DataFrame:
        ends = self.edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(self.edges.select("dst", F.lit(1), F.lit(0)))
        sums = ends.groupBy("id").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
        got = self.vertices.select("id").join(sums, "id", "left")
        return got.select("id", F.coalesce("in_deg", F.lit(0)).cast("bigint").alias("in_deg"), F.coalesce("out_deg", F.lit(0)).cast("bigint").alias("out_deg"))

    def counts(self) -> DataFrame:
        nv = self.vertices.agg(F.count(F.lit(1)).alias("num_vertices"))
        return nv.crossJoin(self.edges.agg(F.count(F.lit(1)).alias("num_edges")))  # one row each

    def with_out_degree(self) -> DataFrame:
        """Edges with src_deg, the source's number of out-edges."""
        deg = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("src_deg"))
        return self.edges.join(deg, "src")

    def partitioned(self, by: str = "src", parts: int | None = None, threshold: int = 100) -> Graph:
        """by: src, dst, or hybrid (by dst, but the in-edges of targets above the threshold by src)."""
        if by == "hybrid":
            deg = self.edges.groupBy("dst").agg(F.count(F.lit(1)).alias("__d"))
            marked = self.edges.join(deg, "dst").withColumn("__k", F.when(F.col("__d") > threshold, F.col("src")).otherwise(F.col("dst")))
            edges = (marked.repartition(parts, "__k") if parts else marked.repartition("__k")).select(*self.edges.columns)
        else:
            edges = self.edges.repartition(parts, by) if parts else self.edges.repartition(by)
        return Graph(self.vertices, edges)


def queries_of(spark: SparkSession, sources) -> DataFrame:
    """(qid, source) of a list of source ids; each is a query of its own, duplicates too."""
    return spark.createDataFrame([(i, int(s)) for i, s in enumerate(sources)], "qid int, source bigint")
