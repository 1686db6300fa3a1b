"""Queries that write the main graph in each format, read it back, and give what was read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow as D
from ..sources import readers, writers
from ..sources.graph import Graph, queries_of
from ..tables import scratch
from . import algorithms as A
from .bsp import Watch, run
from .queries import G2, G3, IBFS, BFS, E, Q8, V, _ratings, graph, query

PAIRS = f"SELECT src, dst FROM ({G2}) g"


def _put_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def _edges(fmt: str, write: Callable[[Graph, str], None], weighted: bool = False):
    """The edges of the main graph after a way through files."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, fmt)
        write(graph(spark, sf_dir), path)
        return readers.read(spark, fmt, path).edges.select("src", "dst", *(["w"] if weighted else []))

    return f


def _as(fmt: str):
    return lambda g, path: writers.write(g, fmt, path)


def _lines(vertex: str, between: str):
    """Lines that a reader is to skip, one a vertex, and the pairs."""
    return lambda g, path: writers.save(g, path, vertex=F.concat(F.lit(vertex), "id"), edge=F.concat_ws(between, "src", "dst"))


query("read_tsv", PAIRS)(_edges("tsv", _as("tsv")))
query("read_snap", PAIRS)(_edges("snap", _lines("# vertex ", "\t")))
query("read_rtsv", "SELECT dst AS src, src AS dst FROM (" + G2 + ") g")(_edges("rtsv", _as("tsv")))
query("read_csv", PAIRS)(_edges("csv", _lines("vertex ", ",")))
query("read_msbfs", PAIRS)(_edges("msbfs", _lines("#", " ")))
query("read_etuple", PAIRS)(_edges("etuple", _as("etuple")))
query("read_wtuple", G2)(_edges("wtuple", _as("wtuple"), weighted=True))
query("read_adj", PAIRS)(_edges("adj", lambda g, path: _put_lines(D.adjacency_lines(g), path)))
query("read_online_adj", PAIRS)(_edges("online_adj", lambda g, path: _put_lines(D.adjacency_lines(g), path)))
query("read_online_weighted_adj", G2)(_edges("online_weighted_adj", lambda g, path: _put_lines(D.adjacency_lines(g, "w"), path), weighted=True))
query("read_bintsv4", PAIRS)(_edges("bintsv4", _as("bintsv4")))
query("read_bin", G2)(_edges("bin", _as("bin"), weighted=True))
query("read_graphjrl", G2)(_edges("graphjrl", _as("graphjrl"), weighted=True))
query("read_gzip", PAIRS)(_edges("tsv", lambda g, path: writers.write(g, "tsv", path, gzip=True)))


@query("read_isolated", f"SELECT src AS id FROM ({G2}) g UNION SELECT dst FROM ({G2}) h UNION SELECT CAST(c_custkey + 5000 AS BIGINT) FROM customer")
def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices without edges through bintsv4, which marks them by the reserved target."""
    more = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") + 5000).alias("id"))
    path = scratch(spark, "isolated")
    writers.write(Graph.of(graph(spark, sf_dir).edges, more), "bintsv4", path)
    return readers.read(spark, "bintsv4", path).vertices.select("id")


@query("read_many_inputs", f"SELECT src, dst FROM ({G2}) g WHERE src % 2 = 0 UNION ALL SELECT src, dst FROM ({G2}) h WHERE src % 3 = 0")
def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several folders as one input; a pair that two of them hold stays twice."""
    g = graph(spark, sf_dir)
    paths = [scratch(spark, f"input{k}") for k in (2, 3)]
    for k, path in zip((2, 3), paths, strict=True):
        writers.write(Graph(g.vertices, g.edges.where(F.col("src") % k == 0)), "tsv", path)
    return readers.read(spark, "tsv", paths).edges.select("src", "dst")


@query("read_unweighted", PAIRS)
def unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of formats without weights."""
    path = scratch(spark, "unweighted")
    writers.write(graph(spark, sf_dir), "snap", path)
    return readers.read(spark, "snap", path, weighted=False).edges.select("src", "dst")


def _rename(spark: SparkSession, path: str, to: str) -> str:
    """Gives the files of a folder a suffix."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        at = status.getPath()
        if at.getName().startswith("part-"):
            files.rename(at, sc._jvm.org.apache.hadoop.fs.Path(folder, at.getName() + to))
    return path


@query("read_ratings", f"SELECT src, dst, round(obs, 6) AS obs, role FROM ({G3}) r")
def read_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user item rating`` lines, whose files' suffix gives the role."""
    rows = _ratings(spark, sf_dir)[0]
    paths = []
    for role, suffix in (("TRAIN", ""), ("VALIDATE", ".validate")):
        path = scratch(spark, role.lower())
        rows.where(F.col("role") == role).select(F.concat_ws(" ", "src", -F.col("dst") - 2, "obs").alias("value")).write.text(path)
        paths.append(_rename(spark, path, suffix) if suffix else path)
    return readers.ratings(spark, paths).select("src", "dst", F.round("obs", 6).alias("obs"), "role")


@query("read_query_file", "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS qid, CAST(c_custkey AS BIGINT) AS source FROM customer WHERE c_custkey % 10 = 3 AND c_custkey < 1000")
def read_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with the number of queries and a line of ids, each ended by a comma."""
    some = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 = 3 AND c_custkey < 1000")
    ids = F.array_join(F.sort_array(F.collect_list(F.col("c_custkey"))), ",")
    path = scratch(spark, "queries")
    text = some.agg(F.concat(F.lit("num_queries="), F.count(F.lit(1)), F.lit(",\n"), ids, F.lit(",\n")).alias("value"))
    text.coalesce(1).write.text(path)
    return readers.query_file(spark, path).select("qid", "source")


@query("save_lines", f"WITH {E}, {V} SELECT 'v ' || id AS value FROM v UNION ALL SELECT 'e ' || src || ' ' || dst || ' ' || w FROM e")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of the caller's form for each vertex and each edge."""
    path = scratch(spark, "lines")
    edge = F.concat(F.lit("e "), F.concat_ws(" ", "src", "dst", "w"))
    writers.save(graph(spark, sf_dir), path, vertex=F.concat(F.lit("v "), "id"), edge=edge, gzip=True, files=3)
    return spark.read.text(path)


_three = IBFS.format(e=E, v=V, q=Q8, b=BFS.format(t="e").replace("d < 30", "d < 3"))


@query("dump_by_query", f"SELECT qid, id || chr(9) || hops AS value FROM ({_three}) t")
def dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id<tab>value`` lines in a folder for each query."""
    path = scratch(spark, "dump")
    writers.dump(run(A.ibfs(), graph(spark, sf_dir), queries_of(spark, range(1, 9)), max_iterations=3).df, path, "value")
    return spark.read.text(path).select(F.col("qid").cast("int").alias("qid"), "value")


@query("snapshot_resumed", _three)
def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after two supersteps, as the run's snapshot has it, taken a superstep on."""
    g, q, path = graph(spark, sf_dir), queries_of(spark, range(1, 9)), scratch(spark, "snapshots")
    run(A.ibfs(), g, q, max_iterations=2, watch=Watch(snapshot_every=2, snapshot_path=path))
    start = spark.read.parquet(f"{path}/superstep=2").select("qid", "id", "value")
    return run(A.ibfs(), g, q, max_iterations=1, start=start).df.select("qid", "id", F.col("value").alias("hops"))
