"""Graph and result writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .readers import ISOLATED

LINES = {
    "tsv": lambda: F.concat_ws("\t", "src", "dst"),
    "snap": lambda: F.concat_ws("\t", "src", "dst"),
    "etuple": lambda: F.concat(F.concat_ws(",", "src", "dst"), F.lit("#")),
    "wtuple": lambda: F.concat(F.concat_ws(",", "src", "dst", "w"), F.lit("#")),
}


def save(graph: Graph, path: str, vertex: Column | None = None, edge: Column | None = None, gzip: bool = False, files: int | None = None) -> None:
    """One line for each vertex and edge whose expression is given."""
    parts = [t.select(c.alias("value")) for t, c in ((graph.vertices, vertex), (graph.edges, edge)) if c is not None]
    out = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    (out.repartition(files) if files else out).write.text(path, compression="gzip" if gzip else "none")


def write(graph: Graph, fmt: str, path: str, gzip: bool = False) -> None:
    if fmt in ("bin", "graphjrl"):
        graph.vertices.write.parquet(f"{path}/vertices")
        graph.edges.write.parquet(f"{path}/edges")
    elif fmt == "bintsv4":
        lonely = graph.vertices.select(F.col("id").alias("src")).join(graph.edges.select("src").distinct(), "src", "left_anti")
        far = lambda c: (F.col(c) < 0) | (F.col(c) >= ISOLATED)
        if not graph.vertices.where(far("id")).isEmpty() or not graph.edges.where(far("src") | far("dst")).isEmpty():
            raise ValueError(f"bintsv4 holds ids from 0 to {ISOLATED - 1}")
        pairs = graph.edges.select("src", "dst").union(lonely.select("src", F.lit(ISOLATED)))
        rows = pairs.select(F.unhex(F.concat(_le("src"), _le("dst"))).alias("content"))

        def put(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            for i, batch in enumerate(batches):  # a file a batch, so that none outgrows memory
                name = f"part-{TaskContext.get().partitionId():05d}-{i:05d}"
                content = b"".join(x.as_py() for x in batch.column("content"))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content])], names=["name", "content"])

        _put_files(rows.mapInArrow(put, "name string, content binary"), path)
    else:
        save(graph, path, edge=LINES[fmt](), gzip=gzip)


def _le(c: str) -> Column:
    """Eight hex digits, lowest byte first."""
    h = F.lpad(F.hex(c), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def _put_files(parts: DataFrame, path: str) -> None:
    """Binary files through Hadoop's file system, streamed to the driver one partition at a time."""
    sc = parts.sparkSession.sparkContext
    for row in parts.toLocalIterator():
        at = sc._jvm.org.apache.hadoop.fs.Path(path, row["name"])
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(row["content"]))
        out.close()


def metis(graph: Graph) -> DataFrame:
    """(id, neighbours): the undirected structure, each neighbour once, in order."""
    return graph.undirected().edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def hypergraph(graph: Graph) -> DataFrame:
    """(id, pins): each vertex' hyperedge of itself and its out-neighbours."""
    pins = graph.edges.select("src", "dst").union(graph.vertices.select(F.col("id"), F.col("id")))
    return pins.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("pins"))


def dump(result: DataFrame, path: str, value: str) -> None:
    """``id<tab>value`` lines in a folder for each query."""
    result.select("qid", F.concat_ws("\t", "id", value).alias("value")).write.partitionBy("qid").text(path)
