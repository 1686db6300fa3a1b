"""Cutting lineage in loops: a written table in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = f"file://{tempfile.mkdtemp(prefix='polyhop-')}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a Spark application."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():  # in an archive it is on the executors' path already
        return
    _shipped.add(sc.applicationId)
    to = Path(tempfile.mkdtemp(prefix="polyhop-")) / "polyhop-graph.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that go when the JVM ends."""
    path = f"{shared_dir(spark)}/polyhop/{uuid.uuid4().hex}-{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written and read again, so that a loop's plan doesn't grow and a lost executor costs one superstep at most."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._polyhop_table = path
    return out


def laid(df: DataFrame, *keys: str, deal: bool = False) -> DataFrame:
    """As ``cut``, in buckets of the keys, as many as a shuffle has partitions: joins and aggregates by the keys read the
    table where it lies. df is dealt out by the keys first, unless it is already, as after a join on them."""
    spark = df.sparkSession
    name, n = f"polyhop_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    (df.repartition(n, *keys) if deal else df).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._polyhop_table, out._polyhop_name = path, name
    return out


def unlaid(df: DataFrame) -> DataFrame:
    """The files of a table of ``laid`` without the catalogue's entry, which goes."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._polyhop_name}")
    return df.sparkSession.read.schema(df.schema).parquet(df._polyhop_table)


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` and ``laid`` that nothing reads any more."""
    for df in tables:
        if name := getattr(df, "_polyhop_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._polyhop_table)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def bucketed(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """df as ``laid`` by keys for the length of a ``with`` block."""
    out = laid(df, *keys, deal=True)
    try:
        yield out
    finally:
        release(out)
