"""Reading inputs and cutting lineage, shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word characters: anything but space and the ASCII controls from tab to carriage return.
SPACE = "[ \\t-\\r]+"


_shipped: set[str] = set()
_scopes: list[list[DataFrame]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark application, so that their Python finds it too."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # the package itself came in an archive, which is on the executors' path already
        return
    to = Path(tempfile.mkdtemp(prefix="polyhop-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where it is unset on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = f"file://{tempfile.mkdtemp(prefix='polyhop-')}"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


#: What holds while a table is written: its shuffle files go afterwards, and Python gets texts in batches of bounded size.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what follows neither recomputes it nor depends on the
    executors that made it. The shuffle files behind it go when it is written, the table when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/polyhop/{uuid.uuid4().hex}-{name}"
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._polyhop_table = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scope():
    """Tables that ``cut`` writes inside a ``with`` block go at its end, but for those given to the function it yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.pop()
        release(*[t for t in made if all(t is not k for k in kept)])
        if _scopes:
            _scopes[-1].extend(kept)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and nothing later reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._polyhop_table)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def own_names(op):
    """Lets an operator on a frame use names that begin with two underscores for columns of its own: columns of such names
    that the caller has go by others meanwhile."""

    @wraps(op)
    def run(df: DataFrame, *args, **kw) -> DataFrame:
        taken = {c for c in df.columns if c.startswith("__")}
        names: dict[str, str] = {}
        for c in taken:
            name = f"held{len(names)}"
            while name in df.columns:
                name += "_"
            names[c] = name
        args = [[names.get(x, x) for x in a] if isinstance(a, list) else a for a in args]
        out = op(df.withColumnsRenamed(names) if names else df, *args, **kw)
        return out.withColumnsRenamed({v: c for c, v in names.items()}) if names else out

    return run


def words(text):
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def whole(text):
    return F.coalesce(text, F.lit(""))
