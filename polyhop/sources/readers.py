"""Graph and query readers. Lines are parsed in Column expressions; bad lines are dropped, or raise with failfast."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import RANGE, spread
from .graph import Graph

ISOLATED = 2**32 - 1


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).where(F.length("value") > 0)


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def _pair(lines: DataFrame, pattern: str, more: int = 0) -> DataFrame:
    names = ["src", "dst", "w"][: 2 + more]
    return lines.select(*[_long(F.regexp_extract("value", pattern, i + 1)).alias(n) for i, n in enumerate(names)])


def _checked(lines: DataFrame, edges: DataFrame, failfast: bool) -> DataFrame:
    good = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if failfast and not edges.where(F.col("src").isNull() | F.col("dst").isNull()).isEmpty():
        raise ValueError("a line doesn't parse")
    return good


def _delimited(pattern: str, skip: str | None = None, swap: bool = False, more: int = 0):
    def read(spark: SparkSession, path, failfast: bool) -> Graph:
        lines = _lines(spark, path)
        if skip:
            lines = lines.where(~F.col("value").rlike(skip))
        edges = _checked(lines, _pair(lines, pattern, more), failfast)
        if more:
            edges = edges.where(F.col("w").isNotNull())
        if swap:
            edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return Graph.of(edges)

    return read


def _adjacency(weighted: bool):
    """``v n nb...``; vertices without neighbours stay; lines whose n doesn't match are bad."""

    def read(spark: SparkSession, path, failfast: bool) -> Graph:
        f = F.filter(F.split(F.trim("value"), "[\\s,]+"), lambda x: x != "")
        rows = _lines(spark, path).select(f.alias("f")).select(_long(F.get("f", F.lit(0))).alias("id"), _long(F.get("f", F.lit(1))).alias("n"), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))).alias("r"))
        good = F.col("id").isNotNull() & (F.col("n") * (2 if weighted else 1) == F.size("r"))
        if failfast and not rows.where(~F.coalesce(good, F.lit(False))).isEmpty():
            raise ValueError("a line doesn't parse")
        rows = rows.where(good)
        if weighted:
            steps = F.when(F.size("r") > 0, F.sequence(F.lit(0), F.size("r") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
            pairs = F.transform(steps, lambda i: F.struct(_long(F.get("r", i)).alias("dst"), _long(F.get("r", i + 1)).alias("w")))
            edges = rows.select(F.col("id").alias("src"), F.explode(pairs).alias("p")).select("src", "p.dst", "p.w")
        else:
            edges = rows.select(F.col("id").alias("src"), F.explode("r").alias("d")).select("src", _long(F.col("d")).alias("dst"))
        return Graph.of(edges.where(F.col("dst").isNotNull()), rows.select("id"))

    return read


def _bintsv4(spark: SparkSession, path, failfast: bool) -> Graph:
    """Pairs of little-endian unsigned 32-bit ids; a target of 2**32 - 1 marks an isolated vertex."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = np.frombuffer(content.as_buffer(), "<u4")
                pairs = raw[: len(raw) // 2 * 2].reshape(-1, 2).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "src bigint, dst bigint")
    return Graph.of(rows.where(F.col("dst") != ISOLATED), rows.select(F.col("src").alias("id")))


def _tables(spark: SparkSession, path, failfast: bool) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


FORMATS = {
    "snap": _delimited("^\\s*(-?\\d+)\\s+(-?\\d+)", "^#"),
    "tsv": _delimited("^\\s*(-?\\d+)\\s+(-?\\d+)"),
    "rtsv": _delimited("^\\s*(-?\\d+)\\s+(-?\\d+)", swap=True),
    "csv": _delimited("^\\s*(-?\\d+)\\s*,\\s*(-?\\d+)", "^[^,]*$"),
    "msbfs": _delimited("^(\\d+).(\\d+)", "^[^0-9]"),
    "etuple": _delimited("^(\\d+).(\\d+)", "^[^0-9]"),
    "wtuple": _delimited("^(\\d+),(\\d+),(\\d+)", "^[^0-9]", more=1),
    "adj": _adjacency(False),
    "online_adj": _adjacency(False),
    "online_weighted_adj": _adjacency(True),
    "bintsv4": _bintsv4,
    "bin": _tables,
    "graphjrl": _tables,
}


def read(spark: SparkSession, fmt: str, path, weighted: bool = True, failfast: bool = False) -> Graph:
    """path: a file, a folder, a glob or a list of them; .gz files are read as they are. ``weighted=False`` refuses
    wtuple, whose edges have a weight."""
    if fmt not in FORMATS or (fmt == "wtuple" and not weighted):
        raise ValueError(f"no such format: {fmt}")
    return FORMATS[fmt](spark, path, failfast)


def ratings(spark: SparkSession, path, low: float = -1e100, high: float = 1e100) -> DataFrame:
    """``user item rating`` lines; the role goes by the file name's suffix; item ids become -(id + 2)."""
    f = F.split(F.trim("value"), "\\s+")
    name = F.input_file_name()
    role = F.when(name.endswith(".validate"), "VALIDATE").when(name.endswith(".predict"), "PREDICT").otherwise("TRAIN")
    rows = _lines(spark, path).select(_long(F.get(f, F.lit(0))).alias("src"), (-(_long(F.get(f, F.lit(1))) + 2)).alias("dst"), F.get(f, F.lit(2)).try_cast("double").alias("obs"), role.alias("role"))
    return rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("obs").isNull() | F.col("obs").between(low, high)))


def query_file(spark: SparkSession, path: str, num_query: int | None = None) -> DataFrame:
    """Line 1 names the number; line 2 has ids, each ended by a comma."""
    ids = F.filter(F.transform(F.regexp_extract_all("value", F.lit("(\\d+),"), F.lit(1)), lambda x: x.cast("bigint")), lambda x: x.isNotNull())
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split("value", "\\r?\\n"), 2).alias("value"))
    got = rows.select(F.posexplode(ids).alias("qid", "source"))
    return got.where(F.col("qid") < num_query) if num_query is not None else got


#: Degrees whose probabilities are summed one by one; the distribution beyond them is integrated.
EXACT_DEGREES = 64


def powerlaw(spark: SparkSession, n: int, alpha: float = 2.0, truncate: int = 10**8, in_degree: bool = False, seed: int = 1) -> DataFrame:
    """Edges of n vertices whose degrees follow d**-alpha up to ``truncate`` (and n - 1), drawn by inverting the
    distribution at a hash of the vertex; the t-th neighbour comes by a multiplicative step. alpha is above 1."""
    if alpha <= 1:
        raise ValueError("the exponent must be above 1")
    if n < 2:
        return spark.createDataFrame([], "src bigint, dst bigint")
    top, e = max(1, min(n - 1, truncate)), 1.0 - alpha
    few = min(top, EXACT_DEGREES)
    weights = [d**-alpha for d in range(1, few + 1)]
    # the tail's weight is the integral of x**-alpha from few + 1/2 to top + 1/2
    low, high = (few + 0.5) ** e, (top + 0.5) ** e
    tail = (low - high) / (alpha - 1) if top > few else 0.0
    total = sum(weights) + tail
    bounds = list(accumulate(w / total for w in weights))
    drawn = spark.range(n).select("id", (spread("id", seed).cast("double") / F.lit(float(RANGE))).alias("u"))
    u, below = F.col("u"), F.array(F.lit(-1.0), *[F.lit(c) for c in bounds[: few - 1]])
    exact = F.size(F.filter(below, lambda c: c <= F.col("u"))).cast("bigint")
    degree = exact
    if tail:
        share = (u - F.lit(bounds[-1])) / F.lit(1.0 - bounds[-1])
        far = F.pow(F.lit(low) - share * F.lit(low - high), F.lit(1.0 / e))
        degree = F.when(u < bounds[-1], exact).otherwise(F.least(F.floor(far + 0.5), F.lit(top)))
    rows = drawn.select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), degree)).alias("t"))
    other = F.pmod((F.col("id") + F.col("t") * F.lit(2654435761)), F.lit(n))
    a, b = ("dst", "src") if in_degree else ("src", "dst")
    return rows.select(F.col("id").alias(a), other.alias(b)).where(F.col(a) != F.col(b))
