"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and queue up, the whole source up to three times over. A
document's virtual finish time is what its source has queued up to and with it, in words, divided by the source's
target. All documents of all sources are then ordered by finish time and taken while the sum stays within the budget.
Sums over a source or over the order go through a table of slice totals, so no task holds a source or the order.

Sources go by code point, null last. An empty source name is a source of its own. A document of no words takes no
words. Repeated rows are documents of their own, in any order among themselves. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spread import RANGE, spread
from ._tables import cut, own_names, whole

SEED = 11
#: What a document's place in its source's shuffled queue is drawn from, as SQL, so that SQL can repeat the draw.
DRAWN = "coalesce(doc_id % 2147483647, -1) * 31 + size % 1000"
EPOCHS = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Slices of a source's queue, at least; there are more where a slice of the whole table would hold above SLICE_ROWS rows.
SLICES = 512
SLICE_ROWS = 1 << 16
#: Bins of the finish times; the one in which the budget ends is divided again until it holds at most SLICE_ROWS runs.
BINS = 4096


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.0, cap: float = EPOCHS) -> dict:
    """{source: words}: share of all words by repeating weights in code-point order, none above cap times its own size;
    what is cut off is shared again among the others by weight until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, got = share * sum(size.values()), set(size), dict.fromkeys(size, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * size[s]}
        if not over:
            got |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            got[s] = cap * size[s]
            left -= got[s]
        open_ -= over
    return got


def _before(totals: DataFrame, by: list[str], order: str, value: str, to: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(to, F.coalesce(F.sum(value).over(w), F.lit(0)))


def queue(sized: DataFrame, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """doc_id, source, size with ``upto``: the source's words up to and with this document in shuffled order."""
    rows = sized.withColumn("key", spread(DRAWN, seed)).withColumn("slice", F.floor(F.col("key") * slices / RANGE).cast("int"))
    totals = rows.groupBy("source", "slice").agg(F.sum("size").alias("part"))
    # one row for each source and slice, however many documents there are
    start = _before(totals, ["source"], "slice", "part", "start").select(F.col("source").alias("s_"), F.col("slice").alias("l_"), "start")
    w = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(w))
    on = F.col("source").eqNullSafe(F.col("s_")) & (F.col("slice") == F.col("l_"))
    return rows.join(start, on, "left").select("doc_id", "source", "size", "key", (F.col("start") + F.col("within")).alias("upto"))


def _edge(runs: DataFrame, budget: int, rows: int = SLICE_ROWS) -> tuple[float, dict | None] | None:
    """Where the budget ends in the order of finish times: all runs that finish before the time go, and those up to the
    row (finish, key, doc_id), if there is one. None if all fit. A run's finish is its source's alone, so that equal
    times are as many as sources at most, and dividing the bin comes to an end."""
    low, width, used, inside = 0.0, 2.0 / BINS, 0, F.lit(True)
    while True:
        bin_ = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).alias("bin")
        sums = [F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("finish").alias("low"), F.max("finish").alias("high")]
        bins = runs.where(inside).groupBy(bin_).agg(*sums).collect()  # at most BINS rows
        for edge in sorted(bins):
            if used + edge["n"] > budget:
                break
            used += edge["n"]
        else:
            return None
        low, high = edge["low"], edge["high"]
        inside, width = F.col("finish").between(low, high), (high - low) / BINS
        if edge["rows"] <= rows or width == 0.0:
            break
    w = Window.orderBy("finish", "key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = runs.where(inside).withColumn("sum", F.sum("size").over(w)).where(F.col("sum") <= budget - used)
    last = last.agg(F.max(F.struct("finish", "key", "doc_id")).alias("x")).first()["x"]
    return low, last.asDict() if last else None


def mix(sized: DataFrame, weights=WEIGHTS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """sized: doc_id, source, size. Adds source_size, target and taken (words, repeats counted)."""
    spark = sized.sparkSession
    # one row a source: the table of sources is the mixture's own parameter list
    totals = [(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(totals, weights, share)
    budget = int(share * sum(n for _, n in totals))
    table = spark.createDataFrame([(s, n, float(goal[s])) for s, n in totals] or [(None, 0, 0.0)], "t_ string, source_size bigint, target double")
    slices = max(SLICES, math.ceil(sized.count() / SLICE_ROWS))
    queued = queue(sized, seed, slices).join(F.broadcast(table), F.col("source").eqNullSafe(F.col("t_")), "left").drop("t_")
    queued = cut(queued, "queue")
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("upto")) / F.col("target")
    runs = queued.where((F.col("size") > 0) & (F.col("target") > 0))
    runs = runs.select("key", "doc_id", "size", F.explode(F.array(*[finish(e) for e in range(EPOCHS)])).alias("finish"))
    edge = _edge(runs, budget)
    taken = F.lit(0).cast("bigint")
    for e in range(EPOCHS):
        ok = F.lit(True)
        if edge is not None:
            low, last = edge
            ok = finish(e) < F.lit(low)
            if last is not None:
                at = F.struct(finish(e).alias("finish"), F.col("key"), F.col("doc_id"))
                ok = ok | (at <= F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["key"]).cast("bigint").alias("key"), F.lit(last["doc_id"]).cast("bigint").alias("doc_id")))
        taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & ok, F.col("size")).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of the text; a null text has none."""
    text = whole(F.col("text"))
    n = F.regexp_count(text, F.lit("[^ \\t-\\r]+"))
    return docs.select("doc_id", "source", n.cast("bigint").alias("size"))


@own_names
def mixture(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, a document taken r times as r rows, in the columns of docs. Rows of one
    doc_id all go as often as the one that goes most often."""
    got = mix(cut(sized(docs), "sizes"), weights, share, seed)
    times = got.where(F.col("taken") > 0).select(F.col("doc_id").alias("__id"), (F.col("taken") / F.col("size")).cast("int").alias("n"))
    times = times.groupBy("__id").agg(F.max("n").alias("__times"))
    rows = docs.join(times.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")))  # grows with docs: never a broadcast
    return rows.withColumn("__r", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    got = mix(cut(sized(docs), "sizes"))
    return got.select("doc_id", "size", "source_size", "target", "taken")
