"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the rows by a seeded hash of their key into buckets of a size that one task's memory holds, and within
them into cells; their number grows with the rows and with the bytes, whichever asks for more. Pass two runs a
Fisher-Yates shuffle over the rows of each cell. Buckets, then cells, then shuffled places give every row its rank in one uniformly random order; row r goes to shard r mod n, slot
r div n, so that the shards' row counts differ by one at most (law ``rows``).

The same seed and rows give the same order whatever the partitions. Null keys and null texts are rows like others. Equal
rows beyond a handful are counted first and scattered in handfuls, so that no cell grows with them. A single row is never
cut, so a cell holds a row longer than CELL_BYTES whole. Columns must be comparable (no maps).

The query shuffles the documents with their texts; sizes and crc32 are of the texts that come out of the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut, documents, own_names, whole

SEED = 20_240_517
SHARDS = 16
#: Rows and bytes a cell should hold: one Fisher-Yates array; and cells a bucket has.
CELL_ROWS = 128
CELL_BYTES = 1 << 18
BUCKET_CELLS = 512
#: Equal rows that go to a cell together.
HANDFUL = 32


def _draw(seed: int, *of: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def fisher_yates(n: Column, seed: int, *of: Column) -> Column:
    """The array 0..n-1, shuffled: from the last place down, each place swaps with a drawn one not above it."""

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(_draw(seed, *of, i), i + 1).cast("int")
        return F.transform(a, lambda x, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(x))

    ids = F.sequence(F.lit(0), n - 1)
    down = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(down, ids, swap)


def buckets_for(rows: int, size: int) -> int:
    """Buckets of so many rows and bytes."""
    return max(1, math.ceil(max(rows / CELL_ROWS, size / CELL_BYTES) / BUCKET_CELLS))


def _handfuls(df: DataFrame, seed: int) -> DataFrame:
    """Entries of the shuffle: df's columns, ``__times`` and ``__part``. Rows are entries of their own unless more than
    HANDFUL are equal in all columns (as far as a hash tells). Then equal rows are counted before any is sent, and dealt in
    entries of at most HANDFUL, numbered by ``__part``, so that neither a cell nor a task holds them all."""
    h = _draw(seed + 3, *df.columns)
    if df.groupBy(h.alias("h")).count().where(F.col("count") > HANDFUL).isEmpty():
        return df.withColumns({"__part": F.lit(0), "__times": F.lit(1)})
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__all"))
    parts = counted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col("__all") - 1) / HANDFUL).cast("int"))))
    return cut(parts.withColumn("__times", F.least(F.lit(HANDFUL), F.col("__all") - F.col("__part") * HANDFUL).cast("int")).drop("__all"), "handfuls")


@own_names
def shuffle(df: DataFrame, key: list[str], shards: int = SHARDS, seed: int = SEED, rows: int | None = None) -> DataFrame:
    """df with ``shard`` and ``slot``. key: columns that tell rows apart; rows: df's count, if it is known."""
    df = df.drop("shard", "slot")
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    counted, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    buckets = buckets_for(counted if rows is None else rows, size)
    names = df.columns
    entries = _handfuls(df, seed)
    h = [F.col(k) for k in key] + [F.col("__part")]
    place = entries.withColumn("__b", F.pmod(_draw(seed, *h), F.lit(buckets)).cast("int"))
    place = place.withColumn("__c", F.pmod(_draw(seed + 1, *h), F.lit(BUCKET_CELLS)).cast("int"))
    row = F.struct(*[F.col(k) for k in key], *[c for c in names if c not in key])
    cell = place.groupBy("__b", "__c").agg(F.sort_array(F.collect_list(F.struct(row.alias("row"), "__part", "__times"))).alias("__rows"))
    cell = cell.withColumn("__rows", F.flatten(F.transform("__rows", lambda r: F.array_repeat(r["row"], r["__times"]))))
    cell = cell.withColumn("__n", F.size("__rows"))
    # cells of a bucket: at most BUCKET_CELLS rows a window
    sizes = place.groupBy("__b", "__c").agg(F.sum("__times").alias("__m"))
    within = Window.partitionBy("__b").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__m").over(within), F.lit(0)))
    total = place.groupBy("__b").agg(F.sum("__times").alias("__t"))
    over = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row for CELL_ROWS * BUCKET_CELLS rows
    total = total.select(F.col("__b"), F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__start"))
    cell = cell.join(sizes, ["__b", "__c"]).join(total, "__b")
    cell = cell.withColumn("__perm", fisher_yates(F.col("__n"), seed + 2, F.col("__b"), F.col("__c")))
    dealt = F.transform("__perm", lambda p: F.get("__rows", p))  # before the rows part, so that none carries its whole cell
    out = cell.select((F.col("__start") + F.col("__before")).alias("__from"), F.posexplode(dealt).alias("__k", "__row"))
    out = out.withColumn("__rank", F.col("__from") + F.col("__k"))
    return out.select(
        *[F.col(f"__row.{c}").alias(c) for c in df.columns],
        F.pmod("__rank", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__rank") / shards).cast("bigint").alias("slot"),
    )


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a shuffled table as one folder a shard, each sorted by slot."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.mode(mode).partitionBy("shard").parquet(path)


def op7(docs: DataFrame) -> DataFrame:
    out = shuffle(docs.select("doc_id", "text"), ["doc_id", "text"])
    text = whole(F.col("text"))
    size = (F.octet_length(text) + 1).cast("bigint").alias("size")
    crc = F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return op7(documents(spark, sf_dir))
