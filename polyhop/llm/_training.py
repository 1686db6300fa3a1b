"""The bounded sample of labelled rows that the classifiers fit on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> pa.Table:
    """At most ``rows`` labelled texts that aren't held out, those of the smallest seeded hashes of their ids, in id
    order; of an id with several texts the first by code point. The bound is on the sample alone: every row is scored."""
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max(label).alias("label"))
    some = some.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(rows)
    got = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = got.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).toArrow()
    return got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
