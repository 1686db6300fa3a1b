"""Connected components of a link table, in joins and aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut, release, scope


def components(links: DataFrame) -> DataFrame:
    """links: rows (a, b) of longs. (id, root, was): the smallest id that each linked id reaches. Each round takes the
    smallest label among neighbours and then the label's own label, so chains shrink by halves."""
    with scope() as keep:
        both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "links")
        first = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "id")
        labels = cut(first.select("id", "root", F.col("root").alias("was")), "labels")
        while True:
            before, known = labels, labels.select("id", "root")
            near = both.join(known.select(F.col("id").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
            step = known.join(near, known["id"] == near["u"]).select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
            up = known.select(F.col("id").alias("root"), F.col("root").alias("top"))
            step = step.join(up, "root", "left").select("id", F.least("root", F.coalesce("top", "root")).alias("root"), "was")
            labels = cut(step, "labels")
            if labels.where(F.col("was") != F.col("root")).isEmpty():
                return keep(labels)
            if before is not labels:
                release(before)
