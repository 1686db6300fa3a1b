"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's shingles are its runs of ``width`` words (all its words, if it has fewer); the sketch holds the k smallest
distinct 64-bit hashes of them in ascending order. Sketches of parts merge into the sketch of the union, and estimate
resemblance, containment and the number of distinct shingles.

Null and empty texts have an empty sketch; two empty sketches resemble each other fully, an empty and a full one not
at all. Equal texts have equal sketches. Columns that the operator adds replace those of the same name.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import own_names, whole, words

K = 128
WIDTH = 5
#: Rows that one slice of the doc_id order should hold, and the most slices there are: beyond, slices grow and spill.
SLICE_ROWS = 1024
MAX_SLICES = 65_536
_FAN = 256


def with_sketch(df: DataFrame, text: str, to: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds ``to``, an array of at most k longs."""
    tmp_h, tmp_s = f"__h_{to}", f"__s_{to}"
    n = F.size(tmp_h)
    df = df.withColumn(tmp_h, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    many = F.transform(
        F.slice(F.col(tmp_h), F.lit(1), F.greatest(n - (width - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col(tmp_h), i + F.lit(j)) for j in range(1, width)]),
    )
    few = F.when(n > 0, F.array(F.xxhash64(F.col(tmp_h)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(tmp_s, F.when(n >= width, many).otherwise(few)).drop(tmp_h)
    return df.withColumn(to, F.slice(F.sort_array(F.array_distinct(tmp_s)), 1, k)).drop(tmp_s)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard estimate: the share of the union's k smallest hashes that both sketches hold."""
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(low), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a share of the hash range."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has: r (|A| + |B|) / ((1 + r) |A|), at most 1."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * F.greatest(na, F.lit(1.0)))))


def merge(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch a group. Each task forwards at most k hashes of a group, so a group of any size merges."""
    cells = df.select(*by, F.explode(sketch).alias("__x")).distinct()
    top = cells.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__x"))).where(F.col("__r") <= k)
    return top.groupBy(*by).agg(F.sort_array(F.collect_list("__x")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """16 hex digits a hash, joined."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def from_text(text: Column) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.length(text) / 16 - 1, F.lit(0)).cast("int"))
    low = lambda i: F.conv(F.substring(text, i * 16 + 9, F.lit(8)), 16, 10).cast("bigint")
    high = lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(8)), 16, 10).cast("bigint")
    whole_ = F.transform(at, lambda i: F.shiftleft(high(i), 32).bitwiseOR(low(i)))
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(whole_)


def _slice_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most key, found in two levels; -1 for null."""
    if not cuts:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    coarse = F.array(*[F.lit(c).cast("bigint") for c in cuts[_FAN - 1 :: _FAN]]).cast("array<bigint>")
    fine = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    jump = F.size(F.filter(coarse, lambda c: c <= key)) * _FAN
    near = F.slice(fine, jump + 1, F.lit(_FAN))
    return F.when(key.isNull(), F.lit(-1)).otherwise(jump + F.size(F.filter(near, lambda c: c <= key)))


def with_next(df: DataFrame, key: str, carry: dict[str, str], tie: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds to each row columns of the next one in descending key order (nulls last; equal keys by descending tie, a
    64-bit hash; after the last row comes the first). The order is cut into slices at quantiles of the key, a key of many
    rows and the null key also by their ties; and the first row of each slice is also sent to the slice above it, so that
    one shuffle and a window a slice suffice. A window reads its rows in order and spills, so a slice may outgrow memory.

    carry: {column: name for the next row's value}."""
    spark, count = df.sparkSession, df.count()
    slice_rows = max(slice_rows, math.ceil(count / MAX_SLICES))
    slices = max(1, math.ceil(count / slice_rows))
    cuts: set[int] = set()
    if slices > 1:
        at = [i / slices for i in range(1, slices)]
        found = df.agg(F.percentile_approx(key, at, max(20_000, 4 * slices))).first()[0] or []
        often = {a for a, b in itertools.pairwise(found) if a == b and a < 2**63 - 1}
        cuts = set(found) | {a + 1 for a in often}  # a key of many rows has a slice of its own
    s, sub, ghost = "__slice", "__sub", "__ghost"
    df = df.withColumn(s, _slice_of(F.col(key), sorted(cuts)))
    # of these, of parts and of heads there are at most 4 MAX_SLICES rows of numbers
    seen = df.groupBy(s).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("z")).collect()
    parts = [(r[s], math.ceil(r["n"] / slice_rows)) for r in seen if r["a"] == r["z"] and r["n"] > 2 * slice_rows]
    share = F.col(tie) / F.lit(2.0**64) + F.lit(0.5)
    if parts:
        hot = spark.createDataFrame(parts, "__slice int, __parts int")
        df = df.join(F.broadcast(hot), s, "left").withColumn(sub, F.coalesce(F.floor(share * F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    else:
        df = df.withColumn(sub, F.lit(0))
    heads = df.groupBy(s, sub).agg(F.max(F.struct(key, tie)).alias("head")).orderBy(F.col(s).desc(), F.col(sub).desc()).collect()
    # a slice's first row also closes the slice above; the first of all closes the last
    up = [(r["head"][key], r["head"][tie], heads[i - 1][s], heads[i - 1][sub]) for i, r in enumerate(heads)]
    to = spark.createDataFrame(up or [(None, None, 0, 0)], "__key bigint, __tie bigint, __to int, __tosub int")
    rows = df.join(F.broadcast(to), F.col(key).eqNullSafe(F.col("__key")) & (F.col(tie) == F.col("__tie")), "left").drop("__key", "__tie")
    places = F.array(F.struct(F.col(s).alias("at"), F.col(sub).alias("sub"), F.lit(0).alias("ghost")), F.struct(F.col("__to").alias("at"), F.col("__tosub").alias("sub"), F.lit(1).alias("ghost")))
    rows = rows.withColumn("__p", F.explode(F.filter(places, lambda p: p["at"].isNotNull()))).drop(s, sub, "__to", "__tosub")
    rows = rows.withColumns({s: F.col("__p.at"), sub: F.col("__p.sub"), ghost: F.col("__p.ghost")}).drop("__p")
    w = Window.partitionBy(s, sub).orderBy(F.col(ghost), F.col(key).desc_nulls_last(), F.col(tie).desc())
    rows = rows.withColumns({name: F.lead(column).over(w) for column, name in carry.items()})
    return rows.where(F.col(ghost) == 0).drop(s, sub, ghost)


@own_names
def fingerprint(df: DataFrame, text: str = "text", to: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """The operator: all columns of df and the sketch of a text column."""
    return with_sketch(df, text, to, k, width)


def op1(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The contract's digest: each document, an edited form of it, and the next document in descending doc_id."""
    base = fingerprint(docs.select("doc_id", whole(F.col("text")).alias("text")), "text", "fp")
    base = base.withColumn("tie", F.xxhash64("text"))
    near = with_next(base, "doc_id", {"text": "next_text", "fp": "next_fp"}, "tie", slice_rows)
    near = near.withColumn("n_chars", F.length("text").cast("bigint"))
    gone = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - gone), F.substring(F.col("next_text"), F.lit(1), gone))
    near = near.withColumn("edited", edited).drop("text", "next_text")
    near = fingerprint(near, "edited", "edited_fp")
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        distinct_shingles(F.col("fp")).alias("n_shingles"),
    )
