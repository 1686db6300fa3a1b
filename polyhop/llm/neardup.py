"""Near-duplicates of bags of word shingles: BagMinHash signatures, bands, and verified multiset overlap.

A document's bag holds its runs of five words (all its words if it has fewer), each with its count. The similarity of
two bags is the sum of the smaller counts over the sum of the larger ones. Counts are cut at the powers of two into
intervals; for each shingle and interval a Poisson process of the interval's width deals points in time to signature
places and to counts in the interval, and a bag keeps the first point of each place whose count it has. Only points
before a time that is almost surely late enough are made; a bag with an empty place is tried again with twice the time.

Documents with the same words form a class at once. Of the classes' first documents, signature bands give candidates:
each band's bucket links its members to its first one, and the pair's overlap is counted exactly. The members of buckets
that still hold more than one component then meet by their rarest elements (prefix filtering, which loses no pair), and
those pairs are counted too. Components of the verified links are the groups.

Null and empty texts have an empty bag; two such documents are copies. Rows with a null doc_id belong to no group.
Rows with equal doc_id and words are one document; rows with equal doc_id and different words are documents of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._tables import cut, documents, map_arrow, own_names, scope
from .components import components

WIDTH = 5
THRESHOLD = 0.8
#: Places of a signature: BANDS bands of ROWS; a pair at 0.8 shares one with probability 1 - (1 - 0.8**5)**24 = 0.99993.
BANDS, ROWS = 24, 5
PLACES = BANDS * ROWS
#: Documents signed at once, at most: each takes some ten points a place, however short it is.
SIGN_ROWS = 1000
SIGNED = "doc_id bigint, k1 bigint, k2 bigint, total bigint, bands array<bigint>"


def bags(b: T.Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, T.Tokens, np.ndarray]:
    """(document, shingle, count), sorted by document and shingle; the tokens and the words' hashes."""
    t = T.tokens(b)
    h = T.span_hash(b.prefix(), t.starts, t.ends)
    d, g = T.shingles(h, t.doc, b.hi - b.lo, width, 5)
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    return d[at], g[at], np.diff(np.append(at, len(d))), t, h


def signatures(d: np.ndarray, g: np.ndarray, w: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """(n, places) point identities of the bags (document, shingle, count); empty bags' rows are 0."""
    out = np.zeros((n, places), T.U)
    total = np.bincount(d, weights=w, minlength=n)
    # the intervals of counts [0, 1), [1, 2), [2, 4), ... that a count reaches into
    reach = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 2))).astype(np.int64), 0) + 1
    of = np.repeat(np.arange(len(d)), reach)
    level = np.arange(len(of)) - np.repeat(np.cumsum(reach) - reach, reach)
    base = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    wide = np.where(level > 0, base, 1.0)
    seed = T.mix(g[of] + level.astype(T.U) * T.U(0xA0761D6478BD642F))
    doc, most = d[of], w[of]
    todo, patience = np.flatnonzero(total > 0), np.log(places) + 5.0
    while len(todo):
        until = np.full(n, -1.0)
        until[todo] = patience / total[todo]
        first = np.full(n * places, np.inf)
        live = np.flatnonzero(until[doc] > 0)
        time, k = np.zeros(len(live)), 0
        seen = []
        while len(live):
            k += 1
            r = T.mix(seed[live] + T.U(k * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            u = ((r >> T.U(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(u) / (wide[live] * places)
            on = time <= until[doc[live]]
            live, time, r = live[on], time[on], r[on]
            point = T.mix(r ^ T.U(0x5851F42D4C957F2D))
            count = base[live] + np.floor((point & T.U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * wide[live])
            ok = count < most[live]
            place = doc[live[ok]] * places + ((point[ok] >> T.U(32)) % T.U(places)).astype(np.int64)
            np.minimum.at(first, place, time[ok])
            seen.append((place, time[ok], point[ok]))
        for place, at, point in seen:
            hit = first[place] == at
            out.reshape(-1)[place[hit]] = point[hit]
        empty = np.isinf(first.reshape(n, places)[todo]).any(axis=1)
        out[todo[empty]] = 0
        todo, patience = todo[empty], patience * 2
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    key = np.zeros((len(sig), bands), T.U) + T.mix(np.arange(1, bands + 1, dtype=T.U))[None, :]
    cube = sig.reshape(len(sig), bands, rows)
    for j in range(rows):
        key = T.mix(key * T.U(0xD6E8FEB86659FD93) + cube[:, :, j])
    return key


def word_keys(t: T.Tokens, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's sequence of words."""
    counts = t.counts(n)
    ends = np.cumsum(counts)
    place = (np.arange(len(h)) - np.repeat(ends - counts, counts)).astype(T.U)
    out = []
    for salt in (1, 2):
        sums = np.concatenate([np.zeros(1, T.U), np.cumsum(T.mix(h + T.mix(place * T.U(2) + T.U(salt << 40))), dtype=T.U)])
        out.append(T.mix(sums[ends] - sums[ends - counts] + counts.astype(T.U) * T.U(salt)))
    return out[0], out[1]


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, the words' two hashes, the bag's size and the signature's bands (none for an empty bag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.blocks(batch.column("text"), T.BLOCK // 2, SIGN_ROWS):
                n = b.hi - b.lo
                d, g, w, t, h = bags(b)
                total = np.bincount(d, weights=w, minlength=n).astype(np.int64)
                keys = band_keys(signatures(d, g, w, n))
                some = total > 0
                offs = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                k1, k2 = word_keys(t, h, n)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[some].reshape(-1).view(np.int64)))
                new = [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(total), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.lo, n), *new], names=["doc_id", "k1", "k2", "total", "bands"])

    return map_arrow(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), run, SIGNED)


def overlaps(pairs: DataFrame) -> DataFrame:
    """pairs: rows (a, b, text_a, text_b). (a, b, similarity) of their bags, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in ("text_a", "text_b"))
            of = np.cumsum(size) // T.BLOCK  # texts of so many bytes at once, or one longer pair
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), batch.num_rows]
            for lo, hi in itertools.pairwise(cuts):
                part = batch.slice(lo, hi - lo)
                n = part.num_rows
                sides = []
                for name in ("text_a", "text_b"):
                    got = []
                    for b in T.blocks(part.column(name)):
                        d, g, w, _, _ = bags(b)
                        got.append((d + b.lo, g, w))
                    sides.append([np.concatenate([x[i] for x in got]) for i in range(3)])
                (da, ga, wa), (db, gb, wb) = sides
                d, g, w = np.concatenate([da, db]), np.concatenate([ga, gb]), np.concatenate([wa, wb])
                order = np.lexsort((g, d))
                d, g, w = d[order], g[order], w[order]
                same = np.flatnonzero((d[1:] == d[:-1]) & (g[1:] == g[:-1]))
                low = np.bincount(d[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
                both = np.bincount(d, weights=w, minlength=n)
                near = np.where(both > 0, low / np.maximum(both - low, 1), 1.0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(near)], names=["a", "b", "similarity"])

    return map_arrow(pairs.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint, similarity double")


def _texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text of the paired documents. Ids grow with the corpus, so this is a shuffle, never a broadcast."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids.hint("merge"), "doc_id", "left_semi")
    return cut(texts.dropDuplicates(["doc_id"]), "texts")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact similarities of candidate pairs (a, b), cut from their lineage."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return cut(overlaps(pairs.join(side("b"), "b").join(side("a"), "a")), "pairs")


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of docs with a doc_id, with ``__id``: one number for each doc_id and sequence of words, in doc_id order."""
    schema = docs.select("*", F.lit(0).cast("bigint").alias("__k1"), F.lit(0).cast("bigint").alias("__k2")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[np.empty(0, T.U)], [np.empty(0, T.U)]]
            for b in T.blocks(batch.column("text")):
                t = T.tokens(b)
                h = T.span_hash(b.prefix(), t.starts, t.ends)
                for out, k in zip(keys, word_keys(t, h, b.hi - b.lo), strict=True):
                    out.append(k)
            new = [pa.array(np.concatenate(k).view(np.int64)) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "__k1", "__k2"])

    by = ["doc_id", "__k1", "__k2"]
    keyed = cut(map_arrow(docs.where(F.col("doc_id").isNotNull()), run, schema), "keyed")
    ids = cut(keyed.select(*by).distinct().orderBy(*by).withColumn("__id", F.monotonically_increasing_id()), "numbers")
    return cut(keyed.join(ids.hint("merge"), by).drop("__k1", "__k2"), "numbered")


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The operator. One row a doc_id and sequence of words: doc_id, class_id (the smallest doc_id of its group), rep_id
    (the smallest doc_id with the same words) and spanning_links (of the verified links to different texts that hold the
    group together, those of its rep_id; pairs already in one component are not compared, so this is not the number of all
    its near texts)."""
    with scope() as held:
        signed = cut(sign(docs), "signatures")
        keys = F.struct("k1", "k2")
        ends = signed.groupBy("doc_id").agg(F.min(keys).alias("x"), F.max(keys).alias("y"))
        if not ends.where(F.col("x") != F.col("y")).isEmpty():  # doc_ids don't tell the documents apart
            rows = numbered(docs.select("doc_id", "text"))
            out = groups(rows.select(F.col("__id").alias("doc_id"), "text"), threshold)
            ids = rows.select("__id", F.col("doc_id").alias("__of")).distinct()
            for c in ("doc_id", "class_id", "rep_id"):
                out = out.join(ids.hint("merge"), F.col(c) == F.col("__id")).withColumn(c, F.col("__of")).drop("__id", "__of")
            return held(cut(out, "classes"))
        rep = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep_id"))
        first = signed.join(rep.select(F.col("rep_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        buckets = cut(first.select("doc_id", "total", F.explode("bands").alias("key")), "bands")
        heads = buckets.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
        members = cut(buckets.join(heads, "key"), "members")
        pairs = cut(members.where(F.col("doc_id") != F.col("head")).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), "candidates")
        texts = _texts(pairs, docs)
        checked = _verify(pairs, texts)
        links = checked.where(F.col("similarity") >= threshold).select("a", "b")
        labels = components(links)
        rest = cut(_rest(members, checked, labels, texts, threshold), "rest")
        if not rest.isEmpty():
            more = _verify(rest, texts)
            links = links.union(more.where(F.col("similarity") >= threshold).select("a", "b"))
            labels = components(links)
        degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("spanning_links"))
        labels = labels.join(degree, "id").drop("was")
        out = signed.select("doc_id", "k1", "k2").distinct().join(rep, ["k1", "k2"]).join(labels, F.col("rep_id") == F.col("id"), "left")
        out = out.select("doc_id", F.coalesce("root", "rep_id").alias("class_id"), "rep_id", F.coalesce("spanning_links", F.lit(0)).alias("spanning_links"))
        return held(cut(out, "classes"))


def elements(texts: DataFrame) -> DataFrame:
    """(doc_id, e): the bags of doc_id and text as sets, each copy of a shingle an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for b in T.blocks(batch.column("text")):
                d, g, w, _, _ = bags(b)
                of = np.repeat(np.arange(len(d)), w)
                copy = np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w)
                e = T.mix(g[of] + copy.astype(T.U) * T.U(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(ids[b.lo + d[of]]), pa.array(e.view(np.int64))], names=["doc_id", "e"])

    return map_arrow(texts.select("doc_id", "text"), run, "doc_id bigint, e bigint")


def _rest(members: DataFrame, checked: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs that the comparisons with the buckets' heads leave open: documents of buckets whose members are in
    different components. Two bags of similarity t share an element among the first |u| - ceil(t |u|) + 1 of u and of v
    in any common order; with the rarest elements first few documents do. Pairs of one component are settled, so each
    element pairs the documents outside its most common component with the others."""
    roots = members.where(F.col("members") > 2).join(labels.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
    roots = roots.select("key", "doc_id", "total", F.coalesce("root", "doc_id").alias("root"))
    loose = roots.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where(F.col("x") != F.col("y"))
    loose = cut(roots.join(loose.select("key"), "key", "left_semi").groupBy("doc_id").agg(F.first("total").alias("total"), F.first("root").alias("root")), "loose")
    found = cut(elements(texts.join(loose.select("doc_id").hint("merge"), "doc_id", "left_semi")), "elements")
    held = found.groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    ranked = found.join(held, "e").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "e")))
    ranked = ranked.join(loose, "doc_id")
    head = ranked.where((F.col("df") > 1) & (F.col("r") <= F.col("total") - F.ceil(F.lit(threshold - 1e-9) * F.col("total")) + 1))
    head = cut(head.select("e", "doc_id", "root", "total", "r"), "prefixes")
    common = head.groupBy("e", "root").count().groupBy("e").agg(F.max_by("root", F.struct("count", "root")).alias("common"), F.count(F.lit(1)).alias("n"))
    v = cut(head.join(common.where(F.col("n") > 1).select("e", "common"), "e"), "shared-prefixes")
    u = v.where(F.col("root") != F.col("common"))
    u = u.select("e", *[F.col(c).alias(f"{c}_u") for c in ("doc_id", "root", "total", "r")])
    # the overlap that the pair's sizes ask for, and the elements of each that may then come before the first common one
    need = F.ceil(F.lit((threshold - 1e-9) / (1 + threshold)) * (F.col("total") + F.col("total_u")))
    on = (
        (F.col("root") != F.col("root_u"))
        & ((F.col("root") == F.col("common")) | (F.col("doc_id_u") < F.col("doc_id")))
        & (F.col("r") <= F.col("total") - need + 1)
        & (F.col("r_u") <= F.col("total_u") - need + 1)
    )
    pairs = v.join(u, "e").where(on)
    pairs = pairs.select(F.least("doc_id", "doc_id_u").alias("a"), F.greatest("doc_id", "doc_id_u").alias("b")).distinct()
    return pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")


def op6(docs: DataFrame) -> DataFrame:
    return groups(docs)


@own_names
def keep(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, and all rows without a doc_id, in the columns of docs."""
    some = docs.where(F.col("doc_id").isNotNull())
    repeated = not some.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = numbered(docs) if repeated else some.withColumn("__id", F.col("doc_id"))
    found = groups(rows.select(F.col("__id").alias("doc_id"), "text"))
    chosen = found.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("__id")).hint("merge")
    rows = rows.join(chosen, "__id", "left_semi")
    if repeated:
        rows = rows.dropDuplicates(["__id"])
    return rows.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """Without the number of spanning links, which depends on which pairs were compared."""
    return op6(documents(spark, sf_dir)).drop("spanning_links")
