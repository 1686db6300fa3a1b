"""Best-fit packing: a configuration linear program over the length histogram.

Texts are tokenised and end in a separator id; longer ones than a sequence are cut so that only the first piece may be
shorter. What remains is a histogram of at most ``capacity`` lengths, whatever the corpus: the driver covers it with
configurations (multisets of lengths that fit one sequence), found by a knapsack dynamic program that prices lengths by
multiplicative weights, and rounds their fractional amounts to whole sequences, in passes. What rounding leaves is packed
by best fit into the gaps and new sequences, in counts. Pieces then take the slots of their length in an order of theirs.
The work on the driver depends on the capacity alone.

Null and empty texts are one piece of the separator alone. Rows with equal or null ids are documents of their own.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut, documents, map_arrow

CAPACITY = 1024
SEPARATOR = 2
#: Rounds of the weights' updates, configurations priced in each, and the size of their perturbation.
ROUNDS, BATCH, NOISE = 40, 24, 0.002
#: How much more a long length is worth at the start than its share of a sequence: short ones are the easier to place late.
LONG = 0.1
#: Rates of the weights; each is tried.
RATES = (0.1, 1.0)
#: Of each pass of rounding: the share of the program that is rounded, and the gap that a sequence may have beyond the mean.
SHARES, SLACK = (0.3, 0.6, 0.8, 0.8, 0.8), (0.0, 0.0, 0.0, 0.0, 0.01)
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids, equal to the tokenizers library's on the same file. The byte-level merges of the
    file are run by tiktoken, five times as fast; texts with a special token's string go through tokenizers."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    # byte-level vocabularies write bytes as printable characters: those that print stand for themselves
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """A row for each piece of each text; with ``ids`` also its token ids."""
    path = path or vocabulary()
    schema = PIECE + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                part = batch.slice(lo, 256)
                for doc, text in zip(part.column("doc_id"), part.column("text"), strict=True):
                    got = np.array([*encode(text.as_py() or ""), SEPARATOR], "<u4")
                    first = (len(got) - 1) % capacity + 1
                    edges = [0, *range(first, len(got) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        rows.append((doc.as_py(), k, a, z - a, zlib.crc32(got[a:z].tobytes()), got[a:z].tolist() if ids else None))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if ids else 5]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def price(values: np.ndarray, capacity: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The knapsack's dynamic program, for several rows of values at once: for each row the lengths (longest first) of
    the most valuable multiset of total length at most capacity, and its value. values[k, s] <= 0 leaves s out."""
    n, at = len(values), np.arange(len(values))
    low = int(np.flatnonzero((values > 0).any(axis=0))[0])
    worth = np.where(values > 0, values, -np.inf)
    best, pick = np.zeros((n, capacity + 1)), np.zeros((n, capacity + 1), np.int32)
    back = np.zeros((n, capacity + 1))  # best, from the right
    for c in range(low, capacity + 1):
        with_last = worth[:, low : c + 1] + back[:, capacity - c + low :]
        k = with_last.argmax(axis=1)
        top = with_last[at, k]
        better = top > best[:, c - 1]
        best[:, c] = np.where(better, top, best[:, c - 1])
        pick[:, c] = np.where(better, k + low, 0)
        back[:, capacity - c] = best[:, c]
    out = []
    for row in pick:
        chosen, c = [], capacity
        while c > 0:
            s = int(row[c])
            chosen += [s] if s else []
            c -= s or 1
        out.append(tuple(sorted(chosen, reverse=True)))
    return out, best[:, capacity]


def relax(counts: np.ndarray, capacity: int, rate: float, rounds: int = ROUNDS, batch: int = BATCH, noise: float = NOISE, seed: int = 0) -> tuple[dict[tuple[int, ...], float], float]:
    """The covering program: the least sum of amounts of configurations that hold counts[s] pieces of each length s.

    A length's weight is multiplied by exp(rate * shortfall) as its coverage falls behind the share of rounds gone; the
    weights price the knapsack, and the best configurations under them, and under slightly perturbed ones, get the round's
    amount. Returns the amounts and a lower bound: any weights, over the value of the best configuration, are a solution
    of the dual program, and the best bound of all rounds counts."""
    rng = np.random.default_rng(seed)
    size = np.arange(capacity + 1) / capacity
    prior = np.where(counts > 0, size * (1 + LONG * size), 0.0)
    short, covered = np.zeros(capacity + 1), np.zeros(capacity + 1)
    amounts: dict[tuple[int, ...], float] = {}
    bound = float(counts @ size)
    for t in range(1, rounds + 1):
        weight = prior * np.exp(rate * short)
        tries = np.repeat(weight[None, :], batch, axis=0)
        tries[1:] *= np.exp(noise * rng.standard_normal((batch - 1, capacity + 1)))
        chosen, value = price(tries, capacity)
        bound = max(bound, float(counts @ weight / value[0]))
        each = bound / rounds / batch
        for lengths in chosen:
            amounts[lengths] = amounts.get(lengths, 0.0) + each
            np.add.at(covered, list(lengths), each)
        short = np.where(counts > 0, t / rounds - covered / np.maximum(counts, 1), 0.0)
    return amounts, bound


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], float, int]:
    """([(lengths in one sequence, how many such sequences)] that hold counts[s] pieces of each length s exactly, a lower
    bound on the number of sequences, passes of rounding).

    Amounts are rounded to whole sequences in passes, configurations of the least gap first, a share of the program in
    each; the program is then solved for what is left. After each pass best fit packs the rest, and the pass after which
    the fewest sequences are needed is the one that counts; pass 0 is best fit alone."""
    start = np.zeros(capacity + 1, np.int64)
    start[: len(counts)] = counts
    full, start[0] = int(start[capacity]), 0
    start[capacity] = 0
    first = [([capacity], full)] if full else []
    found, bound = [(_best_fit(list(first), start.copy(), capacity), 0)], 0.0
    for rate in RATES:
        out, rest = list(first), start.copy()
        for k, share in enumerate(SHARES):
            if not rest.any():
                break
            amounts, least = relax(rest, capacity, rate, seed=k)
            bound = max(bound, least) if k == 0 else bound
            # whole sequences, the least gap first; none of a larger gap than the program's own mean one and a bit
            gap = capacity * (1 - rest @ np.arange(capacity + 1) / capacity / least) * 1.5 + SLACK[k] * capacity
            left = share * least
            for lengths, amount in sorted(amounts.items(), key=lambda x: (capacity - sum(x[0]), -x[1], x[0])):
                if left <= 0 or capacity - sum(lengths) > gap:
                    break
                s, many = np.unique(lengths, return_counts=True)
                n = int(min(max(np.floor(amount), 1), (rest[s] // many).min(), np.ceil(left)))
                if n:
                    out.append((list(lengths), n))
                    rest[s] -= n * many
                    left -= n
            found.append((_best_fit(list(out), rest.copy(), capacity), k + 1))
    configs, passes = min(found, key=lambda x: (sum(n for _, n in x[0]), -x[1]))
    return configs, full + bound, passes


def configurations(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    return solve(counts, capacity)[0]


def _best_fit(out: list[tuple[list[int], int]], rest: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Packs the rest into the gaps of out and into new sequences, longest first, each length in counts."""
    groups = {i: [list(c), n] for i, (c, n) in enumerate(out)}
    gaps = sorted((capacity - sum(c), i) for i, (c, _) in groups.items() if sum(c) < capacity)
    for s in range(capacity, 0, -1):
        left = int(rest[s])
        while left:
            k = bisect_left(gaps, (s, -1))
            if k < len(gaps):
                gap, i = gaps.pop(k)
                c, n = groups[i]
            else:
                gap, i, c, n = capacity, len(groups), [], left
                groups[i] = [c, n]
            per = min(gap // s, left)
            take = min(n, left // per)
            if take < n:  # the others keep the gap they have
                j = len(groups)
                groups[j] = [list(c), n - take]
                if c:
                    insort(gaps, (gap, j))
                else:
                    groups[j][1] = 0
            groups[i] = [c + [s] * per, take]
            left -= per * take
            if gap - per * s:
                insort(gaps, (gap - per * s, i))
    return [(c, n) for c, n in groups.values() if n and c]


def slots(configs: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Runs of slots, sorted by (length, first rank): length, first rank, first sequence, offset."""
    rows, used, base = [], {}, 0
    for lengths, n in configs:
        at = 0
        for s in lengths:
            rows.append((s, used.get(s, 0), base, at))
            used[s] = used.get(s, 0) + n
            at += s
        base += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts: rows with doc_id, piece and length <= capacity, cut from their lineage. Adds sequence_id and offset."""
    spark = parts.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    length, rank, sequence, offset = slots(configurations(counts, capacity))
    shift = np.int64(1 << 44)
    shared = spark.sparkContext.broadcast((length * shift + rank, rank, sequence, offset))
    slices = max(1, math.isqrt(int(counts.max())))  # as many as pieces of the commonest length in one of them
    rows = parts.withColumn("__s", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(slices)).cast("int"))
    sums = rows.groupBy("length", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("length", "__s").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("__k", F.row_number().over(within) - 1).join(sums, ["length", "__s"])
    rows = rows.select(*parts.columns, (F.col("__before") + F.col("__k")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, seq, off = shared.value
        for batch in batches:
            r = batch.column("sequence_id").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() * shift + r, side="right") - 1
            new = [pa.array(seq[at] + r - first[at]), pa.array(off[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=batch.schema.names)

    return map_arrow(rows, run, rows.schema)


def op5(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(cut(pieces(docs, path), "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return op5(documents(spark, sf_dir))
