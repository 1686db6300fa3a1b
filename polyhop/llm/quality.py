"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

Tokens are runs of word bytes (letters, digits, all beyond ASCII) or of punctuation. Features are hashes of words, word
pairs, and n-grams of one to three *shapes*, where a word's shape is one of capitals, number, repeat of the word before,
single letter or plain, and punctuation is its own shape. A feature's value is its count over the number of tokens, so
a score is a sparse dot product: the mean of the tokens' weights, the bias and a logistic.

A null or empty text has no features and scores by the bias for empty texts, 0. The fit takes at most ``rows`` labelled
texts; without labelled rows every text scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import documents, labels, map_arrow, own_names
from ._training import held_out, sample
from .ftrl import fit, sigmoid

DIM = 1 << 18
ROWS = 6000
#: Values are shares of a text's tokens; this brings them to the scale of the learning rate.
SCALE = 10.0
THRESHOLD = 0.7

_TABLE = np.full(256, 2, np.uint8)
_TABLE[[32, 9, 10, 11, 12, 13]] = 0
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TABLE[_lo:_hi] = 1
_CAPITAL, _SMALL, _DIGIT = (np.zeros(256, np.uint8) for _ in range(3))
_CAPITAL[65:91] = _SMALL[97:123] = _DIGIT[48:58] = 1


def features(b: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature place, weight of one occurrence), occurrences not summed."""
    t, n = T.tokens(b, _TABLE), b.hi - b.lo
    if not len(t):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    h = T.span_hash(b.prefix(), t.starts, t.ends)

    def count(table):
        sums = np.concatenate([[0], np.cumsum(table[b.data], dtype=np.int64)])
        return sums[t.ends] - sums[t.starts]

    capital, small, digit, length = count(_CAPITAL), count(_SMALL), count(_DIGIT), t.ends - t.starts
    shape = np.full(len(t), 5, T.U)
    shape[(length == 1)] = 4
    shape[(digit > 0) & (small + capital == 0)] = 2
    shape[(capital > 1) & (small == 0)] = 1
    before = np.flatnonzero(t.kind == 1)
    if len(before) > 1:
        again = (h[before[1:]] == h[before[:-1]]) & (t.doc[before[1:]] == t.doc[before[:-1]])
        shape[before[1:][again]] = 3
    shape = T.mix(np.where(t.kind == 2, h, shape))
    total = np.maximum(t.counts(n), 1)
    docs, places = [], []
    for source, sizes, salt in ((h, (1, 2), 1), (shape, (1, 2, 3), 11)):
        for k in sizes:
            g, at = T.grams(source, t.doc, k, salt + k)
            docs.append(t.doc[at])
            places.append((g & T.U(DIM - 1)).astype(np.int64))
    doc = np.concatenate(docs)
    return doc, np.concatenate(places), SCALE / total[doc]


def _examples(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for b in T.blocks(texts):
        doc, place, value = features(b)
        key, inverse = np.unique(doc * DIM + place, return_inverse=True)
        sums = np.bincount(inverse, weights=value, minlength=len(key))
        cuts = np.searchsorted(key, np.arange(b.hi - b.lo + 1) * DIM)
        out += [(key[a:z] % DIM, sums[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def train(docs: DataFrame, labels_: DataFrame, rows: int = ROWS) -> np.ndarray:
    """DIM weights and the bias."""
    got = sample(docs, labels_, "quality", rows)
    if not len(got):
        return np.zeros(DIM + 1, np.float32)
    y = got["label"].to_numpy().astype(float)
    return fit(_examples(got["text"]), y, DIM, epochs=4, alpha=0.3, l1=0.02, l2=0.01).astype(np.float32)


def scores(column, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(column))
    for b in T.blocks(column):
        doc, place, value = features(b)
        n = b.hi - b.lo
        dot = np.bincount(doc, weights=weights[place] * value, minlength=n) + weights[DIM]
        empty = np.bincount(doc, minlength=n) == 0
        out[b.lo : b.hi] = np.where(empty & (weights[DIM] != 0), 0.0, sigmoid(dot))
    return out


def score(docs: DataFrame, weights: np.ndarray, to: str = "score") -> DataFrame:
    """The operator: all columns of docs and a score of text. weights: DIM + 1 floats, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop(to)
    schema = docs.select("*", F.lit(0.0).alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array(scores(batch.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, to])

    return map_arrow(docs, run, schema)


def op9(docs: DataFrame, labels_: DataFrame) -> DataFrame:
    got = score(docs.select("doc_id", "text"), train(docs, labels_))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@own_names
def keep(docs: DataFrame, labels_: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, in the columns of docs."""
    got = score(docs, train(docs, labels_), "__quality")
    return got.where(F.col("__quality") >= THRESHOLD).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return op9(documents(spark, sf_dir), labels(spark, sf_dir))
