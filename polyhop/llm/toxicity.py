"""Toxicity: a counterfactual-regularised classifier.

Features are the words of a text in lower case (A-Z) and their beginnings of four to eight bytes, hashed; a text has a
feature or not, however often. The logistic model is fitted by sparse updates. For each labelled text counterfactual
forms are made, with its identity terms swapped for others of their kind or, if it names no group, with a term put in, and
the squared difference of the two logits is penalised, so that naming a group neither raises nor lowers a score.

A null or empty text has no features and scores by the bias. The fit takes at most ``rows`` labelled texts; without
labelled rows every text scores 0.5 times the bias' prior, 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import documents, labels, map_arrow
from ._training import held_out, sample
from .ftrl import fit, sigmoid

DIM = 1 << 20
ROWS = 8000
THRESHOLD = 0.3
SWAPS = 2
PENALTY = 2.0
#: Terms that name groups of people, by kind; a term is swapped for others of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "nonbinary"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "citizens", "migrants"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
_TABLE = np.zeros(256, np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TABLE[_lo:_hi] = 1
PREFIXES = (4, 5, 6, 7, 8)
_KIND = {w.encode(): (kind, i) for kind in IDENTITY for i, w in enumerate(kind)}
#: Texts of the sample that must have a feature for it to count.
LEAST_TEXTS = 4


def _hashes(b: T.Block) -> tuple[T.Tokens, list[tuple[np.ndarray, np.ndarray]]]:
    """Tokens, and for words and each length of beginning: (token, feature place)."""
    b = T.Block(b.lo, b.hi, _LOWER[b.data], b.offs)
    t, p = T.tokens(b, _TABLE), b.prefix()
    mask = T.U(DIM - 1)
    out = [(np.arange(len(t)), (T.span_hash(p, t.starts, t.ends) & mask).astype(np.int64))]
    for k in PREFIXES:
        at = np.flatnonzero(t.ends - t.starts > k)
        h = T.mix(T.span_hash(p, t.starts[at], t.starts[at] + k) + T.U(k))
        out.append((at, (h & mask).astype(np.int64)))
    return t, out


def _places(text: bytes) -> np.ndarray:
    """Feature places of one text, ascending."""
    for b in T.blocks(pa.array([text], pa.binary())):
        return np.unique(np.concatenate([f for _, f in _hashes(b)[1]]))
    return np.empty(0, np.int64)


def swaps(text: str, how_many: int = SWAPS) -> list[str]:
    """Counterfactual forms of a text: each identity term replaced by another of its kind, all else as it was; a text that
    names no group gets a term of a group, drawn by its hash, as a word of its own. A text without words has no forms."""
    raw = text.encode()
    for b in T.blocks(pa.array([raw], pa.binary())):
        low = T.Block(b.lo, b.hi, _LOWER[b.data], b.offs)
        t = T.tokens(low, _TABLE)
        spans = list(zip(t.starts.tolist(), t.ends.tolist(), strict=True))
        if not spans:
            return []
        line = low.data.tobytes()
        hits = [(a, z, *_KIND[line[a:z]]) for a, z in spans if line[a:z] in _KIND]
        out = []
        for k in range(1, how_many + 1):
            if not hits:
                draw = zlib.crc32(raw) + k * 7919
                kind = IDENTITY[draw % len(IDENTITY)]
                at = spans[draw // len(IDENTITY) % len(spans)][0]
                out.append(raw[:at] + kind[draw % len(kind)].encode() + b" " + raw[at:])
                continue
            form, done = [], 0
            for a, z, kind, i in hits:
                form += [raw[done:a], kind[(i + k) % len(kind)].encode()]
                done = z
            out.append(b"".join([*form, raw[done:]]))
        return [x.decode() for x in out]
    return []


def difference(text: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that a text or its form alone has, and 1 or -1 for them."""
    gone, new = np.setdiff1d(text, form), np.setdiff1d(form, text)
    return np.concatenate([gone, new]), np.concatenate([np.ones(len(gone)), -np.ones(len(new))])


def train(docs: DataFrame, labels_: DataFrame, rows: int = ROWS, penalty: float = PENALTY) -> np.ndarray:
    """DIM weights and the bias."""
    got = sample(docs, labels_, "toxic", rows)
    if not len(got):
        return np.zeros(DIM + 1, np.float32)
    y = got["label"].to_numpy().astype(float)
    examples, pairs = [], {}
    for b in T.blocks(got["text"]):
        t, parts = _hashes(b)
        key = np.unique(np.concatenate([t.doc[at] * DIM + f for at, f in parts]))
        cuts = np.searchsorted(key, np.arange(b.hi - b.lo + 1) * DIM)
        for i in range(b.hi - b.lo):
            f = key[cuts[i] : cuts[i + 1]] % DIM
            if penalty:
                pairs[len(examples)] = [difference(f, _places(x.encode())) for x in swaps(b.text(i).decode())]
            examples.append((f, np.ones(len(f))))
    seen = np.bincount(np.concatenate([f for f, _ in examples]), minlength=DIM) >= LEAST_TEXTS
    examples = [(f[seen[f]], v[seen[f]]) for f, v in examples]
    return fit(examples, y, DIM, epochs=12, pairs=pairs, penalty=penalty, alpha=1.0, l1=8.0, l2=0.0).astype(np.float32)


def scores(column, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(column))
    for b in T.blocks(column):
        t, parts = _hashes(b)
        keys = []
        for at, f in parts:
            some = np.flatnonzero(weights[f])
            keys.append(t.doc[at[some]] * DIM + f[some])
        key = np.unique(np.concatenate(keys))
        dot = np.bincount(key // DIM, weights=weights[key % DIM], minlength=b.hi - b.lo) + weights[DIM]
        out[b.lo : b.hi] = sigmoid(dot)
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


def op8(docs: DataFrame, labels_: DataFrame) -> DataFrame:
    got = score(docs.select("doc_id", "text"), train(docs, labels_))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return op8(documents(spark, sf_dir), labels(spark, sf_dir))
