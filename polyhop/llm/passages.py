"""Substring dedup: removes passages that an earlier document holds, by sharded automata of recurring phrases.

A window is ``window`` consecutive words. A word goes if a window over it also starts in a document of a smaller doc_id.

1. Anchors. Each window has one: the run of ``anchor`` words in it of the smallest hash. Equal windows have equal
   anchors, and one anchor serves several neighbouring windows, so far fewer anchors than windows are shuffled. Anchors
   of one document alone drop out.
2. Windows and passages. Each shard of documents receives the recurring anchors that occur in it and gives keys of the
   windows around them, and the passages in which those windows stand, as text, in pieces of at most ``PIECE`` windows.
   The first holder of a key is its smallest doc_id. Whole documents are compared in the same way by two keys, so that of
   many copies only the first one gives windows.
3. Automata. A first holder's piece goes to each shard in which a later document has one of its keys. There
   Aho-Corasick automata of a bounded number of bytes are compiled from its phrases: each ``(window + 1) // 2`` words of
   it, one of which every window in it contains. All the shard's documents are streamed through them; around each
   occurrence the document and the passage are compared, and words equal in both go, if they are a window's number at least.

So keys only nominate: what goes is equal text in an earlier document, and two different windows of one key (96 bits)
take no word away. Such a pair could hide a window's true first holder; of 10^12 windows one such pair is expected in
10^5 runs.

Shards are many small sets of documents by hash, bounded in rows and bytes on average, so their number grows with the
corpus and their size doesn't. A single longer document is a shard's whole content. Rows equal in doc_id and text share a
shard.

Null and empty texts have no words. Rows with a null doc_id are neither compared nor changed. Rows of equal doc_id
aren't earlier than one another. Texts with nothing to remove stay as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import cut, documents, map_arrow, own_names, release, ship
from .neardup import word_keys

WINDOW = 13
ANCHOR = 6
#: Windows of a piece of a passage.
PIECE = 64
#: Documents and bytes that a shard should hold, and bytes of phrases in one automaton.
SHARD_ROWS = 256
SHARD_BYTES = 1 << 20
AUTOMATON_BYTES = 1 << 17


def _anchors(h: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies in one document: where it starts, and the hash of its anchor."""
    m = len(h) - window + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, T.U)
    g = np.zeros(len(h) - anchor + 1, T.U)
    for j in range(anchor):
        g = g * T.U(0xD6E8FEB86659FD93) + h[j : j + len(g)]
    g = T.mix(g)
    low = g[:m].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(low, g[j : j + m], out=low)
    at = np.flatnonzero(doc[:m] == doc[window - 1 :])
    return at, low[at]


def _windows(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the windows that start at these words."""
    a, b = np.zeros(len(at), T.U), np.full(len(at), 17, T.U)
    for j in range(window):
        x = h[at + j]
        a = a * T.U(0x9FB21C651E98DF25) + x
        b = b * T.U(0xC2B2AE3D27D4EB4F) + (x ^ (x >> T.U(29)))
    return T.mix(a), (T.mix(b) >> T.U(32)).astype(np.uint32)


def _whole(t: T.Tokens, h: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two keys of each document's whole sequence of words, and whether it has a window's words."""
    k1, k2 = word_keys(t, h, n)
    return T.mix(k1 ^ T.U(0xA5A5A5A5)), T.mix(k2 ^ T.U(0x5A5A5A5A)), t.counts(n) >= window


def _copies(k1, k2, long, ids: np.ndarray, known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which documents' whole sequence recurs, and which of them an earlier document holds."""
    recurs = long & _in(k1, known) & _in(k2, known)
    if not len(known):
        return recurs, recurs
    at = lambda k: first[np.minimum(np.searchsorted(known, k), len(known) - 1)]
    return recurs, recurs & (at(k1) == at(k2)) & (at(k1) < ids)


def _distinct(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the first of each (doc, key)."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return order[new]


def anchors(sharded: DataFrame, shard: str, window: int, anchor: int) -> DataFrame:
    """(m, shard, doc_id): the anchors of each document and its two keys, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, ids = batch.column(shard).to_numpy(), batch.column("doc_id").to_numpy()
            for b in T.blocks(batch.column("text")):
                t = T.tokens(b)
                h = T.span_hash(b.prefix(), t.starts, t.ends)
                at, m = _anchors(h, t.doc, window, anchor)
                d = t.doc[at]
                turn = np.ones(len(m), bool)
                turn[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
                d, m = d[turn], m[turn]
                some = _distinct(d, m)
                k1, k2, long = _whole(t, h, b.hi - b.lo, window)
                m = np.concatenate([m[some], k1[long], k2[long]])
                rows = b.lo + np.concatenate([d[some], np.flatnonzero(long), np.flatnonzero(long)])
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(shards[rows]), pa.array(ids[rows])], names=["m", "shard", "doc_id"])

    return map_arrow(sharded.select(shard, "doc_id", "text"), run, "m bigint, shard int, doc_id bigint")


def _in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _pieces(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of these windows, in order, begin a piece: runs of neighbours in one document, cut after PIECE windows."""
    if not len(at):
        return np.zeros(0, bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % PIECE == 0


def raw(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def line_of(text: bytes) -> bytes:
    """A text's words, joined, begun and ended by single spaces."""
    return b" " + b" ".join(text.split()) + b" "


WINDOW_ROW = "wh bigint, wx int, shard int, doc_id bigint, pid bigint, passage string"


def windows(sharded: DataFrame, shard: str, recurring: DataFrame, window: int, anchor: int, mask: int) -> DataFrame:
    """Two kinds of rows. (wh, wx, shard, doc_id, pid): the keys of the windows around recurring anchors, once a document,
    and the piece that holds the window; also a key for each piece of a document whose whole sequence recurs. Of such
    copies only the first gives windows: all of the others' are in it. (pid, doc_id, passage): the pieces."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, order = np.unique(right.column("m").to_numpy().view(T.U), return_index=True)
        first = right.column("a").to_numpy()[order]
        ids = left.column("doc_id").to_numpy()
        keys, texts = [], []  # (wh, wx, doc_id, pid), (pid, doc_id, passage)
        for b in T.blocks(left.column("text")) if len(known) and len(ids) else ():
            mine = ids[b.lo : b.hi]
            t = T.tokens(b)
            h = T.span_hash(b.prefix(), t.starts, t.ends)
            at, m = _anchors(h, t.doc, window, anchor)
            k1, k2, long = _whole(t, h, b.hi - b.lo, window)
            recurs, copy = _copies(k1, k2, long, mine, known, first)
            at = at[_in(m, known) & ~copy[t.doc[at]]]
            wh, wx = _windows(h, at, window)
            some = np.sort(_distinct(t.doc[at], wh))
            at, wh, wx = at[some], wh[some], wx[some]
            d = t.doc[at]
            begins = _pieces(at, d)
            of = np.cumsum(begins) - 1
            starts, ends = at[begins], at[np.append(np.flatnonzero(begins)[1:] - 1, len(at) - 1)] + window if len(at) else at
            doc = t.doc[starts]
            # whole documents: a key and, for the first one, a piece for each PIECE of its windows
            counts = t.counts(b.hi - b.lo)
            whole = np.flatnonzero(recurs)
            parts = -(-(counts[whole] - window + 1) // PIECE)
            w = np.repeat(whole, parts)
            j = np.arange(len(w)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = (np.cumsum(counts) - counts)[w] + j * PIECE
            end = np.minimum(begin + PIECE + window - 1, np.cumsum(counts)[w])
            own = ~copy[w]
            pid = T.mix(mine[doc].astype(T.U) + T.mix(t.starts[starts].astype(T.U) - b.offs[doc].astype(T.U)))
            whole_pid = T.mix(T.mix(mine[w].astype(T.U) + T.mix(j.astype(T.U))))
            keys.append((wh, wx.view(np.int32), mine[d], pid[of]))
            keys.append((T.mix(k1[w] + j.astype(T.U)), k2[w].astype(np.uint32).view(np.int32), mine[w], whole_pid))
            for p, a, z, k in ((pid, starts, ends, doc), (whole_pid[own], begin[own], end[own], w[own])):
                spans = zip(t.starts[a].tolist(), t.ends[z - 1].tolist(), strict=True)
                texts.append((p, mine[k], [line_of(b.data[x:y].tobytes()) for x, y in spans]))
        cols = [np.concatenate([k[i] for k in keys]) if keys else np.empty(0, kind) for i, kind in enumerate((T.U, np.int32, np.int64, T.U))]
        cols[0] &= T.U(mask)
        n = len(cols[0])
        pid, doc = (np.concatenate([x[i] for x in texts]) if texts else np.empty(0, kind) for i, kind in enumerate((T.U, np.int64)))
        void = lambda kind, k: pa.nulls(k, kind)
        passage = pa.array([x for _, _, some in texts for x in some], pa.binary()).cast(pa.string())
        number = left.column(shard)[0].as_py() if len(ids) else 0
        join = lambda x, y: pa.concat_arrays([x, y])
        return pa.table({
            "wh": join(pa.array(cols[0].view(np.int64)), void(pa.int64(), len(pid))),
            "wx": join(pa.array(cols[1]), void(pa.int32(), len(pid))),
            "shard": pa.array(np.full(n + len(pid), number, np.int32)),
            "doc_id": np.concatenate([cols[2], doc]),
            "pid": np.concatenate([cols[3], pid]).view(np.int64),
            "passage": join(void(pa.string(), n), passage),
        })

    left = sharded.select(shard, "doc_id", "text").groupBy(shard)
    return left.cogroup(recurring.groupBy("shard")).applyInArrow(run, WINDOW_ROW)


def phrases(passage: bytes, words: int) -> Iterator[tuple[bytes, int]]:
    """A line's words, so many at a time, with the spaces around them, and where each such phrase stands."""
    spaces = np.flatnonzero(np.frombuffer(passage, np.uint8) == 32).tolist()
    for k in range(0, len(spaces) - words, words):
        yield passage[spaces[k] : spaces[k + words] + 1], spaces[k]


def automata(passages: list[bytes], words: int, limit: int = AUTOMATON_BYTES) -> Iterator[ahocorasick.Automaton]:
    """One after another, automata of at most ``limit`` bytes of phrases each, or of one longer phrase. A byte counts as a
    character. A phrase's value is its size and where it stands: (number of the passage, place in it)."""
    where: dict[bytes, list[tuple[int, int]]] = {}
    for i, p in enumerate(passages):
        for phrase, at in phrases(p, words):
            where.setdefault(phrase, []).append((i, at))
    now, size = ahocorasick.Automaton(), 0
    for p in sorted(where):
        if size and size + len(p) > limit:
            now.make_automaton()
            yield now
            now, size = ahocorasick.Automaton(), 0
        now.add_word(p.decode("latin-1"), (len(p), where[p]))
        size += len(p)
    if size:
        now.make_automaton()
        yield now


def common(a: bytes, b: bytes, least: int) -> int:
    """The length of the longest common beginning; so many bytes are known to be equal."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    while most - least > 1:
        middle = (least + most) // 2
        if a[least:middle] == b[least:middle]:
            least = middle
        else:
            most = middle
    return least


def around(line: bytes, p: int, passage: bytes, o: int, size: int) -> tuple[int, int]:
    """The longest stretch of whole words, with the spaces around it, that is equal in both and contains the ``size``
    bytes that stand at p of the line and at o of the passage: where it begins and ends in the line."""
    right = common(line[p : p + len(passage) - o], passage[o:], size)
    left = common(line[max(0, p - o) : p + 1][::-1], passage[max(0, o - p) : o + 1][::-1], 1)
    return line.find(b" ", p + 1 - left), line.rfind(b" ", 0, p + right) + 1


def located(line: bytes, doc_id: int, a: ahocorasick.Automaton, passages: list[bytes], holders: list[int], window: int) -> list[tuple[int, int]]:
    """Stretches of a line, of a window's number of words at least, that also stand in a passage of an earlier document."""
    out, done = [], {}
    for end, (size, where) in a.iter(line.decode("latin-1")):
        p = end - size + 1
        for i, o in where:
            if holders[i] < doc_id and done.get((i, p - o), 0) <= p:
                begin, stop = around(line, p, passages[i], o, size)
                done[i, p - o] = stop - 1
                if line.count(b" ", begin, stop) > window:
                    out.append((begin, stop))
    return out


def strip_shard(lines: list[bytes], ids: list[int], passages: list[bytes], holders: list[int], window: int, limit: int = AUTOMATON_BYTES) -> list:
    """For each line None, or which of its words stay."""
    depth: dict[int, np.ndarray] = {}
    spaces: dict[int, np.ndarray] = {}
    for a in automata(passages, (window + 1) // 2, limit):
        for k, (line, doc_id) in enumerate(zip(lines, ids, strict=True)):
            if spans := located(line, doc_id, a, passages, holders, window):
                if k not in depth:
                    spaces[k] = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                    depth[k] = np.zeros(len(spaces[k]), np.int64)
                begin, stop = np.array(spans).T
                np.add.at(depth[k], np.searchsorted(spaces[k], begin), 1)
                np.add.at(depth[k], np.searchsorted(spaces[k], stop - 1), -1)
    return [np.cumsum(depth[k])[:-1] == 0 if k in depth else None for k in range(len(lines))]


def digest(table: pa.Table, names: list[str], keep: list | None = None) -> pa.Table:
    """The columns of a table with the words left in ``text``, and what the operator adds."""
    new, count, gone, sha = [], [], [], []
    for i, text in enumerate(table.column("text")):
        whole = raw(text)
        words = whole.split()
        left = words if keep is None or keep[i] is None else list(compress(words, keep[i].tolist()))
        count.append(len(words))
        gone.append(len(words) - len(left))
        line = b" ".join(left)
        sha.append(hashlib.sha256(line).hexdigest())
        new.append((line if gone[-1] else whole) if text.is_valid else None)
    cols = {c: table.column(c) for c in names} | {"text": pa.array(new, pa.binary()).cast(pa.string())}
    return pa.table(cols | {"n_words": pa.array(count, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


@own_names
def strip(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_rows: int = SHARD_ROWS, mask: int = 2**64 - 1) -> DataFrame:
    """The operator: the columns of docs, with ``text`` less the words removed (those left joined by single spaces) where
    there are any, and ``n_words``, ``n_removed`` and ``kept_sha256`` of the words left, joined by single spaces.
    mask: the bits of a window's first key that count."""
    ship(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    rows, size = docs.agg(F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, math.ceil(rows / shard_rows), math.ceil(size / SHARD_BYTES))
    shard = "__shard"
    named = docs.where(F.col("doc_id").isNotNull())
    sharded = named.withColumn(shard, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    found = anchors(sharded, shard, window, anchor)
    ends = found.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    recurring = cut(ends.where(F.col("a") < F.col("z")).select("m", "a"), "anchors")
    # no aggregate on top of the joins, so that the rows of one anchor, window or piece can be split among tasks
    in_shard = found.join(recurring, "m").select("shard", "m", "a")
    held = cut(windows(sharded, shard, in_shard, window, anchor, mask), "windows")
    keys, pieces = held.where(F.col("wh").isNotNull()), held.where(F.col("wh").isNull())
    ends = keys.groupBy("wh", "wx").agg(F.min("doc_id").alias("first"), F.min_by("pid", "doc_id").alias("from"), F.max("doc_id").alias("last"))
    firsts = cut(ends.where(F.col("first") < F.col("last")).select("wh", "wx", "first", "from"), "first-holders")
    due = keys.join(firsts, ["wh", "wx"]).where(F.col("first") < F.col("doc_id")).select(F.col("from").alias("pid"), "shard").distinct()
    sent = due.join(pieces.select("pid", F.col("doc_id").alias("holder"), "passage"), "pid")
    sent = cut(sent.select("shard", "holder", "passage"), "passages")
    release(recurring, held, firsts)
    schema = docs.select(
        *docs.columns,
        F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.lit("").alias("kept_sha256"),
    ).schema
    names = docs.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = None
        if left.num_rows and right.num_rows:
            lines = [line_of(raw(x)) for x in left.column("text")]
            passages = [raw(x) for x in right.column("passage")]
            keep = strip_shard(lines, left.column("doc_id").to_pylist(), passages, right.column("holder").to_pylist(), window)
        return digest(left, names, keep)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from digest(pa.table(batch), names).to_batches()

    out = sharded.groupBy(shard).cogroup(sent.groupBy("shard")).applyInArrow(run, schema)
    return out.unionByName(map_arrow(docs.where(F.col("doc_id").isNull()), plain, schema))


def op2(docs: DataFrame) -> DataFrame:
    return strip(docs.select("doc_id", "text")).drop("text")


@own_names
def cleaned(docs: DataFrame) -> DataFrame:
    """docs with recurring passages removed and n_chars, if there is such a column, counted anew."""
    added = ("n_words", "n_removed", "kept_sha256")
    aside = {c: f"__{c}" for c in docs.columns if c in added}  # the caller's columns of these names stay
    out = strip(docs.withColumnsRenamed(aside)).drop(*added).withColumnsRenamed({v: c for c, v in aside.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return op2(documents(spark, sf_dir))
