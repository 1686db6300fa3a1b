"""Tokens and hashes of whole Arrow string columns, in numpy.

Texts of a column lie end to end in one buffer; tokens are maximal runs of bytes of one class that don't cross a text's
border. A run's hash is a polynomial over its bytes modulo 2**64, from one prefix sum over the block, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once, unless one text is longer.
BLOCK = 1 << 20
_powers: list[np.ndarray] = [np.empty(0, U), np.empty(0, U)]

#: The contract's words: everything but space and bytes 9 to 13.
WORD = np.ones(256, np.uint8)
WORD[[32, 9, 10, 11, 12, 13]] = 0


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(max(n, BLOCK + 1), b, U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Block:
    """Texts lo to hi of a column. offs: where each starts in data, and the end."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    def prefix(self) -> np.ndarray:
        out = np.empty(len(self.data) + 1, U)
        out[0] = 0
        np.cumsum((self.data.astype(U) + U(1)) * powers(len(self.data))[0][: len(self.data)], out=out[1:])
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def blocks(column, budget: int = BLOCK, rows: int = 20_000) -> Iterator[Block]:
    """Texts of so many bytes and rows at most, or one longer text. Nulls count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, side="right")) - 1)
        hi = min(hi, n, lo + rows)
        yield Block(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    kind: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)


def tokens(b: Block, table: np.ndarray = WORD) -> Tokens:
    kinds = table[b.data]
    edge = np.empty(len(kinds) + 1, bool)
    edge[1:-1] = kinds[1:] != kinds[:-1]
    edge[b.offs] = True
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    if len(kinds) == 0:
        starts = ends = np.empty(0, np.int64)
    kind = kinds[starts]
    keep = kind != 0
    starts, ends, kind = starts[keep], ends[keep], kind[keep]
    return Tokens(starts, ends, np.searchsorted(b.offs, starts, side="right") - 1, kind)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def grams(h: np.ndarray, doc: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n tokens that lie within one document, and where they start."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    g = np.full(m, salt, U)
    for j in range(n):
        g = g * U(0xD6E8FEB86659FD93) + h[j : j + m]
    return mix(g)[at], at


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of n words; a document of fewer words, but some, has one run of them all."""
    g, at = grams(h, doc, n, salt)
    d = doc[at] if len(at) else np.empty(0, np.int64)
    counts = np.bincount(doc, minlength=n_docs)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        first = np.searchsorted(doc, few)
        short = np.zeros(len(few), U) + U(salt) + U(77)
        for j in range(n - 1):
            has = counts[few] > j
            short[has] = mix(short[has] * U(0xD6E8FEB86659FD93) + h[first[has] + j])
        d, g = np.concatenate([d, few]), np.concatenate([g, short])
        order = np.argsort(d, kind="stable")
        d, g = d[order], g[order]
    return d, g
