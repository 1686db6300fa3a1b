"""Media columns of telephony audio: G.711 mu-law and A-law, and IMA ADPCM, in WAVE containers.

``store`` puts bytes into a container as they are (8-bit codes, or ADPCM blocks of 64 bytes); ``decode`` parses the
container, reads the bytes back, expands G.711 codes by lookup tables or decodes ADPCM with one numpy step a sample for
all blocks at once, and stores 16-bit PCM resampled from 8 to 16 kHz. Everything is done in integers, so equal bytes
give equal media and PCM everywhere.

Null and empty payloads become one block of zero bytes in ``op4``; ``store`` takes payloads of any length but pads
ADPCM's last block. Media that is no such container gives null payload and PCM.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import documents, map_arrow

RATE, OUT_RATE, BLOCK_ALIGN = 8000, 16000, 64
CODECS = ("mulaw", "alaw", "adpcm")
_TAGS = (7, 6, 0x11)
#: Fixed values of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
    230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024,
    3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086,
    29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
BLOCK_SAMPLES = (BLOCK_ALIGN - 4) * 2 + 1


def _laws() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    u = ~code & 255
    mu = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    mu = np.where(u & 128, -mu, mu)
    a = code ^ 0x55
    e, m = (a >> 4) & 7, (a & 15) << 4
    al = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return mu.astype(np.int16), np.where(a & 128, al, -al).astype(np.int16)


MU_LAW, A_LAW = _laws()
#: What one nibble adds and where the step index goes, for each index: the decoder's tables, by its rule.
_NIBBLE = np.arange(16)
_STEP = STEPS[:, None]
_ADD = (_STEP >> 3) + np.where(_NIBBLE & 4, _STEP, 0) + np.where(_NIBBLE & 2, _STEP >> 1, 0) + np.where(_NIBBLE & 1, _STEP >> 2, 0)
DELTA = np.where(_NIBBLE & 8, -_ADD, _ADD).astype(np.int32).ravel()
NEXT = np.clip(np.arange(len(STEPS))[:, None] + MOVES[None, :], 0, len(STEPS) - 1).astype(np.int32).ravel()
#: Half-band interpolation: the sample between two, from eight around it; a windowed sinc in units of 2**-15.
TAPS = np.array([-80, 700, -2900, 18664, 18664, -2900, 700, -80], np.int32)


def container(codec: int, size: int) -> bytes:
    """The WAVE header before ``size`` bytes."""
    adpcm = codec == 2
    extra = struct.pack("<H", BLOCK_SAMPLES) if adpcm else b""
    byte_rate = RATE * BLOCK_ALIGN // BLOCK_SAMPLES if adpcm else RATE
    fmt = struct.pack("<HHIIHHH", _TAGS[codec], 1, RATE, byte_rate, BLOCK_ALIGN if adpcm else 1, 4 if adpcm else 8, len(extra)) + extra
    samples = size // BLOCK_ALIGN * BLOCK_SAMPLES if adpcm else size
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", size)
    return b"RIFF" + struct.pack("<I", len(body) + size) + body


def parse(media: bytes | memoryview) -> tuple[int, int, int] | None:
    """(codec, where the data starts, its size), or None if this is no such container."""
    if len(media) < 12 or bytes(media[:4]) != b"RIFF" or bytes(media[8:12]) != b"WAVE":
        return None
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = bytes(media[at : at + 4]), struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            tag, channels = struct.unpack_from("<HH", media, at + 8)
            codec = _TAGS.index(tag) if tag in _TAGS and channels == 1 else None
        if name == b"data":
            fits = at + 8 + size <= len(media) and not (codec == 2 and size % BLOCK_ALIGN)
            return (codec, at + 8, size) if codec is not None and fits else None
        at += 8 + size + size % 2
    return None


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: (n, 64) bytes. (n, 121) samples; step indexes beyond the table count as its end."""
    n = len(blocks)
    out = np.empty((BLOCK_SAMPLES, n), np.int16)
    value = (blocks[:, 0].astype(np.uint16) | (blocks[:, 1].astype(np.uint16) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(BLOCK_SAMPLES - 1):
        byte = codes[k >> 1]
        place = (index << 4) + ((byte >> 4) if k & 1 else (byte & 15))
        value += DELTA[place]
        np.clip(value, -32768, 32767, out=value)
        index = NEXT[place]
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Twice the rate: pcm holds clips of these lengths end to end; beyond a clip's ends is silence."""
    half = len(TAPS) // 2
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    gap = np.arange(len(lengths), dtype=np.int64) * half + half
    at = np.arange(len(pcm), dtype=np.int64) + np.repeat(gap, lengths)
    room = np.zeros(len(pcm) + half * (len(lengths) + 2), np.int32)
    room[at] = pcm
    mid = np.full(len(room) - 2 * half, 1 << 14, np.int32)
    for j, tap in enumerate(TAPS):
        mid += np.int32(tap) * room[j + 1 : j + 1 + len(mid)]
    mid >>= 15
    np.clip(mid, -32768, 32767, out=mid)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = mid[at - half]
    del starts
    return out


def _binary(parts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offs = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(parts))])


def store(df: DataFrame, payload: str = "text") -> DataFrame:
    """The columns of df with ``n_bytes``, ``codec`` and ``media``. The payload is the column's UTF-8 bytes, with zero
    bytes up to a positive multiple of 64; the codec goes by its checksum."""
    base = df.drop("n_bytes", "codec", "media")
    schema = base.select("*", F.lit(0).cast("bigint").alias("n_bytes"), F.lit("").alias("codec"), F.lit(b"").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.blocks(batch.column(payload)):
                sizes = np.diff(b.offs)
                padded = np.maximum(64, -(-sizes // 64) * 64)
                heads, codecs = [], []
                for i, size in enumerate(padded):
                    c = zlib.crc32(b.data[b.offs[i] : b.offs[i + 1]]) % len(CODECS)
                    codecs.append(c)
                    heads.append(container(c, int(size)))
                total = padded + np.array([len(h) for h in heads])
                room = np.zeros(int(total.sum()), np.uint8)
                at = np.concatenate([[0], np.cumsum(total)[:-1]])
                for i, h in enumerate(heads):
                    a = int(at[i])
                    room[a : a + len(h)] = np.frombuffer(h, np.uint8)
                    room[a + len(h) : a + len(h) + int(sizes[i])] = b.data[b.offs[i] : b.offs[i + 1]]
                part = batch.slice(b.lo, b.hi - b.lo)
                new = [pa.array(sizes), pa.array([CODECS[c] for c in codecs]), _binary(room, total)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return map_arrow(base, run, schema)


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """The columns of df with ``payload`` (the stored bytes), ``pcm`` (16-bit little-endian, 16 kHz) and ``energy``
    (sum of the squared samples at 8 kHz)."""
    base = df.drop("payload", "pcm", "energy")
    schema = base.select("*", F.lit(b"").alias("payload"), F.lit(b"").alias("pcm"), F.lit(0).cast("bigint").alias("energy")).schema

    def part(columns: pa.RecordBatch, b: T.Block) -> pa.RecordBatch:
        n = b.hi - b.lo
        found = [parse(memoryview(b.data[b.offs[i] : b.offs[i + 1]])) for i in range(n)]
        payload, pcm, energy = [None] * n, [None] * n, [None] * n
        for c in range(len(CODECS)):
            some = [i for i in range(n) if found[i] and found[i][0] == c]
            if not some:
                continue
            raw = [b.data[b.offs[i] + found[i][1] :][: found[i][2]] for i in some]
            codes = np.concatenate(raw)
            if c == 2:
                samples = adpcm(codes.reshape(-1, BLOCK_ALIGN)).reshape(-1)
                lengths = np.array([len(r) // BLOCK_ALIGN * BLOCK_SAMPLES for r in raw])
            else:
                samples = (MU_LAW, A_LAW)[c][codes]
                lengths = np.array([len(r) for r in raw])
            ends = np.cumsum(lengths)
            sums = np.concatenate([[0], np.cumsum(samples.astype(np.int64) ** 2)])
            out = resample(samples, lengths)
            for k, i in enumerate(some):
                a, z = int(ends[k] - lengths[k]), int(ends[k])
                payload[i], pcm[i], energy[i] = raw[k].tobytes(), out[2 * a : 2 * z].astype("<i2").tobytes(), int(sums[z] - sums[a])
        new = [pa.array(payload, pa.binary()), pa.array(pcm, pa.binary()), pa.array(energy, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns.columns, *new], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.blocks(batch.column(media).fill_null(b"")):
                yield part(batch.slice(b.lo, b.hi - b.lo), b)

    return map_arrow(base, run, schema)


def op4(docs: DataFrame) -> DataFrame:
    stored = store(docs.select("doc_id", "text")).drop("text")
    read = decode(stored)
    samples = F.octet_length("pcm") / 2
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2(F.col("payload"), 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).cast("bigint").alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.concat_ws(":", "codec", F.lit(OUT_RATE), samples.cast("bigint"), F.crc32("pcm"), "energy").alias("feature"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return op4(documents(spark, sf_dir))
