"""Media columns: texts as greyscale PNG in a binary column, and cosine-transform hashes of them.

PNG is written and read here: zlib-compressed IDAT chunks, a CRC test on every chunk, the Adler test of the
zlib stream, and unfiltering in numpy for all five filter types.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import text_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER, HEADER_SIZE = ">IIBBBBB", 13
#: Samples of the largest image that is decoded.
MAX_SAMPLES = 1 << 31
WIDTH = 64
CHUNK = 1 << 16
SIDE, LOW = 32, 8
#: Cosine basis in whole numbers: every product and sum stays under 2**53, so the hash does not depend on the order of summation.
BASIS = np.rint(4096 * np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE)))


class MediaError(ValueError):
    """The stored bytes are not a PNG of the supported kind, or a checksum does not hold."""


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with zeros appended up to a positive multiple of the row width."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """One sample a byte. Each row takes, of the filters none, left and up, the one with the least sum of absolute residues."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    choices = np.stack([rows, left, up])
    residue = np.abs(choices.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    pick = residue.argmin(axis=0)
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = pick
    out[:, 1:] = choices[pick, np.arange(len(rows))]
    packed = zlib.compress(out.tobytes(), level)
    header = struct.pack(HEADER, width, len(rows), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", header) + data + _chunk(b"IEND", b"")


def _unfilter_simple(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Filters none, left and up: running sums modulo 256 along a row, then down each run of 'up' rows."""
    done = rows.copy()
    if (is_left := kinds == 1).any():
        done[is_left] = np.cumsum(done[is_left], axis=1, dtype=np.uint8)
    if not (kinds == 2).any():
        return done
    down = np.cumsum(np.vstack([above[None], done]), axis=0, dtype=np.uint8)
    start = np.maximum.accumulate(np.where(kinds != 2, np.arange(1, len(rows) + 1), 0))
    before = np.where(start[:, None] > 0, down[np.maximum(start - 1, 0)], 0).astype(np.uint8)
    return down[1:] - before


def _unfilter_wave(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Any filter: samples on one anti-diagonal depend on earlier diagonals only, so each diagonal is one array step."""
    high, wide = rows.shape
    grid = np.zeros((high + 1, wide + 1), np.int32)
    grid[0, 1:] = above
    for d in range(high + wide - 1):
        y = np.arange(max(0, d - wide + 1), min(high, d + 1))
        x = d - y
        a, b, c, kind = grid[y + 1, x], grid[y, x + 1], grid[y, x], kinds[y]
        guess = a + b - c
        pa, pb, pc = np.abs(guess - a), np.abs(guess - b), np.abs(guess - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        grid[y + 1, x + 1] = (rows[y, x] + np.choose(kind, [0 * a, a, b, (a + b) >> 1, paeth])) & 255
    return grid[1:, 1:].astype(np.uint8)


def unfilter(filtered: np.ndarray) -> np.ndarray:
    """Samples of rows that each begin with their filter's number."""
    kinds, rows = filtered[:, 0], filtered[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise MediaError("unknown filter")
    hard = kinds > 2
    if not hard.any():
        return _unfilter_simple(kinds, rows, np.zeros(rows.shape[1], np.uint8))
    out = np.empty_like(rows)
    cuts = [0, *(np.flatnonzero(np.diff(hard)) + 1).tolist(), len(rows)]
    for lo, hi in zip(cuts, cuts[1:]):
        above = out[lo - 1] if lo else np.zeros(rows.shape[1], np.uint8)
        out[lo:hi] = (_unfilter_wave if hard[lo] else _unfilter_simple)(kinds[lo:hi], rows[lo:hi], above)
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples as (height, width). Raises MediaError where a checksum or the layout does not hold."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data):
            raise MediaError("cut off")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if len(body) != HEADER_SIZE:
                raise MediaError("header of the wrong length")
            header = struct.unpack(HEADER, body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a whole 8-bit greyscale image")
    wide, high = header[:2]
    if not 0 < wide * high <= MAX_SAMPLES:
        raise MediaError("no samples, or too many")
    stream = zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(packed), high * (wide + 1) + 1)  # a small file can hold any number of zeros
        if not stream.eof:
            raw += stream.decompress(stream.unconsumed_tail, 1)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != high * (wide + 1) or not stream.eof:
        raise MediaError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(high, wide + 1))


def _shrink(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    if n < SIDE:
        return np.take(image, np.arange(SIDE) * n // SIDE, axis=axis).astype(np.int64) * 16
    edges = np.arange(SIDE + 1) * n // SIDE
    sums = np.add.reduceat(image, edges[:-1], axis=axis, dtype=np.int64)
    counts = np.diff(edges)
    return sums * 16 // (counts[:, None] if axis == 0 else counts)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 shrunk image exceed their median (the constant term apart)."""
    small = _shrink(_shrink(image, 0), 1) // 16
    low = (BASIS @ small.astype(np.float64) @ BASIS.T).ravel()
    return np.packbits(low > np.sort(low[1:])[31]).tobytes()


@F.pandas_udf(T.BinaryType())
def png_of_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: encode_png(payload_of(t)))


FEATURES = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "hash": T.BinaryType(), "error": T.StringType()}


@F.pandas_udf(T.StructType([T.StructField(k, v) for k, v in FEATURES.items()]))
def png_features(media: pd.Series) -> pd.DataFrame:
    """Digests of what is read back from stored PNG bytes; null for null media, and for damaged ones, whose ``error`` says why."""
    rows = []
    for data in media:
        if data is None:
            rows.append((None,) * 7)
            continue
        try:
            image = decode_png(data := bytes(data))
        except MediaError as e:
            rows.append((None,) * 6 + (str(e),))
            continue
        back = image.tobytes()
        rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image), None))
    return pd.DataFrame(rows, columns=list(FEATURES))


def with_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with a binary PNG column. Null texts are empty ones, which give one row of zero samples.

    Other columns stay; if there is one named ``out`` already, that is an error.
    """
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {out} already")
    return df.withColumn(out, png_of_text(text_of(text)))


def media_columns(media: str | Column = "media") -> Column:
    """A struct of features read from a PNG column (see png_features)."""
    return png_features(media)


def media_digests(documents: DataFrame) -> DataFrame:
    """One row per document, repeated rows included; null texts count as empty, equal texts give equal values."""
    stored = with_media(documents.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "text")).drop("text")
    read = stored.select("doc_id", "n_bytes", media_columns().alias("m"))
    return read.select("doc_id", "n_bytes", *(f"m.{c}" for c in FEATURES if c not in ("hash", "error")), F.lower(F.hex("m.hash")).alias("feature"))
