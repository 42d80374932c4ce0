"""Compression of binary columns: formats that pyarrow and zlib write, and transforms and coders of our own."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats by name; those of pyarrow need the plain size, which is put before the data as eight bytes.
ARROW = {"lz4": "lz4_raw", "snappy": "snappy", "zstd": "zstd", "brotli": "brotli", "gzip": "gzip"}
LITERALS, SHORTEST, LONGEST, REACH = 8, 3, 18, 4096


def _arrow_pack(data: bytes, codec: str) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, ARROW[codec], asbytes=True) if data else b"")


def _arrow_unpack(data: bytes, codec: str) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, ARROW[codec], asbytes=True) if size else b""


def burrows_wheeler(data: bytes) -> bytes:
    """Last column of all sorted rotations of the data with an end mark, which sorts first; its row goes before it as four bytes."""
    n = len(data) + 1
    rank = np.r_[np.frombuffer(data, np.uint8).astype(np.int64) + 1, 0]
    width = 1
    while True:  # prefix doubling: ranks of twice as many letters from pairs of ranks
        order = np.lexsort((np.roll(rank, -width), rank))
        pairs = np.stack([rank, np.roll(rank, -width)], axis=1)[order]
        fresh = np.cumsum(np.r_[0, (pairs[1:] != pairs[:-1]).any(axis=1)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= 2 * n:
            break
    place = int(np.flatnonzero(order == 0)[0])
    last = np.delete(order, place) - 1
    return place.to_bytes(4, "little") + np.frombuffer(data, np.uint8)[last].tobytes()


def inverse_burrows_wheeler(data: bytes) -> bytes:
    place, letters = int.from_bytes(data[:4], "little"), np.frombuffer(data[4:], np.uint8).astype(np.int64) + 1
    column = np.insert(letters, place, 0)
    following = np.argsort(column, kind="stable")
    out, at = np.empty(len(letters), np.uint8), place
    for k in range(len(letters)):
        at = following[at]
        out[k] = column[at] - 1
    return out.tobytes()


def move_to_front(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for b in data:
        k = table.index(b)
        out.append(k)
        table.insert(0, table.pop(k))
    return bytes(out)


def inverse_move_to_front(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for k in data:
        out.append(table[k])
        table.insert(0, table.pop(k))
    return bytes(out)


def lzss_pack(data: bytes) -> bytes:
    """Groups of eight items after a byte of flags: a literal, or two bytes with distance (12 bits) and length less 3 (4 bits)."""
    out, flags, items, at = bytearray(), 0, bytearray(), 0
    count, latest = 0, {}
    while at < len(data):
        best, start = 0, 0
        for place in reversed(latest.get(data[at : at + SHORTEST], ())[-32:]):
            if at - place > REACH:
                break
            size = SHORTEST
            while size < LONGEST and at + size < len(data) and data[place + size] == data[at + size]:
                size += 1
            if size > best:
                best, start = size, place
        step = max(best, 1)
        if best:
            pair = (at - start - 1) << 4 | (best - SHORTEST)
            items += pair.to_bytes(2, "big")
        else:
            flags |= 1 << count
            items.append(data[at])
        for k in range(at, min(at + step, len(data) - SHORTEST + 1)):
            latest.setdefault(data[k : k + SHORTEST], []).append(k)
        at, count = at + step, count + 1
        if count == LITERALS:
            out += bytes([flags]) + items
            flags, count, items = 0, 0, bytearray()
    if count:
        out += bytes([flags]) + items
    return len(data).to_bytes(8, "little") + bytes(out)


def lzss_unpack(data: bytes) -> bytes:
    size, at, out = int.from_bytes(data[:8], "little"), 8, bytearray()
    while len(out) < size:
        flags = data[at]
        at += 1
        for k in range(LITERALS):
            if len(out) >= size:
                break
            if flags >> k & 1:
                out.append(data[at])
                at += 1
            else:
                pair = int.from_bytes(data[at : at + 2], "big")
                at += 2
                start = len(out) - (pair >> 4) - 1
                for j in range((pair & 15) + SHORTEST):
                    out.append(out[start + j])
    return bytes(out)


class _Frequencies:
    """Adaptive counts of 256 letters and an end mark, with running sums in a binary indexed tree."""

    def __init__(self):
        self.n, self.total = 257, 0
        self.tree = [0] * (self.n + 1)
        for s in range(self.n):
            self.add(s, 1)

    def add(self, s: int, by: int) -> None:
        self.total += by
        s += 1
        while s <= self.n:
            self.tree[s] += by
            s += s & -s

    def below(self, s: int) -> int:
        out = 0
        while s:
            out += self.tree[s]
            s -= s & -s
        return out

    def find(self, value: int) -> int:
        at, step = 0, 256
        while step:
            if at + step <= self.n and self.tree[at + step] <= value:
                at += step
                value -= self.tree[at]
            step >>= 1
        return at


TOP = 1 << 32


def arithmetic_pack(data: bytes) -> bytes:
    """Arithmetic coding in whole numbers of 32 bits under adaptive letter counts, ended by a mark of its own."""
    f, low, high, pending, bits = _Frequencies(), 0, TOP - 1, 0, []

    def put(bit: int) -> None:
        nonlocal pending
        bits.append(bit)
        bits.extend([1 - bit] * pending)
        pending = 0

    for s in (*data, 256):
        span = high - low + 1
        a = f.below(s)
        b = f.below(s + 1)
        low, high = low + span * a // f.total, low + span * b // f.total - 1
        while True:
            if high < TOP // 2:
                put(0)
            elif low >= TOP // 2:
                put(1)
                low, high = low - TOP // 2, high - TOP // 2
            elif low >= TOP // 4 and high < 3 * TOP // 4:
                pending += 1
                low, high = low - TOP // 4, high - TOP // 4
            else:
                break
            low, high = 2 * low, 2 * high + 1
        f.add(s, 1)
    pending += 1
    put(0 if low < TOP // 4 else 1)
    return np.packbits(np.array(bits, np.uint8)).tobytes()


def arithmetic_unpack(data: bytes) -> bytes:
    bits = iter(np.unpackbits(np.frombuffer(data, np.uint8)).tolist())
    f, low, high, out, value = _Frequencies(), 0, TOP - 1, bytearray(), 0
    for _ in range(32):
        value = 2 * value + next(bits, 0)
    while True:
        span = high - low + 1
        s = f.find(((value - low + 1) * f.total - 1) // span)
        if s == 256:
            return bytes(out)
        out.append(s)
        a, b = f.below(s), f.below(s + 1)
        low, high = low + span * a // f.total, low + span * b // f.total - 1
        while True:
            if high < TOP // 2:
                off = 0
            elif low >= TOP // 2:
                off = TOP // 2
            elif low >= TOP // 4 and high < 3 * TOP // 4:
                off = TOP // 4
            else:
                break
            low, high, value = 2 * (low - off), 2 * (high - off) + 1, 2 * (value - off) + next(bits, 0)
        f.add(s, 1)


CODECS = {name: (lambda d, n=name: _arrow_pack(d, n), lambda d, n=name: _arrow_unpack(d, n)) for name in ARROW} | {
    "deflate": (lambda d: zlib.compress(d, 6), zlib.decompress),
    "bwt": (burrows_wheeler, inverse_burrows_wheeler),
    "mtf": (move_to_front, inverse_move_to_front),
    "lzss": (lzss_pack, lzss_unpack),
    "arithmetic": (arithmetic_pack, arithmetic_unpack),
}


def _column(f, data: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(bytes(v)))

    return run(data)


def compress(data: Column, codec: str) -> Column:
    """A binary column packed by one of CODECS; null stays null, empty data have a packed form too."""
    return _column(CODECS[codec][0], data)


def decompress(data: Column, codec: str) -> Column:
    return _column(CODECS[codec][1], data)
