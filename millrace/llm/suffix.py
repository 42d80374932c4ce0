"""Removal of passages that repeat across documents, by sorting suffixes.

Only suffixes that can repeat are sorted. Every window of 50 bytes is served by its anchor, the 24-byte string in it
with the least hash, so equal windows have equal anchors at equal places. Anchors whose string occurs in two documents
or more send the few windows that they serve to a task that has all windows of that anchor; there the windows are put
in order by deep-shallow sorting (multikey quicksort to a shallow depth, blind tries from there on) and windows that
are equal to 50 bytes fall together. A byte is removed if it lies in a window that a document with a smaller id has too.

    documents -> anchors -> repeated anchors -> windows -> equal windows -> spans -> kept bytes

Each task joins what repeats within its own share of the documents before anything is sent: an anchor, or a window's
surroundings, goes on once per share however many of its documents have it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM + 1  # strings of GRAM bytes in a window
TILE = 1 << 18
SHARE = 8 << 20
#: Stretches that are sorted at a time; all of an anchor stay together.
BLOCK = 20_000
#: Words of 8 bytes that quicksort looks at before blind tries take over.
SHALLOW = 3
MANY = np.uint32(0xFFFFFFFF)
LAST_ID = np.iinfo(np.int64).max
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of every run of GRAM bytes, put together from runs of powers of two, then mixed to 62 bits."""
    power, width, base = data.astype(np.uint64) + np.uint64(1), 1, BASE
    whole, have = None, 0
    while width <= GRAM:
        if GRAM & width:
            if whole is None:
                whole, have = power, width
            else:
                n = len(data) - have - width + 1
                whole, have = whole[:n] * base + power[have : have + n], have + width
        if 2 * width <= GRAM:
            n = len(data) - 2 * width + 1
            power = power[:n] * base + power[width : width + n]
        width, base = 2 * width, np.uint64(int(base) ** 2 % 2**64)
    whole = (whole ^ (whole >> np.uint64(32))) * MIX
    return (whole ^ (whole >> np.uint64(29))) >> np.uint64(2)


def _hash_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes at some places, a block of places at a time."""
    runs = np.lib.stride_tricks.sliding_window_view(data, GRAM)
    blocks = (runs[at[k : k + 4096]].ravel() for k in range(0, len(at), 4096))
    return np.concatenate([np.empty(0, np.uint64), *(_gram_hashes(b)[::GRAM] for b in blocks)])


def _slide(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` over every run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        values, done = least(values[:-done], values[done:]), 2 * done
    return least(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of documents data[starts:ends], worked out in tiles. Windows stay inside a document."""
    found_at, found_hash, size = [], [], len(data)
    edge = np.zeros(size + 1, np.int8)
    long_enough = ends - starts >= LENGTH
    np.add.at(edge, starts[long_enough], 1)
    np.add.at(edge, ends[long_enough] - LENGTH + 1, -1)
    valid = np.cumsum(edge, dtype=np.int8)[:-1] > 0
    for lo in range(0, size - GRAM + 1, TILE):
        first, past = max(0, lo - REACH + 1), min(size, lo + TILE + LENGTH)
        if past - first < LENGTH:
            continue
        h = _gram_hashes(data[first:past])
        window = _slide(h, REACH, np.minimum)
        window = np.where(valid[first : first + len(window)], window, np.uint64(0))
        none = np.zeros(REACH - 1, np.uint64)
        best = _slide(np.concatenate([none, window, none]), REACH, np.maximum)[: len(h)]
        is_anchor = np.flatnonzero((best == h) & (best > 0))
        is_anchor = is_anchor[(is_anchor + first >= lo) & (is_anchor + first < lo + TILE)]
        found_at.append(is_anchor + first)
        found_hash.append(h[is_anchor])
    if not found_at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(found_at), np.concatenate(found_hash)


def served(at: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start that each anchor serves: no window with a lesser hash in it, none over a document's ends."""
    lo = np.maximum(at - REACH + 1, starts)
    hi = np.minimum(at, ends - LENGTH)
    for side in (1, -1):
        left, step = np.arange(len(at)), 1
        while len(left):
            other = left - side * step
            left = left[(other >= 0) & (other < len(at))]
            other = left - side * step
            close = np.abs(at[left] - at[other]) < REACH
            left, other = left[close], other[close]
            less = h[other] < h[left]
            if side == 1:
                lo[left[less]] = np.maximum(lo[left[less]], at[other[less]] + 1)
            else:
                hi[left[less]] = np.minimum(hi[left[less]], at[other[less]] - REACH)
            step += 1
    return lo, hi


def deep_shallow(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings, given as rows of big-endian words, inside groups: (order, class), equal strings of a group share a class.

    All groups are worked on together, a step at a time. Multikey quicksort splits a group in three by one word of its
    middle string until SHALLOW words are equal; what is left goes into blind tries, which branch at the first byte in
    which the strings of a node differ and never look at what they have in common.
    """
    n, width = words.shape
    order = np.argsort(group, kind="stable")
    label = group[order]
    cls = np.cumsum(np.r_[False, label[1:] != label[:-1]]) if n else np.empty(0, np.int64)
    depth = np.zeros(n, np.int64)
    shallow = min(SHALLOW, width)
    place = np.arange(n)  # places in ``order`` of the strings still worked on

    def resort(place, key, bounds):
        """Order the strings at ``place`` by (their group, key)."""
        by = np.lexsort((key, bounds))
        return by

    def busy(place):
        c = cls[place]
        if not len(c):
            return place
        new = np.r_[True, c[1:] != c[:-1]]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(c)])
        return place[np.repeat(sizes > 1, sizes)]

    def split(place, key):
        """Reorder inside classes by key and give each (class, key) a class of its own, numbered by first place."""
        by = resort(place, key, cls[place])
        order[place], depth[place] = order[place[by]], depth[place[by]]
        c, k = cls[place], key[by]
        new = np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])]
        cls[place] = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
        return k

    cls = place[np.maximum.accumulate(np.where(np.r_[True, cls[1:] != cls[:-1]], place, 0))] if n else cls
    active = busy(place)
    while len(active):
        c = cls[active]
        new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        sizes = np.diff(np.r_[new, len(c)])
        w = words[order[active], depth[active]]
        pivot = np.repeat(w[new + sizes // 2], sizes)
        key = split(active, (w > pivot).astype(np.int8) - (w < pivot).astype(np.int8))
        depth[active[key == 0]] += 1
        active = busy(active)
        active = active[depth[active] < shallow]
    active = busy(place[depth >= shallow]) if shallow < width else place[:0]
    while len(active):
        c = cls[active]
        new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        sizes = np.diff(np.r_[new, len(c)])
        leader = np.repeat(order[active[new]], sizes)
        mine = order[active]
        byte = np.full(len(active), 8 * width, np.int64)
        for k in range(width - 1, shallow - 1, -1):
            x = words[mine, k] ^ words[leader, k]
            differs = x != 0
            high = np.frexp(x[differs].astype(np.float64))[1]  # bits up to the highest one; rounding may add one
            high -= (x[differs] >> np.minimum(high - 1, 63).astype(np.uint64)) == 0
            byte[differs] = 8 * k + (64 - high) // 8
        branch = np.minimum.reduceat(byte, new)
        at = np.repeat(branch, sizes)
        go = at < 8 * width
        if not go.any():
            break
        active, at = active[go], at[go]
        w = words[order[active], at // 8]
        split(active, ((w >> (np.uint64(56) - np.uint64(8) * (at % 8).astype(np.uint64))) & np.uint64(255)).astype(np.int16))
        active = busy(active)
    return order, cls


def _as_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int, most: int) -> np.ndarray:
    """Rows of big-endian words with the bytes data[start:start+size], zeros after them."""
    width = -(-most // 8)
    padded = np.r_[data, np.zeros(8 * width, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8 * width)[starts]
    sizes = np.broadcast_to(sizes, len(starts))
    if len(starts) and (sizes.min() < 8 * width):
        rows = np.where(np.arange(8 * width) < sizes[:, None], rows, np.uint8(0))
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def merge_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by key; spans that touch become one."""
    if not len(key):
        return key, start, end
    by = np.lexsort((start, key))
    key, start, end = key[by], start[by], end[by]
    rank = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + rank * wide)
    new = np.r_[True, start[1:] + rank[1:] * wide > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(key) - 1]
    return key[first], start[first], reach[last] - rank[last] * wide


def repeated_windows(h, doc, low, near, count, data, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows a smaller document has too: (record, start, end), spans inside the records' documents.

    Records are stretches of text around an anchor: hash, document, where the stretch begins there, bytes before the
    anchor, number of windows, and place in ``data``. Equal stretches are found first; windows are sorted for one of
    each kind, and only where an anchor has stretches of several kinds.
    """
    none = np.empty(0, np.int64)
    if not len(h):
        return none, none, none
    _, group = np.unique(h, return_inverse=True)
    _, shape = np.unique((group * 64 + near) * 64 + count, return_inverse=True)
    order, cls = deep_shallow(_as_words(data, at, count + LENGTH - 1, REACH + LENGTH - 1), shape)
    kind = np.empty(len(h), np.int64)
    kind[order] = np.cumsum(np.r_[False, cls[1:] != cls[:-1]])
    kinds = int(kind.max()) + 1
    least = np.full(kinds, LAST_ID)
    np.minimum.at(least, kind, doc)
    one = np.empty(kinds, np.int64)
    one[kind[::-1]] = np.arange(len(h))[::-1]
    per_group = np.bincount(group[one])
    mixed = per_group[group[one]] > 1
    # Windows of one record of each kind, where the anchor has several kinds.
    rep = one[mixed]
    total = count[rep]
    owner = np.repeat(np.arange(len(rep)), total)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total)
    window_least = np.full(len(owner), LAST_ID)
    if len(owner):
        _, slot = np.unique(group[rep][owner] * 64 + (near[rep][owner] - nth), return_inverse=True)
        w_order, w_cls = deep_shallow(_as_words(data, at[rep][owner] + nth, LENGTH, LENGTH), slot)
        same = np.empty(len(owner), np.int64)
        same[w_order] = np.cumsum(np.r_[False, w_cls[1:] != w_cls[:-1]])
        by_class = np.full(int(same.max()) + 1, LAST_ID)
        np.minimum.at(by_class, same, least[kind[rep]][owner])
        window_least = by_class[same]
    # Records whose kind is their anchor's only one: all of their windows or none.
    whole = ~mixed[kind] & (doc > least[kind])
    r = np.flatnonzero(whole)
    out = [(r, low[r], low[r] + count[r] - 1 + LENGTH)]
    if len(owner):
        first = np.full(kinds, -1)
        first[kind[rep]] = np.cumsum(total) - total
        r = np.flatnonzero(mixed[kind])
        many = count[r]
        rec = np.repeat(r, many)
        k = np.arange(len(rec)) - np.repeat(np.cumsum(many) - many, many)
        hit = window_least[first[kind[rec]] + k] < doc[rec]
        rec, k = rec[hit], k[hit]
        out.append((rec, low[rec] + k, low[rec] + k + LENGTH))
    rec, start, end = (np.concatenate(x) for x in zip(*out))
    return merge_spans(rec, start, end)


# What tasks send each other: rows of packed columns. kind 0 is still to be settled, kind 1 passes on to its documents' bucket.
ROWS = "kind int, part int, a binary, b binary, c binary, d binary, e binary, f binary"
ROW_TYPE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *((x, pa.binary()) for x in "abcdef")])


def pack(column: np.ndarray) -> bytes:
    """Bytes of a column by significance, compressed; ids (int64) as differences. Rows of bytes count as one value each."""
    if column.dtype == np.int64:
        column = np.diff(column, prepend=np.int64(0))
    planes = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind, width: int | None = None) -> np.ndarray:
    """What pack() was given; ``width`` is the row length of rows of bytes."""
    size = width or np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T
    values = np.ascontiguousarray(planes) if width else np.ascontiguousarray(planes).view(kind).ravel()
    return np.cumsum(values) if values.dtype == np.int64 else values


def _row(kind: int, part: int, *columns: np.ndarray) -> tuple:
    return (kind, part, *map(pack, columns), *(None,) * (6 - len(columns)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW_TYPE)], schema=ROW_TYPE)


def _by_part(kind: int, part: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    return [_row(kind, int(part[lo]), *(c[lo:hi] for c in columns)) for lo, hi in zip(cuts, np.r_[cuts[1:], len(part)])]


def _bucket(doc: np.ndarray, parts: int) -> np.ndarray:
    x = doc.astype(np.int64).view(np.uint64)
    x = x ^ (x >> np.uint64(33))
    x = x ^ (x << np.uint64(13))
    x = x ^ (x >> np.uint64(17))
    return (x.view(np.int64) % parts).astype(np.int64)


def bucket_column(doc: Column, parts: int) -> Column:
    """The same in SQL."""
    x = F.coalesce(doc, F.lit(int(LAST_ID)))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 33))
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    return F.pmod(x.bitwiseXOR(F.shiftrightunsigned(x, 17)), F.lit(parts)).cast("int")


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc ids, texts as bytes) of about SHARE bytes each."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(int(LAST_ID) if doc is None else doc)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= SHARE:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, ends[:-1]], ends


def _probe(parts: int, tasks: int):
    """Documents -> anchors. An anchor that several documents of the share have is sent once; its places are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _shares(batches):
            data, starts, ends = _layout(texts)
            at, h = anchors(data, starts, ends)
            if not len(at):
                continue
            which = np.searchsorted(ends, at, side="right")
            doc, pos = ids[which], (at - starts[which]).astype(np.uint32)
            h &= np.uint64((1 << 48) - 1)
            by = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
            sizes = np.diff(np.r_[first, len(by)])
            several = np.minimum.reduceat(doc[by], first) != np.maximum.reduceat(doc[by], first)
            many = np.repeat(several, sizes)
            single = np.sort(by[~many])
            group = h[by[first[several]]]
            sent = (np.r_[h[single], group], np.r_[doc[single], np.zeros(len(group), np.int64)], np.r_[pos[single], np.full(len(group), MANY)])
            six = sent[0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows = _by_part(0, (sent[0] % np.uint64(tasks)).astype(np.int64), six, sent[1], sent[2])
            known = np.sort(by[many])
            rows += _by_part(1, _bucket(doc[known], parts), doc[known], pos[known])
            yield _batch(rows)

    return run


def _repeats(parts: int):
    """Anchors -> places of those that two documents or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            passed = []
            for row in batch.to_pylist():
                if row["kind"]:
                    passed.append((1, row["part"], row["a"], row["b"], None, None, None, None))
                else:
                    held.append((row["a"], row["b"], row["c"]))
            if passed:
                yield _batch(passed)
        if not held:
            return
        six, doc, pos = (np.concatenate([unpack(x[k], t, w) for x in held]) for k, (t, w) in enumerate(((np.uint8, 6), (np.int64, None), (np.uint32, None))))
        held.clear()
        h = np.zeros((len(six), 8), np.uint8)
        h[:, :6] = six
        h = h.view("<u8").ravel()
        by = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
        d, p = doc[by], pos[by]
        flagged = p == MANY
        low = np.minimum.reduceat(np.where(flagged, LAST_ID, d), first)
        high = np.maximum.reduceat(np.where(flagged, np.iinfo(np.int64).min, d), first)
        again = np.logical_or.reduceat(flagged, first) | (low < high)
        chosen = np.repeat(again, np.diff(np.r_[first, len(by)])) & ~flagged
        if chosen.any():
            d, p = d[chosen], p[chosen]
            by = np.lexsort((p, d))
            yield _batch(_by_part(1, _bucket(d[by], parts), d[by], p[by]))

    return run


def _join(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(unpack(x, kind) for x in table.column(name).to_pylist())])


def _windows(parts: int, tasks: int):
    """Documents and places of repeated anchors of a bucket -> stretches of text; stretches that repeat here are settled here."""

    def run(documents: pa.Table, places: pa.Table) -> pa.Table:
        rows = []
        if documents.num_rows and places.num_rows:
            want_doc, want_pos = _join(places, "a", np.int64), _join(places, "b", np.uint32)
            wanted = np.unique(want_doc)
            by = np.lexsort((want_pos, want_doc))
            want_doc, want_pos = want_doc[by], want_pos[by]
            narrow = documents.select(["doc_id", "text"])
            for ids, texts in _shares(narrow.to_batches()):
                mine = np.flatnonzero(np.isin(ids, wanted))
                ids, texts = ids[mine], [texts[i] for i in mine.tolist()]
                if not texts:
                    continue
                data, starts, ends = _layout(texts)
                at, h = anchors(data, starts, ends)
                which = np.searchsorted(ends, at, side="right")
                lo, hi = served(at, h, starts[which], ends[which])
                lo_in, hi_in = np.searchsorted(want_doc, ids, "left"), np.searchsorted(want_doc, ids, "right")
                keep = np.zeros(len(at), bool)
                edges = np.searchsorted(which, np.arange(len(ids) + 1))
                for i in range(len(ids)):
                    own = slice(edges[i], edges[i + 1])
                    keep[own] = np.isin(at[own] - starts[i], want_pos[lo_in[i] : hi_in[i]])
                keep &= hi >= lo
                at, h, which, lo, hi = (x[keep] for x in (at, h, which, lo, hi))
                tag = np.array([zlib.crc32(t) for t in texts], np.uint32)
                rows += _settle_or_send(parts, tasks, h, ids[which], tag[which], lo - starts[which], at - lo, hi - lo + 1, data, lo)
        return pa.Table.from_batches([_batch(rows)]) if rows else ROW_TYPE.empty_table()

    return run


def _settle_or_send(parts, tasks, h, doc, tag, low, near, count, data, at) -> list[tuple]:
    """Of equal stretches around an anchor, those of the smallest document are sent; the others are repeats of it for sure."""
    if not len(h):
        return []
    _, shape = np.unique(h * np.uint64(4096) + (near * 64 + count).astype(np.uint64), return_inverse=True)
    order, cls = deep_shallow(_as_words(data, at, count + LENGTH - 1, REACH + LENGTH - 1), shape)
    first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(order)]))
    settled = np.zeros(len(h), bool)
    settled[order] = doc[order] > least
    rows = []
    r = np.flatnonzero(settled)
    if len(r):
        rows += _span_rows(parts, doc[r], tag[r], low[r], low[r] + count[r] - 1 + LENGTH)
    r = np.flatnonzero(~settled)
    part = (h[r] % np.uint64(tasks)).astype(np.int64)
    r, part = r[by := np.argsort(part, kind="stable")], part[by]
    size = count[r] + LENGTH - 1
    offset = np.cumsum(size) - size
    text = data[np.repeat(at[r] - offset, size) + np.arange(int(size.sum()))]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(r)]):
        s = r[lo:hi]
        shape = np.stack([near[s], count[s]], axis=1).astype(np.uint8)
        rows.append(_row(0, int(part[lo]), doc[s], tag[s], low[s].astype(np.uint32), shape, text[offset[lo] : offset[hi - 1] + size[hi - 1]]))
    return rows


def _span_rows(parts: int, doc, tag, start, end) -> list[tuple]:
    pair, inverse = np.unique(np.stack([doc, tag.astype(np.int64)], axis=1), axis=0, return_inverse=True)
    key, start, end = merge_spans(inverse.ravel(), np.asarray(start, np.int64), np.asarray(end, np.int64))
    return _by_part(1, _bucket(pair[key, 0], parts), pair[key, 0], pair[key, 1].astype(np.uint32), start.astype(np.uint32), end.astype(np.uint32))


def _sorted_windows(parts: int):
    """Stretches around the same anchors -> spans of windows that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            passed = []
            for row in batch.to_pylist():
                (passed if row["kind"] else held).append(tuple(row.values()))
            if passed:
                yield _batch(passed)
        if not held:
            return
        columns = ((np.int64, None), (np.uint32, None), (np.uint32, None), (np.uint8, 2), (np.uint8, None))
        doc, tag, low, shape, data = (np.concatenate([unpack(x[2 + k], t, w) for x in held]) for k, (t, w) in enumerate(columns))
        held.clear()
        near, count = shape.astype(np.int64).T
        size = count + LENGTH - 1
        at = np.cumsum(size) - size
        h = _hash_at(data, at + near)
        by = np.argsort(h, kind="stable")
        ends = np.flatnonzero(np.r_[h[by][1:] != h[by][:-1], True]) + 1
        lo = 0
        while lo < len(by):
            hi = int(ends[min(np.searchsorted(ends, lo + BLOCK), len(ends) - 1)])
            mine = by[lo:hi]
            rec, start, end = repeated_windows(h[mine], doc[mine], low[mine].astype(np.int64), near[mine], count[mine], data, at[mine])
            if len(rec):
                rec = mine[rec]
                yield _batch(_span_rows(parts, doc[rec], tag[rec], start, end))
            lo = hi

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cleaner(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("kept", pa.binary())] if with_text else []))

    def run(documents: pa.Table, spans: pa.Table) -> pa.Table:
        doc, tag, start, end = (_join(spans, n, t) for n, t in (("a", np.int64), ("b", np.uint32), ("c", np.uint32), ("d", np.uint32)))
        by = np.lexsort((start, tag, doc))
        doc, tag, start, end = doc[by], tag[by], start[by].tolist(), end[by].tolist()
        out = []
        for own, text in zip(documents.column("doc_id").to_pylist(), documents.column("text").cast(pa.binary()).to_pylist()):
            text, key = text or b"", int(LAST_ID) if own is None else own
            lo, hi = np.searchsorted(doc, key, "left"), np.searchsorted(doc, key, "right")
            kept, at, spans_of, removed = [], 0, 0, 0
            if hi > lo:
                crc = zlib.crc32(text)
                lo, hi = lo + np.searchsorted(tag[lo:hi], crc, "left"), lo + np.searchsorted(tag[lo:hi], crc, "right")
                until = -1
                for s, e in zip(start[lo:hi], end[lo:hi]):
                    if s > until:
                        spans_of += 1
                        kept.append(text[at:s])
                    if e > until:
                        removed += e - max(s, until, 0)
                        until = at = e
            kept.append(text[at:])
            rest = b"".join(kept)
            row = (own, len(text), removed, spans_of, hashlib.sha256(rest).hexdigest())
            out.append(row + ((rest,) if with_text else ()))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def without_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and with ``with_text`` the kept bytes.

    Null and empty texts, and all under 50 bytes, keep what they have. A null doc_id is larger than all others, and
    documents without one do not count as repeats of each other; neither do rows with the same doc_id, whether their
    texts are the same or not. Matches may overlap; they are judged on the input. An empty table gives no rows; other
    columns are ignored.
    """
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * tasks + 1  # buckets of documents; anchors are dealt to tasks directly, so tasks exchange a row a pair
    texts = documents.select("doc_id", text_of().alias("text"))
    dealt = texts.withColumn("part", bucket_column(F.col("doc_id"), parts))
    places = texts.mapInArrow(_probe(parts, tasks), ROWS).repartitionById(tasks, "part").mapInArrow(_repeats(parts), ROWS).select("part", "a", "b")
    windows = dealt.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_windows(parts, tasks), ROWS)
    spans = windows.repartitionById(tasks, "part").mapInArrow(_sorted_windows(parts), ROWS).select("part", "a", "b", "c", "d")
    result = RESULT + (", kept binary" if with_text else "")
    return dealt.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_cleaner(with_text), result)
