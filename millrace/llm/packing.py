"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces no longer than the largest bin, dealt by hash to shards of bounded size, and each shard is
packed by itself: longest piece first, into the open bin that it fills best. Where none has room, a bin is opened, of a
length that the plan sets for pieces of that size. Plans for all sizes are compared jointly: a shard is packed by each of
them, and the one of the least cost is taken, bins counted as they are after the last step, in which each shrinks to the
smallest permitted length that holds its contents. A sequence costs a fixed part, a part in proportion to its length and
a part that grows with its square, as attention does: short sequences are cheap to run, long ones waste less.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of, word_count
from millrace.plans.storage import stored

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a sequence beside its length: a fixed part in tokens, and the length at which attention costs as much as all else.
OVERHEAD, ATTENTION = 16, 8192
#: Permitted lengths up to which all plans are compared, k! for k lengths; with more, one size's choice is changed at a time.
ALL_PLANS = 4
#: Pieces that one task packs at a time.
SHARD = 40_000
SCHEMA = "bin_id string, bin_length int, bin_used int, bin_offset int, doc_id long, copy long, piece long, start long, length int"


class OpenBins:
    """Bins by free room; the least room that is enough is found in a bit set."""

    def __init__(self):
        self.rooms: dict[int, list[int]] = {}
        self.bits = 0

    def put(self, room: int, number: int) -> None:
        self.rooms.setdefault(room, []).append(number)
        self.bits |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        if not (above := self.bits >> need):
            return None
        room = need + (above & -above).bit_length() - 1
        number = self.rooms[room].pop()
        if not self.rooms[room]:
            self.bits &= ~(1 << room)
        return room, number


def sequence_cost(length, overhead: int = OVERHEAD, attention: int = ATTENTION):
    """What sequences of these lengths cost, in tokens."""
    return overhead + length * (1 + length / attention)


def best_fit(lengths: np.ndarray, permitted: tuple[int, ...], plan: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in descending order: bin number and offset of each, and each bin's final length.

    ``plan`` names for each permitted length the one to open for a piece that is longer than all smaller ones.
    """
    opened = [plan[k] for k in np.searchsorted(permitted, lengths).tolist()]
    where, offset = [], []
    size: list[int] = []
    bins = OpenBins()
    for n, new in zip(lengths.tolist(), opened):
        if found := bins.take(n):
            room, number = found
        else:
            room, number = new, len(size)
            size.append(new)
        where.append(number)
        offset.append(size[number] - room)
        if room > n:
            bins.put(room - n, number)
    where, offset = np.array(where, np.int64), np.array(offset, np.int64)
    used = np.bincount(where, weights=lengths, minlength=len(size)).astype(np.int64)
    return where, offset, np.array(permitted, np.int64)[np.searchsorted(permitted, used)]


def pack(lengths: np.ndarray, permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of the given lengths: bin number and offset of each, and each bin's final length, by the plan of least cost.

    Of plans of the same cost the first counts, in the order of the lengths that they open for the longest pieces first.
    """
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    tried: dict[tuple[int, ...], tuple] = {}

    def cost(plan: tuple[int, ...]) -> float:
        if plan not in tried:
            packed = best_fit(falling, permitted, plan)
            tried[plan] = float(sequence_cost(packed[2], overhead, attention).sum()), packed
        return tried[plan][0]

    choices = [permitted[k:] for k in range(len(permitted))]
    if len(permitted) <= ALL_PLANS:
        best = min((p[::-1] for p in product(*choices[::-1])), key=cost)
    else:
        best, last = tuple(permitted), None
        while best != last:
            last = best
            for k, own in enumerate(choices):
                best = min((best[:k] + (c,) + best[k + 1 :] for c in own), key=cost)
    where, offset, final = tried[best][1]
    placed, at = np.empty_like(where), np.empty_like(offset)
    placed[order], at[order] = where, offset
    return placed, at, final


def _packer(permitted: tuple[int, ...], overhead: int, attention: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable", na_position="first", ignore_index=True)
        lengths = shard["length"].to_numpy(np.int64)
        where, offset, final = pack(lengths, permitted, overhead, attention)
        used = np.bincount(where, weights=lengths, minlength=len(final)).astype(np.int64)
        name = str(int(shard["shard"].iloc[0]))
        return pd.DataFrame({
            "bin_id": name + "-" + pd.Series(where).astype(str), "bin_length": final[where].astype(np.int32), "bin_used": used[where].astype(np.int32), "bin_offset": offset.astype(np.int32),
            "doc_id": shard["doc_id"], "copy": shard["copy"], "piece": shard["piece"], "start": shard["start"], "length": lengths.astype(np.int32),
        })

    return run


def pack_documents(documents: DataFrame, permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD, attention: int = ATTENTION) -> DataFrame:
    """One row per piece: its bin, the bin's final length and contents, the offset in the bin, and the words it holds.

    A document of n words is n + 1 tokens: an end mark follows it, so that null and empty texts have a place too.
    Documents longer than the largest bin are cut into pieces of that length and a rest; nothing is dropped. Rows of the
    same doc_id and number of words are counted first and numbered as copies (from 0), so that however often a row is
    repeated, its copies are dealt to all shards. Ties are broken by doc_id, copy and piece, null doc_ids first. An empty
    table gives no rows; other columns are ignored.
    """
    permitted = tuple(sorted(set(permitted)))
    largest = permitted[-1]
    sized = documents.select("doc_id", (word_count(text_of()) + 1).alias("tokens"))
    counted = stored(sized.groupBy("doc_id", "tokens").agg(F.count("*").alias("copies")))
    rows = counted.select("doc_id", "tokens", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    pieces = rows.select("doc_id", "tokens", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / largest))).alias("piece"))
    pieces = pieces.select("doc_id", "copy", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("tokens") - F.col("piece") * largest).alias("length"))
    total = counted.agg(F.sum(F.col("copies") * F.ceil(F.col("tokens") / largest))).first()[0] or 0
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "copy", "piece"), F.lit(max(1, -(-int(total) // shard)))))
    return dealt.groupBy("shard").applyInPandas(_packer(permitted, overhead, attention), SCHEMA)
