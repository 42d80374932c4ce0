"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of 64 bits are kept once per distinct value. Two of them that differ in at most e bits agree in one of
e + 1 blocks, so each is dealt once per block, rotated so that the block comes first. A task holds the fingerprints of
many block values in one sorted array, which is a binary trie: a node is a range, its children are found from running
counts of ones. Pairs of nodes are walked together from the block's end, adding up differing bits, and dropped once
these exceed e. A task gives the edges of a spanning forest only; components are then joined without a driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh, text_of
from millrace.llm.shingles import fingerprint, shingle_hashes
from millrace.llm.similar import distinct_sets, first_of_groups, listed, shingle_sets
from millrace.operators.components import connected_components
from millrace.plans.storage import cut, stored

#: Least Jaccard similarity of near-duplicates in a corpus.
SIMILARITY = 0.8
#: Differing bits up to which the trie join proposes pairs to the exact test.
NEAR_BITS = 3


def fingerprint_column(width: int):
    """The fingerprint of a text's shingles of so many words."""

    @F.pandas_udf(T.LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return prints


def trie_pairs(values: np.ndarray, exact: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sorted 64-bit values that agree in their first ``exact`` bits and differ in at most ``budget``.

    Equal values are linked in a chain, not in all pairs.
    """
    n = len(values)
    same = np.flatnonzero(values[1:] == values[:-1])
    found_i, found_j = [same], [same + 1]
    keep = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if n else np.empty(0, np.int64)
    v = values[keep]
    if len(v) < 2:
        return np.concatenate(found_i), np.concatenate(found_j)
    head = v >> np.uint64(64 - exact) if exact else np.zeros(len(v), np.uint64)
    starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
    ends = np.r_[starts[1:], len(v)]
    big = ends - starts > 1
    al, ah = starts[big], ends[big]
    bl, bh, diff = al, ah, np.zeros(len(al), np.int64)
    for depth in range(exact, 64):
        if not len(al):
            break
        ones = np.r_[0, np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own = al == bl
        kids = [(al, am, bl, bm, diff, None), (am, ah, bm, bh, diff, None), (al, am, bm, bh, diff + 1, None), (am, ah, bl, bm, diff + 1, ~own)]
        cols = []
        for x in kids:
            ok = (x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= budget)
            ok &= ~((x[0] == x[2]) & (x[1] - x[0] == 1))
            if x[5] is not None:
                ok &= x[5]
            cols.append([c[ok] for c in x[:5]])
        al, ah, bl, bh, diff = (np.concatenate(c) for c in zip(*cols))
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = np.bitwise_count(v[i] ^ v[j]) <= budget
            found_i.append(keep[i[near]])
            found_j.append(keep[j[near]])
            rest = ~single
            al, ah, bl, bh, diff = al[rest], ah[rest], bl[rest], bh[rest], diff[rest]
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """(root, member) of a union-find over the pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        if (a := find(a)) != (b := find(b)):
            root[max(a, b)] = min(a, b)
    return ((find(x), x) for x in list(root) if find(x) != x)


def block_bits(budget: int) -> list[int]:
    base, more = divmod(64, budget + 1)
    return [base + (k < more) for k in range(budget + 1)]


def _joiner(budget: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    sizes = block_bits(budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        group, turned, vertex = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        held.clear()
        for g in np.unique(group).tolist():
            mine = np.flatnonzero(group == g)
            mine = mine[np.argsort(turned[mine].view(np.uint64), kind="stable")]
            i, j = trie_pairs(turned[mine].view(np.uint64), sizes[g % len(sizes)], budget)
            edges = list(_forest(i, j))
            if edges:
                a, b = vertex[mine][np.array(edges)].T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def links(classes: DataFrame, budget: int) -> DataFrame:
    """Spanning edges (src, dst) among classes (vertex, prints) that differ in at most ``budget`` bits in any one print.

    Edges that tasks find are enough to connect all linked classes; none joins classes that no chain of links joins.
    """
    sizes = block_bits(budget)
    n = len(sizes)
    shifts = [sum(sizes[:k]) for k in range(n)]
    part = classes.select("vertex", F.posexplode("prints").alias("part", "value"))

    def turn(shift: int):
        value = F.col("value")
        return value if shift == 0 else F.shiftleft(value, shift).bitwiseOR(F.shiftrightunsigned(value, 64 - shift))

    blocks = F.array(*(F.struct(turn(s).alias("turned"), F.shiftrightunsigned(turn(s), 64 - size).alias("head")) for s, size in zip(shifts, sizes)))
    rows = part.select("vertex", "part", F.posexplode(blocks).alias("block", "to"))
    dealt = rows.select((F.col("part") * n + F.col("block")).cast("int").alias("grp"), "to.turned", "vertex", "to.head").repartition("grp", "head")
    return dealt.select("grp", "turned", "vertex").mapInArrow(_joiner(budget), "src long, dst long")


def near_duplicates(documents: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """One row per document: doc_id, print (its fingerprint), component_id (the smallest doc_id reachable).

    Documents are linked if their fingerprints differ in at most ``budget`` bits; equal fingerprints are one class from the
    start. Null and empty texts have a fingerprint of zero and are linked like any other. Null doc_ids count as larger than
    all others and get their component's id; a component without any doc_id has null. Repeated rows stay. An empty table
    gives no rows; other columns are ignored.
    """
    prints = cut(documents.select("doc_id", fingerprint_column(width)(text_of()).alias("vertex")))
    classes = cut(prints.groupBy("vertex").agg(F.min("doc_id").alias("least")))
    member = connected_components(links(classes.select("vertex", F.array("vertex").alias("prints")), budget)).withColumnRenamed("vertex", "v")
    placed = classes.join(member, F.col("vertex") == F.col("v"), "left").select(F.col("vertex").alias("v"), "least", F.coalesce("component", "vertex").alias("component"))
    names = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("v", "component_id")
    return prints.join(names, F.col("vertex") == F.col("v")).select("doc_id", F.col("vertex").alias("print"), "component_id")


def similar_documents(documents: DataFrame, width: int = 5, similarity: float = SIMILARITY, budget: int = NEAR_BITS) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), and best_id and best_key, those of the first of its group.

    Documents are linked if the Jaccard similarity of their shingles of ``width`` words is at least ``similarity``; all such
    pairs are found and decided exactly (see similar). The first document has the least doc_id, null last, then the least
    text_key. Null and empty texts form a group. Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    bound = Fraction(str(similarity))
    sets = shingle_sets(documents, width, bound)
    classes = distinct_sets(sets)
    best = first_of_groups(sets, classes, links(classes, budget), documents, width, bound)
    return sets.select("doc_id", "text_key", "vertex").join(best, "vertex").select("doc_id", "text_key", F.col("best.doc_id").alias("best_id"), F.col("best.text_key").alias("best_key"))


def one_of_each(documents: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates (see similar_documents): its first document, the rest goes.

    Of rows that have doc_id and text in common one stays, the least by a hash of all columns that can be hashed. An empty
    table stays empty; all columns stay.
    """
    every = similar_documents(documents, width, similarity)
    same = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_key") == F.col("best_key"))
    counted = stored(every.groupBy(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text")).agg(F.count("*").alias("n"), F.first(same).alias("stays")).where("n > 1 or not stays"))
    whole = listed(documents, counted.select("k_doc", "k_text"), "left_anti")
    again = listed(documents, counted.where("stays").select("k_doc", "k_text"), "left_semi")
    hashed = F.xxhash64(*(again[f"`{f.name}`"] for f in again.schema if "map<" not in f.dataType.simpleString()))
    one = again.groupBy("doc_id", F.xxhash64("text").alias(fresh(documents, "_key")[0])).agg(F.min_by(F.struct("*"), hashed).alias("_row")).select("_row.*")
    return whole.unionByName(one)


def near_duplicate_table(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for 3-word shingles and 2 differing bits."""
    rows = near_duplicates(documents)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
