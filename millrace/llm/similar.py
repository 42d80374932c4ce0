"""Groups of texts by the exact Jaccard similarity of their word shingles.

Candidate pairs come from the SimHash trie join (see simhash) and, for what fingerprints cannot see, from a prefix filter:
two sets of n and m elements with a similarity of at least s share an element among the first n - ceil(s * n) + 1 of the
one and the first m - ceil(s * m) + 1 of the other, in any fixed order of all elements. Elements that are common in a
sample come last in that order; the sample decides how many pairs are compared, never which are found.

Elements that the same texts share, such as those of one passage, stand for one another: the first of them is kept. Of the
texts that share it, one that shares most is compared with all others first, and then, while that joins groups, one of those
outside the largest group. What these links leave in different groups is compared with the texts of that element's other
groups, for each group the nearest pair first. Before two sets are fetched, their odd sketches are compared: bit b of a sketch is the parity of how many elements fall into bucket b, so two sketches differ in at
most as many bits as the sets differ in elements, and a pair beyond that bound is dropped without being missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import let, text_of
from millrace.llm.shingles import SEED, fingerprint, shingle_hashes
from millrace.operators.components import connected_components
from millrace.plans.storage import cut, stored

#: Distinct texts of the sample for common shingles, about, and how many of these are sent to tasks at most.
SAMPLE, COMMON = 4000, 200_000
#: Bits of an element in the prefix filter. Elements that fall together there cost a comparison, no more.
ELEMENT_BITS = 48
#: Least bits of an odd sketch; it has a power of two, over twice as many as the set has elements.
SKETCH_BITS = 256
#: Rounds with further leaders, and rounds with nearest pairs before all pairs that are left are compared at once.
LEADERS, NEAREST = 1, 4
#: Keys up to which a list of documents or sets is broadcast; a longer one is joined by key.
FEW_KEYS = 1_000_000


def common_shingles(documents: DataFrame, width: int) -> np.ndarray:
    """Shingles of several texts of a sample, the most common last."""
    every = max(1, documents.count() // SAMPLE)
    texts = documents.select(text_of().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).dropDuplicates(["text"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, width)).view(np.int64))], names=["h"])

    counts = texts.mapInArrow(shingles, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON)
    return np.array([r.h for r in counts.collect()][::-1], np.int64).view(np.uint64)


def odd_sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each bucket, as signed 64-bit numbers. The halves of a sketch add up to the one of half the bits."""
    bits = max(SKETCH_BITS, 1 << (2 * len(elements)).bit_length())
    bucket = (elements >> np.uint64(20)) % np.uint64(bits)
    return np.packbits(np.bincount(bucket.astype(np.int64), minlength=bits) & 1).view(np.int64)


SET = T.StructType([T.StructField("vertex", T.LongType()), T.StructField("size", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])


def set_column(width: int, least: Fraction, common: np.ndarray):
    """Of a text's shingles: vertex (a hash of the set), its size, fingerprint and odd sketch, and its prefix in order."""
    by_hash = np.argsort(common)
    in_order = common[by_hash]

    @F.pandas_udf(SET)
    def sets(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            every = shingle_hashes(t, width)
            h = np.unique(every)
            n = len(h)
            rank = np.full(n, -1)
            if len(in_order):
                at = np.minimum(np.searchsorted(in_order, h), len(in_order) - 1)
                rank = np.where(in_order[at] == h, by_hash[at], -1)
            keep = n - -(-least.numerator * n // least.denominator) + 1 if n else 0
            prefix = h[np.lexsort((h, rank))[:keep]]
            rows.append((int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64)), n, [fingerprint(every)], odd_sketch(h), (prefix >> np.uint64(64 - ELEMENT_BITS)).view(np.int64)))
        return pd.DataFrame(rows, columns=SET.names)

    return sets


def shingle_sets(documents: DataFrame, width: int, least: Fraction) -> DataFrame:
    """(doc_id, text_key, vertex, size, prints, sketch, prefix), stored. Texts without words share one vertex."""
    column = set_column(width, least, common_shingles(documents, width))
    return stored(documents.select("doc_id", F.xxhash64("text").alias("text_key"), column(text_of()).alias("s")).select("doc_id", "text_key", "s.*"))


def few(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast if they are few."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def listed(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` with (or, for left_anti, without) a (k_doc, k_text) among the keys."""
    keys = few(keys)
    return rows.join(keys, rows["doc_id"].eqNullSafe(keys["k_doc"]) & (F.xxhash64(rows["text"]) == keys["k_text"]), how)


def _halved(sketch: Column, half: Column) -> Column:
    """The sketch of ``half`` as many 64-bit numbers."""
    return F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def short_sketch(sketch: Column, size: Column) -> Column:
    """A half or a quarter of a sketch, of two thirds to four thirds as many bits as the set has elements, 64 at least.

    It bounds the similarity as the whole one does, and tells most sets apart that are not alike. Of sets whose sizes allow
    the similarity, one short sketch may be twice as long as the other.
    """
    half = _halved(sketch, (F.size(sketch) / 2).cast("int"))
    return F.when(F.size(sketch) * 24 >= size, let(half, lambda h: _halved(h, (F.size(h) / 2).cast("int")))).otherwise(half)


def _bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two sketches, one of which may be twice as long; for sets of more different sizes it is not asked."""

    def folded(long: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(long) > half, _halved(long, half)).otherwise(long)

    each = F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def _may_be_alike(x: str, y: str, least: Fraction) -> Column:
    """Whether sizes and sketches (size_x, sketch_x, ...) allow the similarity: sets differ in (1 - s) / (1 + s) of their sizes' sum at most."""
    p, q = least.numerator, least.denominator
    n, m = F.col(f"size_{x}"), F.col(f"size_{y}")
    return (F.least(n, m) * q >= F.greatest(n, m) * p) & (_bits_apart(F.col(f"sketch_{x}"), F.col(f"sketch_{y}")) * (q + p) <= (n + m) * (q - p))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("vertex")).union(pairs.select(F.col("dst").alias("vertex"))).distinct()


def _sketched(pairs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (src, dst) with sizes and sketches of their ends as sides a and b, and the classes of the ends, stored."""
    info = stored(classes.join(few(stored(_ends(pairs))), "vertex").select("vertex", "size", "sketch", "least"))
    for side, end in (("a", "src"), ("b", "dst")):
        pairs = pairs.join(info.select(F.col("vertex").alias(end), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), end)
    return pairs, info


def alike(pairs: DataFrame, classes: DataFrame, documents: DataFrame, width: int, least: Fraction) -> DataFrame:
    """The pairs (src, dst) of vertices whose sets have a similarity of at least ``least``."""

    @F.pandas_udf("binary")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width)).tobytes() for t in texts])

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both * least.denominator >= least.numerator * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    pairs, info = _sketched(pairs, classes)
    pairs = stored(pairs.where(_may_be_alike("a", "b", least)).select("src", "dst"))
    if pairs.isEmpty():
        return pairs
    keys = stored(info.join(_ends(pairs), "vertex").select("vertex", F.col("least.doc_id").alias("k_doc"), F.col("least.text_key").alias("k_text")))
    found = listed(documents.select("doc_id", "text"), keys, "inner").groupBy("vertex").agg(F.min("text").alias("text"))
    sets = stored(found.select("vertex", set_of(text_of()).alias("s")))
    sides = [sets.select(F.col("vertex").alias(c), F.col("s").alias(f"{c}_set")) for c in ("src", "dst")]
    return stored(pairs.join(sides[0], "src").join(sides[1], "dst").where(near("src_set", "dst_set")).select("src", "dst"))


def prefixes_of(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(vertex, prefix), one row a vertex. If few sets have copies, only the rows of these are sent to be made one."""
    rows = sets.select("vertex", "prefix")
    copied = classes.where("copies > 1").select("vertex")
    if copied.limit(FEW_KEYS + 1).count() > FEW_KEYS:
        return rows.groupBy("vertex").agg(F.first("prefix").alias("prefix"))
    again = rows.join(F.broadcast(copied), "vertex", "left_semi").groupBy("vertex").agg(F.first("prefix").alias("prefix"))
    return rows.join(F.broadcast(copied), "vertex", "left_anti").union(again)


def shared_elements(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, vertex, place, many) of the prefix elements that two or more sets have, stored.

    Elements with the same sets are one row a set: the least place, and how many they are. Such elements come in the same
    order in all of their sets, so the least place is the first common one for every pair of them.
    """
    tokens = prefixes_of(sets, classes).select("vertex", F.posexplode("prefix").alias("place", "token"))
    group = Window.partitionBy("token")
    own = [F.bit_xor(F.xxhash64("vertex", F.lit(seed))).over(group).alias(name) for seed, name in ((1, "one"), (2, "two"))]
    posted = tokens.select("vertex", "place", F.count("*").over(group).alias("n"), *own).where("n > 1")
    kept = posted.groupBy("one", "two", "vertex").agg(F.min("place").alias("place"), F.count("*").alias("many"))
    return stored(kept.select(F.xxhash64("one", "two").alias("token"), "vertex", "place", "many"))


def _enough(x: str, y: str, least: Fraction) -> Column:
    """Whether what two sets can share from an element on (size_x, place_x, ...), which is their first common one, is what they must share."""
    most = F.least(F.col(f"size_{x}") - F.col(f"place_{x}"), F.col(f"size_{y}") - F.col(f"place_{y}"))
    return most * (least.numerator + least.denominator) >= (F.col(f"size_{x}") + F.col(f"size_{y}")) * least.numerator


def weighed(posted: DataFrame, classes: DataFrame) -> DataFrame:
    """``posted`` with each set's size and weight, the part of it that is shared, stored."""
    weight = posted.groupBy("vertex").agg(F.sum("many").alias("shared")).join(classes.select("vertex", "size"), "vertex").select("vertex", "size", (F.col("shared") / F.col("size")).alias("weight"))
    return stored(posted.select("token", "vertex", "place").join(weight, "vertex"))


def labelled(rows: DataFrame, member: DataFrame) -> DataFrame:
    """``rows`` with the group of each vertex as ``c``: its component, or itself."""
    return rows.join(few(member), "vertex", "left").withColumn("c", F.coalesce("component", "vertex")).drop("component")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the elements that sets of several groups share, with the group that most of them are in."""
    by_group = rows.groupBy("token", "c").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("groups"), F.max(F.struct("n", "c"))["c"].alias("most"))
    return rows.join(by_group.where("groups > 1").select("token", "most"), "token")


def leading_pairs(rows: DataFrame, least: Fraction, member: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (src, dst): for each shared element one set, and each other one that is not in its group.

    That is the set with the greatest weight; with groups, of those that are not in the element's largest one.
    """
    rows = rows.withColumn("c", F.col("vertex")) if member is None else _open(labelled(rows, member))
    some = rows if member is None else rows.where("c != most")
    leads = some.groupBy("token").agg(F.max(F.struct("weight", "vertex", "size", "place", "c")).alias("a")).select("token", F.col("a.vertex").alias("src"), F.col("a.size").alias("size_a"), F.col("a.place").alias("place_a"), F.col("a.c").alias("c_a"))
    others = rows.select("token", F.col("vertex").alias("dst"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), "c")
    return others.join(leads, "token").where((F.col("c") != F.col("c_a")) & _enough("a", "b", least)).select("src", "dst").distinct()


def open_pairs(rows: DataFrame, classes: DataFrame, member: DataFrame, least: Fraction) -> DataFrame:
    """Distinct pairs (src, dst, apart) of sets in different groups that share an element and may be alike.

    Each element's largest group is met by the sets of its others only, so that a large group costs no pairs inside. The join by
    element, in which a set has a row for each of its elements, carries short sketches; whole ones are fetched for its pairs.
    """
    short = classes.select("vertex", short_sketch(F.col("sketch"), F.col("size")).alias("sketch"))
    rest = stored(_open(labelled(rows, member)).join(short, "vertex"))
    names = ("vertex", "place", "c", "size", "sketch")
    a, b = (x.select("token", *(F.col(n).alias(f"{n}_{side}") for n in names)) for x, side in ((rest.where("c != most"), "a"), (rest, "b")))
    crossed = a.join(b, "token").where((F.col("c_a") != F.col("c_b")) & _enough("a", "b", least) & _may_be_alike("a", "b", least))
    pairs, _ = _sketched(stored(crossed.select(F.least("vertex_a", "vertex_b").alias("src"), F.greatest("vertex_a", "vertex_b").alias("dst")).distinct()), classes)
    apart = _bits_apart(F.col("sketch_a"), F.col("sketch_b")) / (F.col("size_a") + F.col("size_b"))
    return stored(pairs.where(_may_be_alike("a", "b", least)).select("src", "dst", apart.alias("apart")))


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs with their groups (src, dst, apart, c_src, c_dst) the nearest one of each group."""
    pair = F.min(F.struct("apart", "src", "dst")).alias("p")
    return pairs.select(F.col("c_src").alias("c"), "apart", "src", "dst").union(pairs.select("c_dst", "apart", "src", "dst")).groupBy("c").agg(pair).select("p.src", "p.dst").distinct()


def _across(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """The pairs whose ends are in different groups, with these groups, stored."""
    for end in ("src", "dst"):
        pairs = pairs.join(few(member.select(F.col("vertex").alias(end), F.col("component").alias(f"c_{end}"))), end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    return stored(pairs.where("c_src != c_dst"))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row per vertex, stored, with its number of rows as ``copies`` and the first of its documents as ``least``: doc_id, null last, then text_key."""
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    # All else follows from the vertex, so any of its rows has the same.
    return stored(sets.groupBy("vertex").agg(F.count("*").alias("copies"), F.min(first).alias("least"), *(F.first(c).alias(c) for c in ("size", "prints", "sketch"))))


def first_of_groups(sets: DataFrame, classes: DataFrame, proposed: DataFrame, documents: DataFrame, width: int, least: Fraction) -> DataFrame:
    """(vertex, best): of each set's group the first document, a struct of doc_id and text_key.

    Groups are the components of the graph of all pairs of sets with a similarity of at least ``least``. Pairs (src, dst)
    that are proposed are compared beside those that the prefix filter finds.
    """
    rows = weighed(shared_elements(sets, classes), classes)
    candidates = proposed.union(leading_pairs(rows, least)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = alike(candidates, classes, documents, width, least)
    member = cut(connected_components(edges))

    def join(pairs: DataFrame) -> bool:
        """Compare the pairs; whether any is alike."""
        nonlocal edges, member
        found = alike(pairs, classes, documents, width, least)
        if found.isEmpty():
            return False
        edges = edges.union(found)
        member = cut(connected_components(edges))
        return True

    for _ in range(LEADERS):
        if not join(leading_pairs(rows, least, member)):
            break
    pairs, turns = _across(open_pairs(rows, classes, member, least), member), 0
    while not pairs.isEmpty():
        chosen = stored(nearest_pairs(pairs) if turns < NEAREST else pairs.select("src", "dst"))
        join(chosen)
        pairs, turns = _across(pairs.select("src", "dst", "apart").join(chosen, ["src", "dst"], "left_anti"), member), turns + 1
    placed = classes.select("vertex", "least").join(member, "vertex", "left").select("vertex", "least", F.coalesce("component", "vertex").alias("component"))
    return placed.join(placed.groupBy("component").agg(F.min("least").alias("best")), "component").select("vertex", "best")
