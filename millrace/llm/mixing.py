"""Mixing sources to target weights with hash-threshold histograms.

Tokens are summed by source and hash bucket. The bucket in which a source's budget ends is found from running sums,
only that bucket is split again, and so on down to single hash values. A document is then taken if its hash is under
its source's threshold: no sort of documents, and a smaller budget always takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh, key_hash, text_of, word_count
from millrace.plans.storage import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
HASH_BITS, STEP_BITS = 60, 15
#: Sources up to which their rules are broadcast; with more, documents are joined by source.
FEW_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Targets are proportional to weight, at most ``most`` times the source's size; what is above goes to the others
    by weight. With sources in order of most * size / weight, the first k are at their bound for the least k at which
    the level of the rest does not pass the next source's bound: running sums find it without a loop.
    """
    every = Window.partitionBy()
    weigh = F.element_at(F.array(*(F.lit(w).cast("double") for w in weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weigh).withColumn("bound", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return rows.withColumn("target", F.least("bound", F.coalesce(settled, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "weight", "target")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, cutoff, tied, more): whole copies of every document, one more if its hash is under the cutoff.

    ``sized`` has source, size and h (60 bits). Of the ``tied`` rows whose hash is the cutoff, at which the budget is
    passed, ``more`` get one more: as many as come nearest to the budget, the fewer of two. Rows of one hash are the same
    document repeated, and so of one size.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("used"))
    docs = sized.select(F.col("source").alias("s"), "size", "h")
    step = F.lit(1 << STEP_BITS).cast("long")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = docs.join(state.select(F.col("source").alias("ks"), "prefix"), F.col("s").eqNullSafe(F.col("ks")) & (F.shiftright("h", shift + STEP_BITS) == F.col("prefix")))
        sums = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("inside"), F.count("*").alias("rows"))
        running = sums.withColumn("upto", F.sum("inside").over(Window.partitionBy("s").orderBy("bucket")))
        joined = running.join(state, F.col("s").eqNullSafe(F.col("source")))
        crossing = joined.where(F.col("used") + F.col("upto") > F.col("budget")).groupBy("s").agg(F.min(F.struct("bucket", "upto", "inside", "rows")).alias("edge"))
        edge, base = F.col("edge"), F.col("used")
        state = state.join(crossing, F.col("source").eqNullSafe(F.col("s")), "left").select(
            *(c for c in state.columns if c not in ("prefix", "used")),
            F.coalesce(edge["bucket"], (F.col("prefix") + 1) * step).alias("prefix"),
            F.when(edge.isNotNull(), base + edge["upto"] - edge["inside"]).otherwise(base).alias("used"),
            edge["inside"].alias("last"),
            edge["rows"].alias("rows"),
        )
        state = cut(state.drop("last", "rows") if shift else state)
    wanted = F.ceil((F.col("budget") - F.col("used")) * F.col("rows") / F.col("last") - F.lit(0.5))
    more = F.coalesce(F.greatest(F.lit(0), F.least(F.col("rows"), wanted)), F.lit(0)).cast("long")
    return state.select("source", "source_size", "target", "copies", F.col("prefix").alias("cutoff"), F.coalesce("rows", F.lit(0)).alias("tied"), more.alias("more"))


def document_hash() -> Column:
    """60 bits of an MD5 over doc_id and text: rows that share it are the same document repeated."""
    return key_hash("doc_id", text_of())


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, h), computed once and kept in the checkpoint folder."""
    return cut(documents.select("doc_id", "source", word_count(text_of()).alias("size"), document_hash().alias("h")))


def plan_mix(sized: DataFrame) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return cut(thresholds(sized, cut(source_targets(sizes))))


RULE = ("source", "source_size", "target", "copies", "cutoff", "tied", "more")


def _with_rule(documents: DataFrame, plan: DataFrame, h: str) -> tuple[DataFrame, dict[str, Column]]:
    """``documents`` joined with its source's rule, and the rule's columns, whose names do not clash.

    ``sure`` is how often a row is taken whatever happens, and ``open`` whether it is one of several tied rows of which
    only some are taken once more.
    """
    name = dict(zip(RULE, fresh(documents, *(f"_{c}" for c in RULE))))
    rule = plan.select(*(F.col(c).alias(name[c]) for c in RULE))
    if plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        rule = F.broadcast(rule)
    rows = documents.join(rule, documents["source"].eqNullSafe(F.col(name["source"])), "left")
    c = {k: F.col(v) for k, v in name.items()}
    at_cutoff = F.col(h) == c["cutoff"]
    sure = c["copies"] + F.when((F.col(h) < c["cutoff"]) | at_cutoff & (c["more"] == c["tied"]), 1).otherwise(0)
    return rows, c | {"sure": sure, "open": at_cutoff & (c["more"] > 0) & (c["more"] < c["tied"])}


def mix_table(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null texts have no words; documents of a null source form a source of their own, the last. Rows of the same doc_id and
    text share their hash; where the budget ends among them, as many are taken as come nearest to it. Where there are no
    words at all every target is 0. An empty table gives no rows; other columns are ignored.
    """
    sized = sized_documents(documents)
    rows, c = _with_rule(sized, plan_mix(sized), "h")
    out = ("doc_id", "size", c["source_size"].alias("source_size"), c["target"].alias("target"))
    settled = rows.where(~F.coalesce(c["open"], F.lit(False))).select(*out, (F.col("size") * c["sure"]).alias("taken"))
    # Tied rows are all the same: they are counted, and the count is dealt out again.
    tied = rows.where(c["open"]).groupBy(*out, c["sure"].alias("sure"), c["more"].alias("more")).agg(F.count("*").alias("n"))
    each = tied.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    dealt = each.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("sure") + (F.col("nth") <= F.col("more")).cast("int"))).alias("taken"))
    return settled.unionByName(dealt)


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``documents``: rows are repeated, kept once or left out.

    As in mix_table, but of tied rows the taken ones are spread over the table by their place in it: their number is that
    of mix_table but for one or so in each partition.
    """
    plan = plan_mix(sized_documents(documents))
    h, copy, at = fresh(documents, "_h", "_copy", "_at")
    rows, c = _with_rule(documents.withColumn(h, document_hash()).withColumn(at, F.monotonically_increasing_id()), plan, h)
    place = F.when(c["tied"] > 0, F.pmod(F.col(at), c["tied"]))
    spread = F.floor((place + 1) * c["more"] / c["tied"]) - F.floor(place * c["more"] / c["tied"])
    times = c["sure"] + F.when(c["open"], spread).otherwise(0)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*(f"`{x}`" for x in documents.columns))
