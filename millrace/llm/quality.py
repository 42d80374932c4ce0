"""Quality rules as a short-circuit cascade.

What each rule costs and how much it rejects is measured on a sample, and rules run in the order of rejections per
cost: a document that a cheap, sharp rule rejects is never looked at by the dear ones. The order changes the cost
only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, let, text_of, words_of
from millrace.plans.storage import stored

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Rows, and characters of each, on which costs and rejections are estimated; the verdicts do not depend on them.
SAMPLE, SAMPLE_CHARS = 400, 20_000
#: Timed runs of a rule on the sample, and the least time in seconds that counts as its cost.
RUNS, LEAST_COST = 2, 0.002
#: Rules that the base verdict stands for.
BASE = {"few_words", "repeated_runs"}


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    """Characters of ``SYMBOLS``: one less than the parts between them."""
    return (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""

    def count(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    return let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)), count).cast("long")


def _window_hashes(words: Column) -> Column:
    """A hash of every run of 8 words, from the words' hashes, so that a word is not read 8 times."""

    def runs(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _covered(words: Column) -> Column:
    """Words inside runs of 8 that occur twice, compared as text."""
    last = F.size(words) - WINDOW
    runs = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("run"), i.alias("at"))))

    def twice(a: Column) -> Column:
        same = F.filter(a, lambda x, i: (F.get(a, i - 1)["run"] == x["run"]) | (F.get(a, i + 1)["run"] == x["run"]))
        return let(F.array_sort(F.transform(same, lambda x: x["at"])), reach)

    def reach(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda total, x: total + x)

    return let(runs, twice)


def n_repeat_words(words: Column) -> Column:
    """Words in runs of 8 that occur twice or more in the text, the first occurrence included.

    Hashes settle the documents in which all runs differ; only the others are compared as text.
    """
    again = let(_window_hashes(words), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) > WINDOW) & again, _covered(words)).otherwise(0).cast("long")


@dataclass(frozen=True)
class Rule:
    """A condition on a text that rejects it."""

    name: str
    rejects: Column


def counts(text: Column, words: Column) -> dict[str, Column]:
    """The counts that rules look at, as expressions over a text and its words."""
    return {"n_words": F.size(words).cast("long"), "word_chars": word_chars(words), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(words)}


def rules(text: Column, words: Column, counted: dict[str, Column] | None = None) -> list[Rule]:
    """Production rules, over counts that are columns already if given. Where a rule would divide, products are compared."""
    c = counted or counts(text, words)
    n = c["n_words"]
    letters = F.char_length(F.regexp_replace(text, r"[^\p{Lu}\p{Ll}]+", ""))
    capitals = F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return [
        Rule("few_words", n < 20),
        Rule("symbols", 10 * c["n_symbols"] > n),
        Rule("long_words", c["word_chars"] > 12 * n),
        Rule("short_words", 2 * c["word_chars"] < 5 * n),
        Rule("capitals", let(capitals, lambda x: (x > 0) & (2 * x > letters))),
        Rule("repeated_lines", let(lines, lambda a: let(F.size(a) - F.size(F.array_distinct(a)), lambda again: (again >= 3) & (10 * again > 3 * F.size(a))))),
        Rule("few_distinct_words", (n < 2000) & (5 * F.size(F.array_distinct(words)) < n)),
        Rule("repeated_runs", 100 * c["n_repeat_words"] > 30 * n),
    ]


def _seconds(sample: DataFrame, test: Column) -> tuple[float, int]:
    """The least time of some runs of a test over a table, and how many rows it holds for. The first run, which compiles, is not timed."""
    took, held = [], 0
    for _ in range(RUNS + 1):
        began = time.perf_counter()
        held = sample.agg(F.count_if(test)).first()[0]
        took.append(time.perf_counter() - began)
    return min(took[1:]), held


def order_by_yield(sample: DataFrame, given: list[Rule]) -> list[Rule]:
    """``given`` in the order of rejections per cost on a small table.

    A rule's cost is the time that it takes beyond a job that tests nothing, in steps of a factor of two, so that noise
    seldom changes the order. A rule that rejects nothing there comes last; the cheaper comes first, then the earlier.
    """
    nothing, _ = _seconds(sample, F.lit(False))
    scored = []
    for place, rule in enumerate(given):
        took, rejected = _seconds(sample, rule.rejects)
        cost = 2.0 ** round(math.log2(max(took - nothing, LEAST_COST)))
        scored.append((-rejected / cost, cost, place))
    return [given[place] for *_, place in sorted(scored)]


def cascade(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null. CASE tests a rule only if those before it did not reject."""
    out = None
    for rule in ordered:
        out = F.when(rule.rejects, rule.name) if out is None else out.when(rule.rejects, rule.name)
    return out


def _order(documents: DataFrame, text: str, given) -> list[str]:
    """Names of the rules in the order of their yield on a few rows, which are taken from as few partitions as have them."""
    rows = documents.select(F.left(text_of(text), F.lit(SAMPLE_CHARS)).alias("t")).sample(0.2, seed=5).take(SAMPLE)
    declared = given(F.col("t"), F.col("w"))
    if rows:
        words = documents.sparkSession.createDataFrame(rows, "t string").coalesce(1).withColumn("w", words_of(F.col("t")))
        declared = order_by_yield(stored(words), declared)
    return [r.name for r in declared]


def _verdict(documents: DataFrame, text: str, given, verdict) -> Column:
    """``verdict`` of (rules in measured order, rules as declared), with the words of each text split once."""
    order = _order(documents, text, given)

    def over(words: Column) -> Column:
        declared = given(text_of(text), words)
        by_name = {r.name: r for r in declared}
        return verdict([by_name[n] for n in order], declared)

    return let(words_of(text_of(text)), over)


def with_verdict(documents: DataFrame, text: str = "text", out: str = "rejected_by", given=rules) -> DataFrame:
    """``documents`` with the first rule, as they are declared, that rejects each; null for documents to keep.

    The cascade in the measured order settles which documents are rejected; the name of the rule is looked up for these
    only, so neither depends on the measurement. Null and empty texts have too few words; texts of any length are read
    whole. An empty table stays empty, repeated rows stay, other columns stay as they are; a column named ``out`` is an error.
    """
    if out.lower() in (c.lower() for c in documents.columns):
        raise ValueError(f"there is a column {out} already")
    return documents.withColumn(out, _verdict(documents, text, given, lambda ordered, declared: F.when(cascade(ordered).isNotNull(), cascade(declared))))


def kept_documents(documents: DataFrame, text: str = "text", given=rules) -> DataFrame:
    """The rows that no rule rejects, as they are (see with_verdict for null, empty and long texts and repeated rows)."""
    return documents.where(_verdict(documents, text, given, lambda ordered, declared: cascade(ordered)).isNull())


def quality_table(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, the four base counts, base_failed and kept.

    Repeated rows stay; null and empty texts have no words and fail; texts are read whole, however long. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    order = _order(documents, "text", rules)
    rows = documents.select("doc_id", text_of().alias("t")).withColumn("w", words_of(F.col("t")))
    table = rows.select("doc_id", "t", "w", *(c.alias(name) for name, c in counts(F.col("t"), F.col("w")).items()))
    table = table.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    own = {r.name: r for r in rules(F.col("t"), F.col("w"), {name: F.col(name) for name in counts(F.col("t"), F.col("w"))})}
    verdict = cascade([own[n] for n in order if n not in BASE])
    return table.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict.isNull())).drop("t", "w")
