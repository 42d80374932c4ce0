"""Toxicity from class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, are fitted by interpolated Kneser-Ney smoothing. Each backs off to
its class's continuation counts, and these to continuation counts shared by both classes. As in the modified form the
discount grows with the count: a class keeps what its count has beyond what the other class's rate accounts for, and
leaves the rest to the shared backoff, so that a rare expression which neither class explains better counts for neither.
A document's log-likelihood ratio, by length, is turned into a probability by a logistic curve fitted on labelled
documents that the models which score them have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of

#: Bounds of the labelled sample that models are fitted on, for each class: documents, and characters in all of them.
MAX_DOCS, MAX_CHARS = 4000, 6_000_000
THRESHOLD = 0.7
#: A count is discounted by so much, by so many times what the other class's rate makes of it, and by so many of its standard deviations.
DISCOUNT, TIMES, DEVIATIONS = 0.75, 2.0, 2.0
#: Parts of the labelled sample; the curve sees each part scored by models of the others.
FOLDS = 3
#: Hash of what precedes a document's first word.
START = np.int64(0)


def word_hashes(text: Column) -> Column:
    """XXH64 of each lower-cased run of letters, marks and digits, in order."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id's text leaves 1 when divided by 3. A null id's text is empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = (left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


class HashIndex:
    """Places of 64-bit keys in a sorted array, found through buckets of their leading bits without a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        self.starts = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each key, or len(keys) where it is missing."""
        out = np.full(len(wanted), len(self.keys), np.int64)
        bucket = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == wanted[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def _excess(own: np.ndarray, other: np.ndarray, own_total: np.ndarray, other_total: np.ndarray) -> np.ndarray:
    """What is left of counts after the discount. A count that the other class has not is taken for one there."""
    expected = own_total * (other + 1) / np.maximum(other_total, 1)
    return np.maximum(own - TIMES * expected - DEVIATIONS * np.sqrt(expected) - DISCOUNT, 0)


@dataclass
class Model:
    """Tables of the two smoothed models. Row len(keys) of each table stands for what was never seen."""

    words: np.ndarray
    word_p: np.ndarray  # (words + 1, 2): backoff probability in the toxic and the ordinary class
    context: np.ndarray  # (words + 1, 1): weight of the backoff after this word
    pairs: np.ndarray
    pair_p: np.ndarray  # (pairs + 1, 2): discounted bigram probability
    curve: np.ndarray  # of the logistic curve, see features()

    def evidence(self, tokens: np.ndarray, offsets: np.ndarray, words: HashIndex, pairs: HashIndex) -> np.ndarray:
        """Per document the sum of log p_toxic - log p_ordinary, and the number of words."""
        previous = np.empty_like(tokens)
        previous[1:] = tokens[:-1]
        previous[offsets[:-1][offsets[:-1] < len(tokens)]] = START
        p = self.pair_p[pairs.find(pair_key(previous, tokens))] + self.context[words.find(previous.view(np.uint64))] * self.word_p[words.find(tokens.view(np.uint64))]
        sums = np.r_[0.0, np.cumsum(np.log(p[:, 0]) - np.log(p[:, 1]))]
        return np.stack([sums[offsets[1:]] - sums[offsets[:-1]], np.diff(offsets)], axis=1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(evidence) @ self.curve, -50, 50)))


def features(evidence: np.ndarray) -> np.ndarray:
    """What the curve weighs: a constant, and the log ratio by length and by the root of length."""
    ratio, length = evidence.T
    length = np.maximum(length, 1)
    return np.stack([np.ones(len(evidence)), ratio / length, ratio / np.sqrt(length)], axis=1)


def _grams(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (previous, word) with the number of distinct words before the pair, so that copies of a text count once."""
    second = np.concatenate([START[None], *docs])[1:]
    begins = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(d)) for d in docs)])
    first = np.where(begins >= 1, np.roll(second, 1), START)
    before = np.where(begins >= 2, np.roll(second, 2), START)
    pair = pair_key(first, second)
    _, place = np.unique(pair_key(before, pair.view(np.int64)), return_index=True)
    _, at, counts = np.unique(pair[place], return_index=True, return_counts=True)
    return first[place[at]], second[place[at]], counts


def fit_models(classes: tuple[list[np.ndarray], list[np.ndarray]]) -> Model:
    """Kneser-Ney models of (toxic, ordinary) documents given as word hashes.

    A word's class probability comes from its continuation count, the number of distinct words before it, and is
    interpolated with the continuation counts of both classes together; a pair's comes from its own
    continuation count and is interpolated with the word's. Both classes give a backoff the same weight, the lesser of what their
    discounts leave, so that what neither class has in excess has a ratio of one, however much more text one class has;
    what is over in a class stands for words in neither vocabulary. Words and pairs without excess need no rows of their
    own for that reason.
    """
    grams = [_grams(docs) for docs in classes]
    words = np.unique(np.concatenate([np.r_[l, r] for l, r, _ in grams] + [np.array([START])]).view(np.uint64))
    size, index = len(words), HashIndex(words)
    places = [(index.find(l.view(np.uint64)), index.find(r.view(np.uint64))) for l, r, _ in grams]
    follows = [np.bincount(r, minlength=size).astype(float) for _, r in places]
    both = follows[0] + follows[1]
    total, kinds = max(1.0, both.sum()), max(1, int((both > 0).sum()))
    shared = np.r_[np.maximum(both - DISCOUNT, 0) / total, 0.0] + DISCOUNT * kinds / total / (size + 1)
    sums = [max(1.0, f.sum()) for f in follows]
    kept = [_excess(follows[c], follows[1 - c], sums[c], sums[1 - c]) / sums[c] for c in (0, 1)]
    backoff = 1 - max(k.sum() for k in kept)
    word_p = np.stack([np.r_[k, 0.0] + backoff * shared for k in kept], axis=1)
    keys = [pair_key(l, r) for l, r, _ in grams]
    pairs = np.unique(np.concatenate(keys))
    at = [np.searchsorted(pairs, k) for k in keys]
    left = np.zeros(len(pairs), np.int64)
    counts = np.zeros((2, len(pairs)))
    for c, ((l, _), place, (*_, n)) in enumerate(zip(places, at, grams)):
        left[place], counts[c, place] = l, n
    seen = [np.bincount(left, weights=n, minlength=size) for n in counts]
    pair_kept = [_excess(counts[c], counts[1 - c], seen[c][left], seen[1 - c][left]) for c in (0, 1)]
    pair_kept = [k / np.maximum(s, 1)[left] for k, s in zip(pair_kept, seen)]
    context = 1 - np.maximum(*(np.bincount(left, weights=k, minlength=size) for k in pair_kept))
    some = (pair_kept[0] > 0) | (pair_kept[1] > 0)
    needed = (kept[0] > 0) | (kept[1] > 0) | (context < 1)
    for (_, r), place in zip(places, at):
        needed[r[some[place]]] = True
    rows = np.r_[np.flatnonzero(needed), size]
    pair_p = np.r_[np.stack(pair_kept, axis=1)[some], np.zeros((1, 2))]
    return Model(words[needed], word_p[rows], np.r_[context, 1.0][rows][:, None], pairs[some], pair_p, np.zeros(3))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method; the mean of the labels where there is but one class."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.r_[np.log(rate / (1 - rate)), np.zeros(x.shape[1] - 1)]
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def labelled_sample(documents: DataFrame, labels: DataFrame, max_docs: int, max_chars: int) -> tuple[DataFrame, dict]:
    """Documents (doc_id, words) of the sample and their labels: per class the first ids by hash, within both bounds."""
    spark = documents.sparkSession
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    ids = [(r[0], r[1]) for label in (1, 0) for r in known.where(F.col("label") == label).select("doc_id", "label").orderBy(rank, "doc_id").limit(max_docs).collect()]
    schema = "doc_id long, label int"
    chosen = F.broadcast(spark.createDataFrame(ids, schema))  # at most 2 * max_docs rows
    sizes = {r[0]: r[1] for r in documents.join(chosen, "doc_id").groupBy("doc_id").agg(F.sum(F.char_length(text_of()).cast("long"))).collect()}
    kept, room = {}, {0: max_chars, 1: max_chars}
    for doc_id, label in ids:
        if doc_id in sizes and sizes[doc_id] <= room[label]:
            room[label] -= sizes[doc_id]
            kept[doc_id] = label
    chosen = F.broadcast(spark.createDataFrame(list(kept.items()), schema))
    return documents.join(chosen, "doc_id").select("doc_id", word_hashes(text_of()).alias("words")), kept


def _evidence_of(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(d) for d in docs], np.int64)
    return model.evidence(np.concatenate([np.empty(0, np.int64), *docs]), np.r_[0, np.cumsum(n)].astype(np.int64), HashIndex(model.words), HashIndex(model.pairs))


def fit_sample(docs: list[np.ndarray], label: np.ndarray, fold: np.ndarray) -> Model:
    """Models of all the documents; the curve is fitted to each part's evidence under models of the other parts."""

    def models(use: np.ndarray) -> Model:
        return fit_models(tuple([d for d, y, u in zip(docs, label, use) if u and y == c] for c in (1, 0)))

    found = np.zeros((len(docs), 2))
    for part in range(FOLDS):
        mine = np.flatnonzero(fold == part)
        if len(mine):
            found[mine] = _evidence_of(models(fold != part), [docs[i] for i in mine])
    model = models(np.ones(len(docs), bool))
    model.curve = fit_curve(features(found), label.astype(float))
    return model


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Models and curve from the labelled sample; its parts are dealt by hash of the id."""
    sample, label = labelled_sample(documents, labels, max_docs, max_chars)
    table = sample.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(FOLDS))).orderBy("doc_id", "words").toArrow()
    docs = [np.asarray(w.values.to_numpy(zero_copy_only=False), np.int64) for w in table["words"]]
    return fit_sample(docs, np.array([label[i] for i in table["doc_id"].to_pylist()], np.int64), table["fold"].to_numpy())


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        words, pairs = HashIndex(model.words), HashIndex(model.pairs)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            tokens = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.int64)
            offsets -= offsets[0]
            n = np.diff(offsets)
            found = np.zeros((len(n), 2))
            step = 1 << 20
            lo = 0
            while lo < len(n):  # about a million tokens at a time
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, side="right")) - 1)
                found[lo:hi] = model.evidence(tokens[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, pairs)
                lo = hi
            score = model.score(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(found[:, 0].copy()), pa.array(n)], names=["doc_id", "score", "log_ratio", "n_words"])

    return run


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, log_ratio and n_words of every row.

    Null and empty texts score what the curve gives for a ratio of zero. Repeated rows stay, null doc_ids too; an empty
    table gives no rows; other columns are ignored. The broadcast model is bounded by the sample that it was fitted on.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))
    words = documents.select("doc_id", word_hashes(text_of()).alias("words"))
    return words.mapInArrow(_scorer(shared), "doc_id long, score double, log_ratio double, n_words long")


def toxicity_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.7)."""
    rows = score_documents(documents, fit(documents, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
