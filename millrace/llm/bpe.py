"""Token counts by byte-pair merging with a heap over a linked list.

A word of n symbols that takes m merges has n - m tokens, so merging needs no identifiers of tokens. Texts are cut into words
here if their characters have not changed since an early version of Unicode, so that all tables agree on them; the
tokenizer file's own normalizer and splitter, as the library runs them, cut the others, and all texts if the file's rules
are not the known ones.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import text_of

#: White space of Unicode, as the file's patterns mean it; Python's own class also has U+001C to U+001F.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The words of the tokenizer file's split pattern.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
END = "</w>"
#: The rules of a tokenizer file that the pattern above stands for (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
CACHE = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def changed_characters() -> str:
    """A pattern for characters that Unicode 3.2 lacks or classes in another way: tables of later versions may differ on them."""
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    same = [old(chr(c)) == new(chr(c)) != "Cn" and not 0xD800 <= c < 0xE000 for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(1, len(same)) if same[c] != same[c - 1]]
    spans = [(lo, hi - 1) for lo, hi in zip([0, *edges], [*edges, len(same)]) if not same[lo]]
    return "[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in spans) + "]"


class MergeTable:
    """Ranks of symbol pairs. Symbols are numbered in the order in which they appear."""

    def __init__(self, merges: list[tuple[str, str]], special: list[str], end: str = END, known: bool = True, file: str = ""):
        number: dict[str, int] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        letters = byte_letters()
        for letter in letters + [x + end for x in letters]:
            number.setdefault(letter, len(number))
        for i, (a, b) in enumerate(merges):
            x, y, z = (number.setdefault(s, len(number)) for s in (a, b, a + b))
            self.rank.setdefault((x, y), (i, z))
        self.inner, self.last = [number[x] for x in letters], [number[x + end] for x in letters]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known, self.file, self.changed = known, file, re.compile(changed_characters())

    @classmethod
    def load(cls, path: str) -> MergeTable:
        """From a tokenizer file: byte-level pairs with special strings that match as they are. Other kinds are errors."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        file = json.loads(text)
        model, splitter = file["model"], file["pre_tokenizer"] or {}
        steps = splitter.get("pretokenizers", [splitter])
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or not steps or steps[-1].get("type") != "ByteLevel":
            raise ValueError(f"not a byte-level pair tokenizer of the plain kind: {odd or steps}")
        if plain := [t["content"] for t in file["added_tokens"] if not t["special"] or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]:
            raise ValueError(f"added tokens that are no plain special strings: {plain}")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(pairs, [t["content"] for t in file["added_tokens"]], model.get("end_of_word_suffix") or "", file["normalizer"] == NORMALIZER and splitter == SPLITTER, text)

    @classmethod
    def of(cls, fields: dict) -> MergeTable:
        table = cls.__new__(cls)
        vars(table).update(fields)
        return table

    def words(self, part: str) -> list[str]:
        """The words of a text without special strings."""
        if self.known and (part.isascii() or self.changed.search(part) is None):
            return PIECES.findall(_lower(unicodedata.normalize("NFC", part)))
        if not hasattr(self, "library"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file)
            self.bytes = {letter: b for b, letter in enumerate(byte_letters())}
        normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
        return [bytes(map(self.bytes.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def count_word(self, word: str) -> int:
        """Tokens of one word: initial symbols less merges."""
        data = word.encode("utf-8", "surrogateescape")
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.last[data[-1]]
        n, rank = len(symbol), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found[0], i) for i in range(n - 1) if (found := rank.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            lowest, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbol[i] < 0:
                continue
            found = rank.get((symbol[i], symbol[j]))
            if found is None or found[0] != lowest:
                continue
            merges += 1
            symbol[i], symbol[j] = found[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if right := rank.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, (right[0], i))
            if (h := before[i]) >= 0 and (left := rank.get((symbol[h], symbol[i]))):
                heapq.heappush(heap, (left[0], h))
        return n - merges


class WordCounts(dict):
    """Counts of words met so far; emptied between batches once it is large, so memory stays bounded."""

    def __init__(self, table: MergeTable):
        self.table = table

    def __missing__(self, word: str) -> int:
        n = self.table.count_word(word)
        if len(word) < 200:
            self[word] = n
        return n


def _lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is an ordinary one."""
    return text.replace("Σ", "σ").lower()


def count_text(counts: WordCounts, text: str) -> int:
    """Tokens of a text; each special string in it is one token, and what lies between is tokenized by itself."""
    total, parts = 0, [text]
    if counts.table.special is not None:
        parts = counts.table.special.split(text)
        total = len(parts) - 1
    return total + sum(sum(map(counts.__getitem__, counts.table.words(part))) for part in parts)


def token_counter(spark, path: str):
    """A column function text -> tokens. The file is read on the driver; its merges, bounded by the file, are broadcast."""
    table = spark.sparkContext.broadcast(vars(MergeTable.load(path)))
    held: dict[int, WordCounts] = {}

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        if 0 not in held:
            held[0] = WordCounts(MergeTable.of(table.value))
        counts = held[0]
        if len(counts) > CACHE:
            counts.clear()
        return texts.map(lambda t: count_text(counts, t or "")).astype("int64")

    return count


def token_counts(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document with its UTF-8 bytes and tokens, and whether these exceed ``limit``.

    Null texts are empty and have none of either; texts are counted whole, however long. Repeated rows stay, an empty table
    gives no rows, and other columns are ignored.
    """
    count = token_counter(documents.sparkSession, path)
    rows = documents.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), count(text_of()).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
