"""String functions: built-in expressions where there are any, Arrow-batched kernels for the rest.

Strings are code points. Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kernel(f: Callable, returns: T.DataType):
    """A column function of a plain Python one, in Arrow batches; null if any argument is null."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

    return run


def soundex(s: Column) -> Column:
    """American Soundex; null unless the text begins with a letter."""
    return F.when(s.rlike("^[A-Za-z]"), F.soundex(s))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are alike."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def within_distance(a: Column, b: Column, most: int) -> Column:
    """Whether the distance is at most ``most``; stops counting beyond it."""
    return F.levenshtein(a, b, most) >= 0


def canonical(s: Column, ignore_case_and_spaces: bool = False) -> Column:
    """Letters in order: anagrams share it."""
    base = F.regexp_replace(F.lower(s), r"\s", "") if ignore_case_and_spaces else s
    return F.array_join(F.array_sort(F.split(base, "")), "")


def positions(s: Column, pattern: str | Column) -> Column:
    """All places (from 0) where the pattern begins, overlapping ones too; none for an empty pattern."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    last = F.char_length(s) - F.char_length(p)
    places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return F.when((last < 0) | (F.char_length(p) == 0), F.array().cast("array<int>")).otherwise(F.filter(places, lambda i: F.substring(s, i + 1, F.char_length(p)) == p))


def find_first(s: Column, pattern: str) -> Column:
    """First place from 0, or null."""
    return F.when(F.instr(s, pattern) > 0, F.instr(s, pattern) - 1)


def glob_pattern(glob: str) -> str:
    """A regular expression for ``*``, ``?``, ``[a-z]``, ``[^a-z]`` and backslash escapes, anchored at both ends."""
    import re

    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2 if glob[i : i + 1] == "^" else i + 1)) > 0:
            body = glob[i:end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            safe = body.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&")
            out.append(f"[{'^' if negated else ''}{safe}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def glob_match(s: Column, glob: str, ignore_case: bool = False) -> Column:
    return s.rlike(("(?i)" if ignore_case else "") + glob_pattern(glob))


def run_length_encode(s: Column) -> Column:
    """``aaab`` -> ``3a1b``; the count is always written."""
    runs = F.regexp_extract_all(s, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.char_length(r).cast("string"), F.substring(r, 1, 1))), "")


def run_length_decode(s: Column) -> Column:
    """Inverse for texts without digits."""
    parts = F.regexp_extract_all(s, F.lit(r"(?s)(\d+\D)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.repeat(F.substring(p, -1, 1), F.regexp_extract(p, r"^(\d+)", 1).cast("int"))), "")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two texts."""
    n = F.least(F.char_length(a), F.char_length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    return F.when(n == 0, "").otherwise(F.substring(a, F.lit(1), F.when(F.size(differ) > 0, differ[0] - 1).otherwise(n)))


def reverse_complement(dna: Column) -> Column:
    return F.translate(F.reverse(dna), "ACGTacgt", "TGCAtgca")


def gc_content(dna: Column) -> Column:
    n = F.char_length(dna)
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(dna, F.lit("[GCgc]")) / F.greatest(n, F.lit(1)))


def splice(s: Column, at: int, inserted: str) -> Column:
    """Text with ``inserted`` put in at a place from 0."""
    return F.concat(F.substring(s, 1, at), F.lit(inserted), F.expr("''") if at < 0 else F.substr(s, F.lit(at + 1)))


# Kernels. Each is a plain function of one row.
def jaro_of(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(matched, other)) // 2
    m = len(matched)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str, scale: float = 0.1) -> float:
    base, prefix = jaro_of(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return base + prefix * scale * (1 - base)


def osa_of(a: str, b: str) -> int:
    """Edits and swaps of neighbours, none of them edited again."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before2, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before2[j - 2] + 1)
            row.append(best)
    return row[-1]


def lcs_length_of(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def common_substring_of(a: str, b: str) -> str:
    best, end, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else 0
            if row[j] > best:
                best, end = row[j], i
    return a[end - best : end]


def longest_palindrome_of(s: str) -> str:
    """The first of the longest, by Manacher's radii."""
    t = "\0".join(f"\1{s}\2")
    radius, centre, right = [0] * len(t), 0, 0
    for i in range(1, len(t) - 1):
        r = min(right - i, radius[2 * centre - i]) if i < right else 0
        while t[i + r + 1] == t[i - r - 1]:
            r += 1
            if i - r - 1 < 0 or i + r + 1 >= len(t):
                break
        radius[i] = r
        if i + r > right:
            centre, right = i, i + r
    best = max(range(len(t)), key=lambda i: (radius[i], -i))
    return t[best - radius[best] : best + radius[best] + 1].replace("\0", "").strip("\1\2")


def smith_waterman_of(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], max(0, corner + (match if x == y else mismatch), row[j] + gap, row[j - 1] + gap)
            best = max(best, row[j])
    return best


def needleman_wunsch_of(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> int:
    row = [gap * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], gap * i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], max(corner + (match if x == y else mismatch), row[j] + gap, row[j - 1] + gap)
    return row[-1]


def z_array_of(s: str) -> list[int]:
    z, left, right = [0] * len(s), 0, 0
    for i in range(1, len(s)):
        if i < right:
            z[i] = min(right - i, z[i - left])
        while i + z[i] < len(s) and s[z[i]] == s[i + z[i]]:
            z[i] += 1
        if i + z[i] > right:
            left, right = i, i + z[i]
    return z


def suffix_array_of(s: str) -> list[int]:
    """Places of the suffixes in order, by doubling."""
    rank, k = [ord(c) for c in s], 1
    order = list(range(len(s)))
    while s:
        key = lambda i: (rank[i], rank[i + k] if i + k < len(s) else -1)  # noqa: B023, E731
        order.sort(key=key)
        fresh = [0] * len(s)
        for a, b in zip(order, order[1:]):
            fresh[b] = fresh[a] + (key(a) != key(b))
        rank, k = fresh, 2 * k
        if rank[order[-1]] == len(s) - 1:
            break
    return order


def longest_repeat_of(s: str) -> str:
    order, best, at = suffix_array_of(s), 0, 0
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        if n > best:
            best, at = n, a
    return s[at : at + best]


def distinct_substrings_of(s: str) -> int:
    order, total = suffix_array_of(s), len(s) * (len(s) + 1) // 2
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        total -= n
    return total


def lzw_encode_of(s: str) -> list[int]:
    """Codes over the UTF-8 bytes; codes from 256 are learned."""
    table, out, now = {bytes([i]): i for i in range(256)}, [], b""
    for byte in s.encode():
        if (longer := now + bytes([byte])) in table:
            now = longer
        else:
            out.append(table[now])
            table[longer] = len(table)
            now = bytes([byte])
    return out + ([table[now]] if now else [])


def lzw_decode_of(codes: list[int]) -> str:
    table = {i: bytes([i]) for i in range(256)}
    out, before = [], b""
    for code in codes:
        entry = table[code] if code in table else before + before[:1]
        if before:
            table[len(table)] = before + entry[:1]
        out.append(entry)
        before = entry
    return b"".join(out).decode()


def huffman_lengths_of(s: str) -> dict[str, int]:
    """Bits of each letter in a Huffman code."""
    import heapq
    from collections import Counter

    heap = [(n, i, [c]) for i, (c, n) in enumerate(sorted(Counter(s).items()))]
    bits = {c: 0 for *_, (c,) in heap}
    if len(heap) == 1:
        return {heap[0][2][0]: 1}
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for c in a + b:
            bits[c] += 1
        heapq.heappush(heap, (n + m, k, a + b))
        k += 1
    return bits


jaro = lambda a, b: kernel(jaro_of, T.DoubleType())(a, b)
jaro_winkler = lambda a, b: kernel(jaro_winkler_of, T.DoubleType())(a, b)
osa_distance = lambda a, b: kernel(osa_of, T.LongType())(a, b)
lcs_length = lambda a, b: kernel(lcs_length_of, T.LongType())(a, b)
longest_common_substring = lambda a, b: kernel(common_substring_of, T.StringType())(a, b)
longest_palindrome = lambda s: kernel(longest_palindrome_of, T.StringType())(s)
smith_waterman = lambda a, b: kernel(smith_waterman_of, T.LongType())(a, b)
needleman_wunsch = lambda a, b: kernel(needleman_wunsch_of, T.LongType())(a, b)
z_array = lambda s: kernel(z_array_of, T.ArrayType(T.IntegerType()))(s)
suffix_array = lambda s: kernel(suffix_array_of, T.ArrayType(T.IntegerType()))(s)
longest_repeat = lambda s: kernel(longest_repeat_of, T.StringType())(s)
distinct_substrings = lambda s: kernel(distinct_substrings_of, T.LongType())(s)
lzw_encode = lambda s: kernel(lzw_encode_of, T.ArrayType(T.IntegerType()))(s)
lzw_decode = lambda c: kernel(lambda x: lzw_decode_of(list(x)), T.StringType())(c)
