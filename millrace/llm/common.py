"""What several operators share: word rules and column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words_of(text: Column) -> Column:
    """All words in order. Only the ends of a split can be empty, and array_remove drops those."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def key_hash(*columns: str | Column) -> Column:
    """60 bits of an MD5 over the columns' text; SQL engines other than Spark can compute it too."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", *parts)), 1, 15), 16, 10).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
