"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation becomes a row of segments, each with a loss flag; the formatted string is their concatenation.
Strings that steer the model are escaped inside texts and roles, so the string can be read back without loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, seg_no long, kind string, text string, loss boolean, role string, problem string"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, problem string"
#: Rows of an Arrow batch on the way out.
BATCH = 4096


@dataclass(frozen=True)
class Template:
    """What a turn looks like, who may speak when, and whose text is learned.

    ``turn`` lists segments: "{role}" and "{text}" stand for the turn's, anything else for itself.
    ``moves`` maps (state, role) to the next state; a conversation may end in the states of ``final``.
    """

    turn: tuple[str, ...] = ("<|turn|>", "{role}", "<|say|>", "{text}", "<|end|>")
    learned: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict = field(default_factory=lambda: {("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: frozenset[str] = frozenset({"answered"})
    #: Strings that must not appear inside a text. Each begins with a character that is no escape code.
    control: tuple[str, ...] = ("<|turn|>", "<|say|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "␛"

    def __post_init__(self):
        marks = [s for s in self.turn if s not in ("{role}", "{text}")]
        if self.turn.count("{role}") != 1 or self.turn.count("{text}") != 1 or not set(marks) <= set(self.control):
            raise ValueError("a turn needs its role and text once, and every mark among the control strings")
        if any(not c or c[0].isalnum() or self.escape in c for c in self.control) or len(self.control) > 35:
            raise ValueError("control strings begin with no letter or digit and lack the escape")

    def codes(self) -> dict[str, str]:
        return {self.escape: "0"} | {c: "123456789abcdefghijklmnopqrstuvwxyz"[i] for i, c in enumerate(self.control)}


class Codec:
    """Escapes and unescapes; ``unescape(escape(s)) == s`` for every string, and escape(s) holds no control string."""

    def __init__(self, template: Template):
        self.template, self.codes = template, template.codes()
        self.plain = {code: what for what, code in self.codes.items()}
        self.found = re.compile("|".join(map(re.escape, sorted(self.codes, key=len, reverse=True))))
        self.coded = re.compile(re.escape(template.escape) + "(.)", re.S)

    def escape(self, text: str) -> str:
        return self.found.sub(lambda m: self.template.escape + self.codes[m[0]], text)

    def unescape(self, text: str) -> str:
        return self.coded.sub(lambda m: self.plain[m[1]], text)


def segments_of(template: Template, codec: Codec, role: str, text: str) -> list[tuple[str, str, bool]]:
    """(kind, text, loss) of one turn."""
    out = []
    for part in template.turn:
        if part == "{role}":
            out.append(("role", codec.escape(role), False))
        elif part == "{text}":
            out.append(("text", codec.escape(text), role in template.learned))
        else:
            out.append(("mark", part, False))
    return out


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    held, room = [], 0
    for row in rows:
        held.append(row)
        room += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or room > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, room = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _formatter(template: Template):
    kinds = pa.schema([("conv_id", pa.int64()), ("seg_no", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("role", pa.string()), ("problem", pa.string())])

    def rows(batches):
        codec, now, state, n = Codec(template), object(), None, 0
        for conv, role, text in _rows(batches):
            if conv != now:
                if n:
                    yield now, n, "end", "", False, None, None if state in template.final else f"ends in state {state}"
                now, state, n = conv, template.start, 0
            step = template.moves.get((state, role))
            problem = None if step else f"{role!r} in state {state}"
            state = step or state
            for kind, part, loss in segments_of(template, codec, role or "", text):
                yield conv, n, kind, part, loss, role, problem
                n, problem = n + 1, None
        if n:
            yield now, n, "end", "", False, None, None if state in template.final else f"ends in state {state}"

    return lambda batches: _batches(rows(batches), kinds)


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments in order: conv_id, seg_no, kind (mark, role, text, end), text, loss, role, problem.

    Turns are ordered by turn, then role, then text, so ties and repeated rows have one defined order; null turns come
    first, null texts are empty, a null role reads as an empty one. Turns out of order are formatted all the same, and
    the first segment of such a turn (or the empty "end" segment) says what is wrong. Rows with a null conv_id are one
    conversation. An empty table gives no segments; other columns are ignored. One conversation is streamed through
    one task, of which a single turn is in memory at a time.
    """
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return order.select("conv_id", "role", "text").mapInArrow(_formatter(template), SEGMENTS)


def _reader(template: Template):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("problem", pa.string())])

    def rows(batches):
        codec = Codec(template)
        pattern = re.compile("".join("(.*?)" if p in ("{role}", "{text}") else re.escape(p) for p in template.turn), re.S)
        role_at, text_at = sorted(("{role}", "{text}"), key=template.turn.index).index("{role}") + 1, sorted(("{role}", "{text}"), key=template.turn.index).index("{text}") + 1
        last = len(template.turn)
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
        now, parts = fresh(), []
        for conv, kind, text, loss, problem in _rows(batches):
            now[5] = now[5] or problem
            if kind == "end":
                yield conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], now[5] is None, now[5]
                now, parts = fresh(), []
                continue
            parts.append(text)
            now[4] += len(text)
            if loss:
                said = codec.unescape(text)
                now[2] += len(said)
                now[3].update(said.encode())
            if len(parts) == last:
                m = pattern.fullmatch("".join(parts))
                now[0] += 1
                now[1].update(f"{codec.unescape(m[role_at])}\n{codec.unescape(m[text_at])}\n".encode())
                parts = []

    return lambda batches: _batches(rows(batches), schema)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, parsed from the formatted strings of format_conversations (in its order)."""
    return segments.select("conv_id", "kind", "text", "loss", "problem").mapInArrow(_reader(template), DIGESTS)
