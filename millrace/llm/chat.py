"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

The layout of a record is known by its nested field paths. They are written in one
canonical form (names sorted, types of single values left out) and hashed; the hash
selects a mapping from ``RECORDS`` or ``TABLES``. A mapping is data: the fields it is
for, and where role and text are found. A new layout needs a new entry and no code.

Canonical turns are written as

    ### role: text </turn>

one after another. Control strings inside texts are escaped, so a turn ends and
begins only where the template says so, and the text is read back exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

HEAD, COLON, END = "### ", ": ", " </turn>\n"

#: Control strings and what stands for them inside a text; the backslash comes first.
ESCAPES = (("\\", "\\b"), ("##", "\\d"), ("</", "\\s"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))

#: The role whose texts are learned from.
LEARNED = "assistant"

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Record:
    """A layout of one record per conversation: its fields, and the turns as SQL over the record ``r``."""

    name: str
    fields: str
    turns: str


@dataclass(frozen=True)
class Table:
    """A layout of one row per turn: its fields, and the columns of key, order, role and text."""

    name: str
    fields: str
    key: str
    order: str
    role: str
    text: str


def _pair(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


_ASKED = "concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))"
_SPOKEN = "transform({0}, m -> named_struct('role', {1}, 'text', m.{2}))"
_NAMED = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"

RECORDS = (
    Record("messages", "messages array<struct<role string, content string>>", _SPOKEN.format("r.messages", "m.role", "content")),
    Record("system and messages", "system string, messages array<struct<role string, content string>>",
           "concat(array(" + _pair("system", "r.system") + "), " + _SPOKEN.format("r.messages", "m.role", "content") + ")"),
    Record("conversations", "conversations array<struct<`from` string, value string>>",
           _SPOKEN.format("r.conversations", _NAMED, "value")),
    Record("instruction", "instruction string, output string",
           f"array({_pair('user', 'r.instruction')}, {_pair('assistant', 'r.output')})"),
    Record("instruction with input", "instruction string, input string, output string",
           f"array({_pair('user', _ASKED)}, {_pair('assistant', 'r.output')})"),
    Record("instruction with input and system", "system string, instruction string, input string, output string",
           f"array({_pair('system', 'r.system')}, {_pair('user', _ASKED)}, {_pair('assistant', 'r.output')})"),
    Record("prompt and completion", "prompt string, completion string",
           f"array({_pair('user', 'r.prompt')}, {_pair('assistant', 'r.completion')})"),
    Record("prompt and response", "prompt string, response string",
           f"array({_pair('user', 'r.prompt')}, {_pair('assistant', 'r.response')})"),
    Record("question and answer", "question string, answer string",
           f"array({_pair('user', 'r.question')}, {_pair('assistant', 'r.answer')})"),
)

TABLES = (
    Table("turn rows", "conv_id long, turn long, role string, text string", "conv_id", "turn", "role", "text"),
    Table("message rows", "conversation_id long, position long, role string, content string",
          "conversation_id", "position", "role", "content"),
    Table("utterances", "dialogue long, number long, speaker string, utterance string",
          "dialogue", "number", "speaker", "utterance"),
)


# --- fingerprints

def paths(kind: DataType, hollow: bool = False) -> str:
    """Nested field paths in canonical form; ``hollow``: as they look if every list is empty."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        inner = [(f.name, paths(f.dataType, hollow)) for f in fields]
        return "OBJECT<" + ", ".join(f"{n}: {p}" if p else n for n, p in inner) + ">"
    if isinstance(kind, ArrayType):
        return "ARRAY<" + ("" if hollow else paths(kind.elementType)) + ">"
    return ""


def fingerprint(form: Column) -> Column:
    """Hash of a canonical form, for each row."""
    return F.xxhash64(form)


def hashed(form: str) -> int:
    """Hash of the canonical form of a whole table."""
    return int.from_bytes(hashlib.blake2b(form.encode(), digest_size=8).digest())


def record_paths(record: Column) -> Column:
    """The same canonical form for a JSON text, row by row; null if it is no JSON."""
    known = F.schema_of_variant(F.try_parse_json(record))
    bare = F.regexp_replace(known, r": (DECIMAL\([0-9]+,[0-9]+\)|[A-Z_]+)(?=[,>])", "")
    return F.regexp_replace(bare, r"ARRAY<(DECIMAL\([0-9]+,[0-9]+\)|[A-Z_]+)>", "ARRAY<>")


# --- layouts to turns

def _clean(turns: Column) -> Column:
    """Null role or text as empty, null lists as no turns, null turns left out."""
    return F.transform(
        F.filter(F.coalesce(turns, F.array().cast(TURNS)), lambda t: t.isNotNull()),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def turns_of_records(rows: DataFrame, key: str, record: str, layouts: tuple[Record, ...] = RECORDS) -> DataFrame:
    """(key, layout, turns) of JSON records in any of the layouts, each by its own fingerprint.

    A record that fits no layout keeps its row, with a null layout and no turns.
    """
    found = rows.select(F.col(key), F.col(record).alias("record"), fingerprint(record_paths(F.col(record))).alias("print"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        kind = StructType.fromDDL(layout.fields)
        fits = F.col("print").isin(*(fingerprint(F.lit(paths(kind, hollow))) for hollow in (False, True)))
        # Bound to a lambda's variable the record is parsed once, however often its mapping names it.
        mapped = F.expr(f"transform(array(from_json(record, '{layout.fields}')), r -> {layout.turns})[0]").cast(TURNS)
        name, turns = F.when(fits, F.lit(layout.name)).otherwise(name), F.when(fits, mapped).otherwise(turns)
    return found.select(key, name.alias("layout"), _clean(turns).alias("turns"))


def turns_of_table(rows: DataFrame, layouts: tuple[Table, ...] = TABLES) -> DataFrame:
    """(key, layout, turns) of a table of turns: one row per key, turns in order.

    The table's fingerprint is that of its columns, so pass only those of the layout.
    Equal places are ordered by role and text; rows with a null key are one conversation.
    """
    prints = {hashed(paths(StructType.fromDDL(t.fields))): t for t in layouts}
    layout = prints.get(hashed(paths(rows.schema)))
    if layout is None:
        raise ValueError(f"no layout for the fields {paths(rows.schema)}")
    turn = F.struct(
        F.col(layout.order).alias("order"), F.coalesce(layout.role, F.lit("")).alias("role"),
        F.coalesce(layout.text, F.lit("")).alias("text"))
    grouped = rows.groupBy(layout.key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        layout.key, F.lit(layout.name).alias("layout"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


# --- the template

def _escaped(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescaped(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turns: Column) -> Column:
    """The conversation as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(HEAD), _escaped(t["role"], ROLE_ESCAPES), F.lit(COLON), _escaped(t["text"], ESCAPES), F.lit(END))), "")


def loss_mask(turns: Column) -> Column:
    """Code points of the formatted text to skip and then to take, turn by turn.

    What follows a taken stretch up to the end of its turn is not taken.
    """
    def entry(t: Column) -> Column:
        role, text = _escaped(t["role"], ROLE_ESCAPES), _escaped(t["text"], ESCAPES)
        skip = F.length(role) + len(HEAD) + len(COLON)
        return F.struct(skip.alias("skip"), F.when(t["role"] == LEARNED, F.length(text)).otherwise(0).alias("take"))

    return F.transform(turns, entry)


def _pieces(text: Column) -> Column:
    """The turns of a formatted text, still escaped; the template's end never occurs inside one."""
    parts = F.split(text, END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_back(text: Column) -> Column:
    """The turns, from the formatted text alone."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(HEAD) + 1)), COLON, 1)
        words = F.substr(piece, F.length(role) + len(HEAD) + len(COLON) + 1)
        return F.struct(_unescaped(role, ROLE_ESCAPES).alias("role"), _unescaped(words, ESCAPES).alias("text"))

    return F.transform(_pieces(text), turn)


def learned_text(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    taken = F.zip_with(_pieces(text), mask, lambda p, m: _unescaped(F.substr(p, m["skip"] + 1, m["take"]), ESCAPES))
    return F.array_join(taken, "")


def format_turns(conversations: DataFrame) -> DataFrame:
    """The rows with ``formatted`` and ``loss_mask`` added; no turns give the empty text."""
    return conversations.withColumns({"formatted": formatted(F.col("turns")), "loss_mask": loss_mask(F.col("turns"))})
