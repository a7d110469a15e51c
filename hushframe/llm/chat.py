"""Operator 7, chat formatting: layouts recognised by a fingerprint of field paths, one reversible template. DataFrame functions only.

A layout is declared as a set of field paths and a mapping to turns (role, text). The fingerprint of a layout is the SHA-256 of its
sorted paths. A record's nested field paths (of a JSON record: the keys that it has, of any element of an array; of a typed table: its
schema's) are hashed in the same way, as far as a layout names them; the most specific layout with the same fingerprint is
selected, so other fields of a record don't matter.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MIDDLE, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and other templates, without their first character: a backslash goes between the two.
AFTER_ANGLE, AFTER_BRACKET = r"(\||/?s>|</?SYS>>)", r"(/?INST\])"
#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


class Layout(NamedTuple):
    """paths: what a record of it has. each: of an array, (array, role field, text field); else fixed: (role, fields to join)."""

    name: str
    paths: tuple[str, ...]
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("message texts", ("messages[].role", "messages[].text"), each=("messages", "role", "text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Layout("turns", ("turns[].role", "turns[].text"), each=("turns", "role", "text")),
    Layout("instruction with input", ("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("completion", ("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("rows", ("turn", "role", "text"), fixed=(("", ("text",)),)),
)
KNOWN = tuple(sorted({p for layout in LAYOUTS for p in layout.paths}))
#: The arrays whose elements have paths.
ARRAYS = tuple(sorted({p.partition("[]")[0] for p in KNOWN if "[]" in p}))


def fingerprint(paths: tuple[str, ...]) -> str:
    """SHA-256 of paths, sorted."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Fingerprints and their layouts, the most specific one first.
BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in sorted(LAYOUTS, key=lambda x: -len(x.paths))}


def select_layout(paths: Column) -> Column:
    """The name of the most specific layout whose fingerprint an array of paths has, of those that the layout names; else null."""
    name = F.lit(None).cast("string")
    for mark, layout in reversed(BY_FINGERPRINT.items()):
        own = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, layout.paths))))
        name = F.when(F.sha2(F.array_join(own, "\n"), 256) == mark, layout.name).otherwise(name)
    return name


def schema_paths(schema: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a type; elements of an array are below name[]."""
    if isinstance(schema, T.StructType):
        return {p for field in schema.fields for p in schema_paths(field.dataType, f"{prefix}.{field.name}" if prefix else field.name)}
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return {prefix}


def below(name: str):
    return lambda key: F.concat(F.lit(f"{name}[]."), key)


def record_paths(record: Column) -> Column:
    """Nested field paths of a variant: its own keys, and below name[] those of any element of the arrays that layouts know."""
    parts = [F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))]
    for name in ARRAYS:
        keys = F.flatten(F.transform(F.try_variant_get(record, f"$.{name}", "array<map<string,variant>>"), lambda x: F.coalesce(F.map_keys(x), F.array().cast("array<string>"))))
        parts.append(F.transform(F.array_distinct(keys), below(name)))
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def turn(role: Column, text: Column) -> Column:
    named = F.coalesce(role, F.lit(""))
    for other, usual in ROLES.items():
        named = F.when(named == other, usual).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def record_turns(record: Column, layout: Layout) -> Column:
    """The turns of a variant in a layout."""
    if layout.each:
        name, role, text = layout.each
        items = F.try_variant_get(record, f"$.{name}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(items, lambda x: turn(x[role], x[text]))
    get = lambda p: F.try_variant_get(record, f"$.{p}", "string")
    return F.array(*[turn(F.lit(role), F.concat_ws("\n\n", *map(get, parts))) for role, parts in layout.fixed])


def canonical(records: DataFrame, json: str = "record") -> DataFrame:
    """records with layout (name, null if unknown) and turns, an array of (role, text).

    A system prompt beside the layout's own fields (field system) goes first. Fields that a layout doesn't name don't matter; a null value is
    an empty text. What is no JSON, or in no known layout, has no turns (an empty array) and a null layout; no row is lost.
    """
    none = F.array().cast(TURNS)
    out = records.drop("layout", "turns").withColumn("__variant", F.try_parse_json(F.col(json)))
    out = out.withColumn("layout", select_layout(record_paths(F.col("__variant"))))
    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        if layout.name != "rows":
            turns = F.when(F.col("layout") == layout.name, record_turns(F.col("__variant"), layout)).otherwise(turns)
    known = F.col("layout").isNotNull() & (F.col("layout") != "rows")
    system = F.try_variant_get(F.col("__variant"), "$.system", "string")
    first = F.when(system.isNotNull() & known, F.array(turn(F.lit("system"), system))).otherwise(none)
    return out.withColumn("turns", F.concat(first, F.coalesce(turns, none))).withColumn("layout", F.when(known, F.col("layout"))).drop("__variant")


def rows_to_turns(rows: DataFrame, key: str) -> DataFrame:
    """(key, turns) of a table with one row for each turn. Each row's layout is selected by the fingerprint of its schema's paths; it must
    be that of rows (turn, role, text), other rows are an error when the query runs.

    Turns are ordered by turn (null first), then role and text; repeated rows stay. Null roles and texts are empty, and roles
    stay as they are written; rows with a null
    key are one conversation. Other columns, whatever their names, don't take part.
    """
    own = rows.select(F.col(key).alias("__key"), *[c for c in rows.columns if c in KNOWN])
    layout = select_layout(F.array(*[F.lit(p) for p in sorted(schema_paths(own.schema))]))
    if not {"turn", "role", "text"} <= set(own.columns):
        raise ValueError("the table isn't one of turns")
    item = F.when(layout == "rows", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).otherwise(F.raise_error(F.lit("the row's layout isn't one of turns")))
    grouped = own.groupBy("__key").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select(F.col("__key").alias(key), F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escaped(text: Column) -> Column:
    """text without control strings: backslashes doubled, and one put into each control string behind its first character."""
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, "<" + AFTER_ANGLE, r"<\\$1")
    return F.regexp_replace(text, r"\[" + AFTER_BRACKET, r"[\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """One string of all turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(STOP))), "")


def loss_spans(turns: Column) -> Column:
    """(start, length) in code points of each assistant text, escaped, in the formatted string."""
    step = lambda a, t: F.struct(
        (a["at"] + len(START + MIDDLE + STOP) + F.length(escaped(t["role"])) + F.length(escaped(t["text"]))).alias("at"),
        F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + len(START + MIDDLE) + F.length(escaped(t["role"]))).alias("start"), F.length(escaped(t["text"])).alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, begin, step, lambda a: a["spans"])


def format_chats(chats: DataFrame, turns: str = "turns") -> DataFrame:
    """chats with formatted (string) and loss_spans; a row without turns has an empty string."""
    return chats.withColumn("loss_spans", loss_spans(F.col(turns))).withColumn("formatted", formatted(F.col(turns)))


def read_turns(formatted_: Column) -> Column:
    """The turns that a formatted string holds."""
    quoted = lambda s: s.replace("|", r"\|")
    parts = F.filter(F.split(formatted_, quoted(STOP), -1), lambda p: p.startswith(START))
    split = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), quoted(MIDDLE), -1))
    return F.transform(split, lambda s: F.struct(unescaped(s[0]).alias("role"), unescaped(s[1]).alias("text")))


def read_loss(formatted_: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted_, s["start"] + 1, s["length"]))), "")
