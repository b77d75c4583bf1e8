"""Chat formatting: layouts told by a fingerprint of their field paths, one canonical form, one reversible template.

All steps are DataFrame functions. A table's nested field paths are hashed; the hash selects a declarative mapping that brings the
layout to canonical turns (conversation, place, role, text); turns are grouped, formatted and read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSISTANT = "assistant"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    """A hash of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _single(role: str, text: Column, place: int) -> Column:
    return F.struct(F.lit(place).cast("long").alias("turn"), F.lit(role).alias("role"), text.cast("string").alias("text"))


def _from_array(messages: str, role: str, text: str, names: dict[str, str]) -> Callable[[DataFrame, str], DataFrame]:
    def turns(df: DataFrame, id_col: str) -> DataFrame:
        named = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None
        out = df.select(F.col(id_col).alias("conv_id"), F.posexplode(messages).alias("turn", "m"))
        who = F.col(f"m.{role}")
        return out.select("conv_id", F.col("turn").cast("long").alias("turn"), (F.coalesce(named[who], who) if named is not None else who).alias("role"), F.col(f"m.{text}").alias("text"))

    return turns


def _from_fields(*fields: tuple[str, str]) -> Callable[[DataFrame, str], DataFrame]:
    def turns(df: DataFrame, id_col: str) -> DataFrame:
        one = F.array(*(_single(role, F.col(name), k) for k, (role, name) in enumerate(fields)))
        return df.select(F.col(id_col).alias("conv_id"), F.explode(one).alias("m")).select("conv_id", "m.turn", "m.role", "m.text")

    return turns


def _instruction(df: DataFrame, id_col: str) -> DataFrame:
    asked = F.when(F.coalesce(F.col("input"), F.lit("")) == "", F.col("instruction")).otherwise(F.concat_ws("\n\n", "instruction", "input"))
    return _from_fields(("user", "__asked"), (ASSISTANT, "output"))(df.withColumn("__asked", asked), id_col)


@dataclass(frozen=True)
class Layout:
    """A layout: the field paths that tell it, and how its rows become turns."""

    paths: tuple[str, ...]
    turns: Callable[[DataFrame, str], DataFrame]


LAYOUTS = {
    fingerprint(list(layout.paths)): layout
    for layout in (
        Layout(("turn", "role", "text"), lambda df, c: df.select(F.col(c).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")),
        Layout(("messages[].role", "messages[].content"), _from_array("messages", "role", "content", {})),
        Layout(("conversations[].from", "conversations[].value"), _from_array("conversations", "from", "value", {"human": "user", "gpt": ASSISTANT})),
        Layout(("prompt", "response"), _from_fields(("user", "prompt"), (ASSISTANT, "response"))),
        Layout(("prompt", "completion"), _from_fields(("user", "prompt"), (ASSISTANT, "completion"))),
        Layout(("system", "prompt", "response"), _from_fields(("system", "system"), ("user", "prompt"), (ASSISTANT, "response"))),
        Layout(("instruction", "output"), _from_fields(("user", "instruction"), (ASSISTANT, "output"))),
        Layout(("instruction", "input", "output"), _instruction),
        Layout(("question", "answer"), _from_fields(("user", "question"), (ASSISTANT, "answer"))),
    )
}


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, turn, role, text)`` of a table in any known layout.

    The layout whose paths are all of the table's (less the id's) is chosen by their hash; if there is none, other columns are ignored and
    the known layout with the most paths, all of them in the table, is. Unknown layouts raise ValueError.
    """
    own = [p for p in field_paths(df.schema) if p != id_col]
    layout = LAYOUTS.get(fingerprint(own))
    if layout is None:
        held = [x for x in LAYOUTS.values() if set(x.paths) <= set(own)]
        if not held:
            raise ValueError(f"unknown layout: {sorted(own)}")
        layout = max(held, key=lambda x: len(x.paths))
    tops = {p.split("[")[0].split(".")[0] for p in layout.paths}
    return layout.turns(df.select(*({id_col} | tops)), id_col)


#: The template's control characters and what stands for them in texts; the first is the mark of what follows.
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
_BAR = ("|", "\\p")  # in roles alone, which end at a bar
_OPEN, _TO, _CLOSE = "<|", "|>\n", "</s>\n"


def escape(text: Column) -> Column:
    r"""``text`` without ``<`` and ``[``, with which all control strings begin, and reversible: ``\`` stands before a letter that tells what was there."""
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    for plain, written in (_BAR, *reversed(_ESCAPES)):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    r"""``(conv_id, formatted, loss_spans)`` for each conversation of canonical turns.

    A turn is ``<|role|>\ntext</s>\n``, role and text escaped; ``loss_spans`` are start and length, in code points, of the assistant's texts.
    Turns are ordered by number, then role and text; repeated rows are turns of their own. Null roles and texts are empty; a null number is the first; null ids
    make a conversation.
    """
    written = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    grouped = written.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda t: F.concat(F.lit(_OPEN), F.replace(escape(t["role"]), *map(F.lit, _BAR)), F.lit(_TO))
    formatted = F.array_join(F.transform("t", lambda t: F.concat(head(t), t["text"], F.lit(_CLOSE))), "")
    lengths = F.transform("t", lambda t: F.struct(F.length(head(t)).alias("head"), F.length(t["text"]).alias("own"), (t["role"] == ASSISTANT).alias("learn")))
    empty = F.struct(F.lit(0).alias("at"), F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))), 1, 0).alias("spans"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["head"]
        spans = F.when(x["learn"], F.array_append(s["spans"], F.struct(start.alias("start"), x["own"].alias("length")))).otherwise(s["spans"])
        return F.struct((start + x["own"] + len(_CLOSE)).alias("at"), spans.alias("spans"))

    return grouped.select("conv_id", formatted.alias("formatted"), F.aggregate(lengths, empty, step, lambda s: s["spans"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted``'s columns and what its text holds: ``turns`` (roles and texts as they were given) and ``loss_text``, the text under the loss spans."""
    part = F.split(F.col("formatted"), f"(?:^|{_CLOSE})" + r"<\|")
    inner = F.transform(F.filter(part, lambda p: p != ""), lambda p: F.regexp_replace(p, r"</s>\n\z", ""))
    turns = F.transform(inner, lambda p: F.struct(unescape(F.substring_index(p, _TO, 1)).alias("role"), unescape(F.substr(p, F.instr(p, F.lit(_TO)) + len(_TO))).alias("text")))
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("*", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from formatted conversations."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
