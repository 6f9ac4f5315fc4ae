"""Chat formatting: a role state machine, escaped turn texts and per-segment loss flags."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.llm.common import or_empty


@dataclass(frozen=True)
class ChatTemplate:
    """What a turn looks like, which roles are learned from, and which role may follow which state.

    ``transitions`` maps a state to the roles allowed there and the state each leads to; a conversation
    is valid if every turn is allowed and it ends in one of ``accept``. A control string has at least
    two characters, no backslash, and its first character only once, so that a backslash after that
    character can neither leave nor make a control string.
    """

    turn_open: str = "<|im_start|>"
    turn_close: str = "<|im_end|>"
    tail: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        first = self.turn_open[:1]
        for c in self.controls:
            if len(c) < 2 or "\\" in c or "\n" in c or first in c[1:] or c[0] != first:
                raise ValueError(f"unusable control string {c!r}")

    @property
    def controls(self) -> tuple[str, str]:
        return self.turn_open, self.turn_close


CHATML = ChatTemplate()


def escape(text: Column, template: ChatTemplate = CHATML, one_line: bool = False) -> Column:
    """Double backslashes, break control strings with one and, for one line, write newlines as ``\\n``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if one_line else out


def unescape(text: Column) -> Column:
    """Undo :func:`escape` of a text: the character after each backslash stands for itself."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_line(text: Column) -> Column:
    """Undo :func:`escape` with ``one_line``."""
    plain = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def _machine(template: ChatTemplate, turns: Column) -> Column:
    """Final state and the number of the first turn that is not allowed (null if none)."""
    steps = [(f"{s}\n{r}", to) for s, ways in template.transitions.items() for r, to in ways.items()]
    table = F.create_map(*[F.lit(x) for pair in steps for x in pair])
    begin = F.struct(
        F.lit(template.start).alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("wrong")
    )

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), t["role"]))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (acc["seen"] + 1).alias("seen"),
            F.coalesce(acc["wrong"], F.when(to.isNull(), acc["seen"])).alias("wrong"),
        )

    return F.aggregate(turns, begin, step)


def format_chats(
    rows: DataFrame,
    template: ChatTemplate = CHATML,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss) in order, ``formatted``, ``valid``, ``wrong_turn``.

    Turns are ordered by turn, then role, then text, nulls first; repeated rows are kept as turns.
    A null text or role is empty; null ids form one conversation. Invalid conversations are formatted
    too and marked. Other columns are ignored. The formatted conversation is one value, so its turns
    meet in one row by nature; nothing larger than a conversation is gathered.
    """
    tidy = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), or_empty(F.col(role)).alias("role"), or_empty(F.col(text)).alias("text")).alias("t"),
    )
    chats = tidy.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(template.turn_open), escape(t["role"], template, one_line=True), F.lit("\n"))
        learned = t["role"].isin(*template.loss_roles) if template.loss_roles else F.lit(False)
        parts = [(head, F.lit(False)), (escape(t["text"], template), learned), (F.lit(template.turn_close + template.tail), F.lit(False))]
        return F.array(*[F.struct(x.alias("text"), flag.alias("loss")) for x, flag in parts])

    chats = chats.select(
        "conv_id",
        F.flatten(F.transform("turns", pieces)).alias("segments"),
        _machine(template, F.col("turns")).alias("__end"),
    )
    return chats.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("__end.wrong").isNull() & F.col("__end.state").isin(*template.accept)).alias("valid"),
        F.col("__end.wrong").alias("wrong_turn"),
    )


def read_back(chats: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Turns (role, text) parsed from ``formatted`` and ``learned``, the unescaped texts under the loss flags."""
    end = re.escape(template.turn_close + template.tail).replace("\\\n", "\n")
    chunks = F.split("formatted", end)
    head = len(template.turn_open)

    def turn(c: Column) -> Column:
        body = F.substring(c, F.lit(head + 1), F.char_length(c))
        name = F.substring_index(body, "\n", 1)
        rest = F.substring(body, F.char_length(name) + 2, F.char_length(body))
        return F.struct(unescape_line(name).alias("role"), unescape(rest).alias("text"))

    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.select(
        "*",
        F.transform(F.filter(chunks, lambda c: c != ""), turn).alias("turns"),
        learned.alias("learned"),
    )
