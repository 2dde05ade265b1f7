"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's rows are gathered by turn, its role sequence is run through the machine, and
every turn is emitted as segments (opening marker, text, closing marker), each with a loss flag.
Everything is built from SQL functions: no Python runs on executors.

Control strings inside texts are escaped: backslashes are doubled, then a backslash goes in after
the first character of each control string. Doubled backslashes come in even runs, so a single one
after such a character is always ours, and reading back is exact.

Null roles and null texts count as empty; rows whose turns tie are ordered by role, then text, and
repeated rows are repeated turns; a null conversation id is a conversation of its own; other columns
are not read; an empty table gives no rows. The turns of one conversation end up in one row, as its
formatted text is one value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers by role, which roles carry loss, and the order of turns that is accepted."""

    markers: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<s>[SYS] ", " [/SYS]</s>"),
            "user": ("<s>[INST] ", " [/INST]</s>"),
            "assistant": ("<s>[ANS] ", " [/ANS]</s>"),
        }
    )
    #: For any other role: before the role, between role and text, after the text.
    other: tuple[str, str, str] = ("<s>[ROLE] ", " [/ROLE] ", " [/TURN]</s>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    turn_end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[ROLE]", "[/ROLE]", "[/TURN]")
    #: state -> role -> state; what is not listed is an error.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: frozenset[str] = frozenset({"answered"})

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return out

    def unescape(self, text: Column) -> Column:
        out = text
        for c in self.controls:
            out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
        return F.replace(out, F.lit("\\\\"), F.lit("\\"))

    def step(self, state: Column, role: Column) -> Column:
        out = F.lit("error")
        for name, moves in self.machine.items():
            for by, then in moves.items():
                out = F.when((state == name) & (role == by), F.lit(then)).otherwise(out)
        return out


def _segments(t: Template, turn: Column) -> Column:
    def segment(text: Column, loss: bool) -> Column:
        return F.struct(turn["role"].alias("role"), text.alias("text"), F.lit(loss).alias("loss"))

    body = t.escape(turn["text"])
    out = F.array(
        segment(F.concat(F.lit(t.other[0]), t.escape(turn["role"]), F.lit(t.other[1])), False),
        segment(body, False),
        segment(F.lit(t.other[2]), False),
    )
    for role, (opening, closing) in t.markers.items():
        own = F.array(segment(F.lit(opening), False), segment(body, role in t.loss_roles), segment(F.lit(closing), False))
        out = F.when(turn["role"] == role, own).otherwise(out)
    return out


def format_chats(
    rows: DataFrame,
    template: Template | None = None,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments, valid, error_turn.

    ``segments`` joined are ``formatted``; ``error_turn`` is the first turn (from 0) that the machine
    refuses, or the number of turns if it stops short of an accepting state; null if ``valid``.
    """
    t = template or Template()
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def move(held: Column, turn: Column) -> Column:
        then = t.step(held["state"], turn["role"])
        return F.struct(
            then.alias("state"),
            (held["at"] + 1).alias("at"),
            F.when(held["bad"].isNull() & (then == "error"), held["at"]).otherwise(held["bad"]).alias("bad"),
        )

    told = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", start, move).alias("end"),
        F.flatten(F.transform("turns", lambda x: _segments(t, x))).alias("segments"),
    )
    valid = F.col("end.state").isin(sorted(t.accepting))
    return told.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        valid.alias("valid"),
        F.when(~valid, F.coalesce("end.bad", F.col("n_turns").cast("int"))).alias("error_turn"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns that a formatted conversation holds: array of (role, text)."""
    t = template or Template()
    parts = F.split(formatted, r"\Q" + t.turn_end + r"\E", -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        def inner(opening: str, closing: str) -> Column:
            close = len(closing) - len(t.turn_end)
            return F.substr(part, F.lit(len(opening) + 1), F.length(part) - F.lit(len(opening) + close))

        rest = inner(t.other[0], t.other[2])
        out = F.struct(
            t.unescape(F.substring_index(rest, t.other[1], 1)).alias("role"),
            t.unescape(F.substr(rest, F.length(F.substring_index(rest, t.other[1], 1)) + F.lit(len(t.other[1]) + 1))).alias("text"),
        )
        for role, (opening, closing) in t.markers.items():
            own = F.struct(F.lit(role).alias("role"), t.unescape(inner(opening, closing)).alias("text"))
            out = F.when(F.startswith(part, F.lit(opening)), own).otherwise(out)
        return out

    return F.transform(whole, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, in order, unescaped."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")


def digest(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """What formatted conversations hold, read back from them."""
    read = chats.select(
        "conv_id",
        "n_turns",
        read_turns(F.col("formatted"), template).alias("turns"),
        loss_text(F.col("segments"), template).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
    )
    listed = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "error_turn",
    )
