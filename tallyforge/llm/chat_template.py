"""Chat formatting by a finite-state machine over roles and a declarative template.

The machine walks the turns of a conversation in order; the template says with which marks a turn
opens and closes and whether its text counts for the loss. The output is a list of segments
``(text, loss)``; their texts end to end are the formatted conversation.

Control strings inside texts are escaped reversibly: every backslash is doubled, and a backslash
is put after the first character of every control string. No mark starts with a character that
stands inside another, so a mark can't arise where text and mark meet.

Defined results: null text counts as empty, a null role reads as the empty role; a role that the
template doesn't know is written into its opening mark and makes the conversation invalid, as does
a turn out of order; turns with the same number are ordered by role and text; repeated rows are
turns like others; a conversation whose id is null is one group; extra columns are ignored; an
empty table gives no rows. Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, the moves the role machine allows, and the marks around unknown roles."""

    turns: dict[str, Turn]
    moves: dict[str, tuple[str, ...]]
    finals: tuple[str, ...]
    start: str = "start"
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    controls: tuple[str, ...] = field(default=())

    def marks(self) -> list[str]:
        own = [m for t in self.turns.values() for m in (t.opening, t.closing)]
        return list(dict.fromkeys([*own, *self.other, *self.controls]))

    def __post_init__(self):
        for m in self.marks():
            if len(m) < 2 or "\\" in m or any(m[0] in other[1:] for other in self.marks()):
                raise ValueError(f"unfit mark {m!r}: the first character of a mark may not stand inside one")


INSTRUCT = Template(
    turns={"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"),
           "assistant": Turn("[OUT]", "</s>", loss=True)},
    moves={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    finals=("assistant",))


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for m in template.marks():
        out = F.replace(out, F.lit(m), F.lit(f"{m[0]}\\{m[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def next_state(state: Column, role: Column, template: Template) -> Column:
    allowed = F.lit(False)
    for origin, targets in template.moves.items():
        allowed = allowed | ((state == origin) & role.isin(*targets))
    return F.when(allowed, role).otherwise(F.lit("invalid"))


def turn_segments(turn: Column, template: Template) -> Column:
    """Opening mark, escaped text and closing mark of one turn, with their loss flags."""
    def segments(opening, closing, loss):
        return F.array(*[F.struct(t.alias("text"), F.lit(flag).alias("loss")) for t, flag in (
            (opening, False), (escape(turn["text"], template), loss), (closing, False))])

    before, between, after = (F.lit(m) for m in template.other)
    out = segments(F.concat(before, escape(turn["role"], template), between), after, False)
    for role, t in template.turns.items():
        out = F.when(turn["role"] == role, segments(F.lit(t.opening), F.lit(t.closing), t.loss)).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``segments``, ``formatted`` (their texts end to end) and ``valid``.

    A conversation is one training example and has to fit into one row; its turns are gathered by
    one shuffle on the conversation.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    state = F.aggregate("turns", F.lit(template.start), lambda s, t: next_state(s, t["role"], template))
    segmented = ordered.select(
        "conv_id", state.isin(*template.finals).alias("valid"),
        F.flatten(F.transform("turns", lambda t: turn_segments(t, template))).alias("segments"))
    return segmented.withColumn("formatted", F.concat_ws("", F.col("segments.text")))


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """Array of ``(role, text)`` parsed from a formatted conversation."""
    before, between, after = template.other
    openings = {t.opening: r for r, t in template.turns.items()}
    closings = list(dict.fromkeys([*[t.closing for t in template.turns.values()], after]))
    either = "|".join(re.escape(m) for m in openings)
    pattern = (f"(?s)({either}|{re.escape(before)}(?:.*?){re.escape(between)})"
               f"(.*?)({'|'.join(re.escape(m) for m in closings)})")
    marks = F.regexp_extract_all(formatted, F.lit(pattern), 1)
    bodies = F.regexp_extract_all(formatted, F.lit(pattern), 2)

    def role_of(mark):
        role = unescape(F.substring(mark, len(before) + 1, F.length(mark) - len(before) - len(between)))
        for m, r in openings.items():
            role = F.when(mark == m, F.lit(r)).otherwise(role)
        return role

    return F.zip_with(marks, bodies, lambda m, b: F.struct(role_of(m).alias("role"), unescape(b).alias("text")))


def chat_digest(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What a reader of the output finds in it: turns, their digest, and all text under the loss."""
    parsed = formatted.select(
        "conv_id", "valid", "formatted", read_back(F.col("formatted"), template).alias("turns"),
        F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))).alias("loss"))
    listing = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
