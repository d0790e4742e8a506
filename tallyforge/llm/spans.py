"""Spans of pattern matches as DataFrame functions.

Positions come from splitting a text at the matches: the lengths of the pieces and of the matches
add up to code-point offsets, start inclusive and end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:long,rank:int,kind:string,stop:long>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def match_spans(text: Column, pattern: str | Column, kind: str, rank: int,
                keep: Callable[[Column], Column], group: int = 0) -> Column:
    """Array of (start, rank, kind, stop) of the leftmost, non-overlapping matches for whose ``group``
    ``keep`` holds; a match that fails is dropped, its characters are not tried again."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    pieces = F.split(text, regex, -1)
    sized = F.zip_with(pieces, whole, lambda p, w: F.struct(
        F.length(p).cast("long").alias("before"), F.coalesce(F.length(w), F.lit(0)).cast("long").alias("long"),
        w.alias("match")))
    if group:
        sized = F.zip_with(sized, F.regexp_extract_all(text, regex, F.lit(group)), lambda s, g: F.struct(
            s["before"].alias("before"), s["long"].alias("long"), g.alias("match")))
    start = F.struct(F.lit(0).cast("long").alias("at"), no_spans().alias("found"))

    def step(state, m):
        begin = state["at"] + m["before"]
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                       (begin + m["long"]).alias("stop"))
        kept = m["match"].isNotNull() & F.coalesce(keep(m["match"]), F.lit(False))  # null: the last piece
        return F.struct((begin + m["long"]).alias("at"),
                        F.when(kept, F.concat(state["found"], F.array(one))).otherwise(state["found"]).alias("found"))

    return F.when(F.regexp_like(text, regex), F.aggregate(sized, start, step, lambda s: s["found"])) \
        .otherwise(no_spans())


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
