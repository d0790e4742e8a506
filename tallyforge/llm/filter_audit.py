"""What each filter of a chain removes, in every order, by counting paths of the subset lattice.

A document is known by the set of filters it fails, so a part of the corpus is a short table of
(failed set, counts). The state of a chain is the set of filters applied so far; a document is alive
in a state if it fails none of them. Applying one more filter is an edge of the lattice, and what it
removes there is the same for every order that takes the edge. Counting forward how many orders reach
a state and backward how many leave it gives the number of orders through every edge: edge removals
weighted with it are the Shapley sums, and the steps of one order are the edges along its path.

Texts are read once, in the task that scans them; only digests, ids and flags are shuffled. Copies are
counted inside the tasks before any shuffle, so a text that a third of all rows share is a few rows.

Defined results: null texts are empty; a null part is the empty string; of equal texts all but those
with the smallest id fail ``DUPLICATE``, so rows that repeat both id and text fail or pass together; a
row without an id is a copy of nothing and nothing is a copy of it; a document with several label rows
is good (or toxic) if one of them says so, and label rows without an id belong to none; extra columns
are ignored; an empty table gives no rows. Parts are any number, filters up to ``MOST_FILTERS``.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import copies_of, stored
from tallyforge.session import broadcast_if_small

#: The number of orders is the factorial of the number of filters, and a part has a row for each step.
MOST_FILTERS = 6
#: Stands in place of a condition for "equal to the text of a smaller id".
DUPLICATE = "duplicate"
SPACES = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def default_filters(text: Column, words: Column) -> dict[str, Column | str]:
    """The conditions under which a text with the given words fails each filter."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
        "E": DUPLICATE,
    }


# -- the lattice ---------------------------------------------------------------------------------

def lattice(filters: int) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int], int]]:
    """All edges as (state, filter, orders through it), and the place of each edge by its first two.

    States are bit sets. Paths are counted along the edges: forward from the empty state, backward
    from the full one.
    """
    full = (1 << filters) - 1
    bits = range(filters)
    reaching, leaving = {0: 1}, {full: 1}
    for state in sorted(range(1, full + 1), key=int.bit_count):
        reaching[state] = sum(reaching[state ^ 1 << f] for f in bits if state >> f & 1)
    for state in sorted(range(full), key=int.bit_count, reverse=True):
        leaving[state] = sum(leaving[state | 1 << f] for f in bits if not state >> f & 1)
    edges = [(s, f, reaching[s] * leaving[s | 1 << f]) for s in range(full) for f in bits if not s >> f & 1]
    return edges, {(s, f): i for i, (s, f, _) in enumerate(edges)}


def paths(names: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(order, step, place of the step's edge) of every order."""
    _, place = lattice(len(names))
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, place[state, f]))
            state |= 1 << f
    return out


# -- counts by failed set ------------------------------------------------------------------------

def failed_sets(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | str] | None = None,
                id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, failed, docs, good, toxic``: how many documents fail exactly that set of filters.

    ``filters`` are conditions on the columns ``text`` and ``words``; ``default_filters`` if none.
    """
    spaced = F.array_remove(F.split("text", SPACES), "")
    filters = filters or default_filters(F.col("text"), F.col("words"))
    names = tuple(filters)
    flags = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
             for i, c in enumerate(filters.values()) if not isinstance(c, str)]
    copies = sum(1 << i for i, c in enumerate(filters.values()) if isinstance(c, str))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("words", spaced)
    rows = texts.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                        sum(flags, F.lit(0)).alias("failed"))
    marks = label_marks(labels)
    rows = stored(rows.join(broadcast_if_small(marks), "id", "left").na.fill(False, ["good", "toxic"]), "audit-rows")
    if not copies:
        return cells(rows.withColumn("n", F.lit(1).cast("long")))
    return cells(with_copies(rows, copies))


def label_marks(labels: DataFrame) -> DataFrame:
    """``id, good, toxic`` of every labelled document, once."""
    marks = copies_of(labels, ("doc_id", "quality", "toxic")).filter("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
    return stored(marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")), "audit-labels")


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """Rows ``part, failed, good, toxic, n`` with ``bit`` set for copies of a smaller id's text.

    Per text and group of alike rows: all rows, and how many stand at the group's smallest id. A
    group's rows are no copies only if its smallest id is the text's smallest id.
    """
    alike = ["digest", "failed", "part", "good", "toxic"]
    known = F.col("id").isNotNull()
    once = rows.groupBy(*alike, "id").agg(F.count("*").alias("n"))
    groups = stored(once.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"),
        F.min("id").alias("first"), F.min_by("n", "id").alias("at_first")), "audit-groups")
    least = groups.groupBy("digest").agg(F.min("first").alias("least"), F.count("*").alias("groups"))
    # most texts are a single group and need no join
    several = least.filter("groups > 1").select("digest", "least")
    judged = groups.join(several, "digest", "left")
    heads = F.when(F.col("least").isNull() | (F.col("first") == F.col("least")), F.col("at_first")).otherwise(F.lit(0))
    passing = F.coalesce(heads, F.lit(0)) + F.col("unknown")
    kinds = F.array(F.struct(F.col("failed").alias("failed"), passing.alias("n")),
                    F.struct(F.col("failed").bitwiseOR(F.lit(bit)).alias("failed"), (F.col("n") - passing).alias("n")))
    return judged.select("part", "good", "toxic", F.inline(kinds)).filter("n > 0")


def cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "failed").agg(
        F.sum("n").alias("docs"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


# -- the audit -----------------------------------------------------------------------------------

def audit(counts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row per part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley`` (the sum over all orders, not their mean)."""
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters with different names")
    edges, _ = lattice(len(names))
    spark = counts.sparkSession
    # a part has at most one cell for every set of filters, so the lists are short
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "docs", "good", "toxic")).alias("cells"))

    def total(of: str, condition) -> Column:
        return F.aggregate(F.filter("cells", condition), F.lit(0).cast("long"), lambda a, c: a + c[of])

    steps = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("orders"))
                      for s, f, w in edges])
    edge = F.col("edge")

    def leaves(c):  # alive before the edge, removed on it
        return (c["failed"].bitwiseAND(edge["state"]) == 0) & (c["failed"].bitwiseAND(edge["bit"]) != 0)

    taken = parts.select("part", "cells", F.posexplode(steps).alias("place", "edge")).select(
        "part", "place", edge["bit"].alias("bit"), edge["orders"].alias("orders"),
        total("docs", leaves).alias("removed"), total("good", leaves).alias("good_lost"), total("toxic", leaves).alias("toxic_lost"),
        total("docs", lambda c: c["failed"].bitwiseAND(edge["state"].bitwiseOR(edge["bit"])) == 0).alias("kept"),
        total("docs", lambda c: c["failed"].bitwiseAND(edge["bit"]) != 0).alias("failing"),
        total("docs", lambda c: c["failed"] == edge["bit"]).alias("unique_fails"))
    # the edges of one part, some dozens: their number follows from the number of filters
    gathered = taken.groupBy("part").agg(F.array_sort(F.collect_list(F.struct(
        "place", "bit", "orders", "removed", "good_lost", "toxic_lost", "kept", "failing", "unique_fails"))).alias("edges"))
    every = gathered.select("part", F.explode("edges").alias("e"), F.expr(
        "aggregate(filter(edges, x -> x.bit = e.bit), 0L, (a, x) -> a + x.orders * x.removed)").alias("shapley"))
    order = F.broadcast(spark.createDataFrame(paths(names), "filter_order string, step int, place int"))
    return every.select("part", "e.*", "shapley").join(order, "place").select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley")
