"""Secret scans with an incremental blob ledger.

A repository's history is a table of versions (path, text). Every version is content-addressed by
the SHA-256 of its text. The ledger lists the (blob, rule, rule version) pairs already scanned, and
the findings table what they gave; a run scans only the pairs that the ledger lacks and joins the
findings of all blobs back to every path and version that has them.

Everything is DataFrame functions.

Defined results: null text counts as empty and has no findings; equal texts are one blob, scanned
once; repeated rows and null paths are versions like others; extra columns are ignored; empty
tables give empty results. Texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored
from tallyforge.llm.spans import match_spans, no_spans
from tallyforge.session import broadcast_if_small


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and non-overlapping; those for which
    ``group`` is shorter than ``least`` are dropped. ``rank`` orders kinds at the same start."""

    kind: str
    rank: int
    pattern: str
    group: int
    least: int
    version: int = 1


#: The patterns and least lengths that every scan has.
RULES = (
    Rule("assign", 0,
         r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),  # shorter runs are dropped whole, so they need no match
    Rule("hex", 2, r"[0-9a-f]{32,}", 0, 32),
)


def found_by(text: Column, rule: Rule) -> Column:
    return match_spans(text, rule.pattern, rule.kind, rule.rank, lambda m: F.length(m) >= rule.least, rule.group)


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text",
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row ``(blob, rule, version, findings)`` for each blob and rule that the ledger lacks."""
    texts = versions.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        open_pairs = texts.distinct().withColumns({"blob": content_address(F.col("text")), "todo": wanted})
    else:
        # only addresses meet the ledger; texts move if it lacks something of theirs
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
        addresses = texts.select(content_address(F.col("text")).alias("blob")).distinct().join(seen, "blob", "left").select(
            "blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>"))).alias("todo"))
        unseen = stored(addresses.filter(F.size("todo") > 0), "unseen-blobs")
        blobs = texts.withColumn("blob", content_address(F.col("text")))
        open_pairs = blobs.join(broadcast_if_small(unseen), "blob").dropDuplicates(["blob"])
    todo = open_pairs.filter(F.size("todo") > 0)
    results = F.array(*[F.struct(
        F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
        F.when(F.array_contains("todo", F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))),
               found_by(F.col("text"), r)).alias("findings")) for r in rules])
    return todo.select("blob", F.filter(results, lambda x: x["findings"].isNotNull()).alias("scans")) \
        .select("blob", F.inline("scans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with the new pairs added, written once to the shared folder."""
    new = stored(scan_unseen(versions, ledger, text_col, rules), "ledger")
    return new if ledger is None else ledger.unionByName(new)


def findings_by_path(versions: DataFrame, ledger: DataFrame, path_col: str = "path", text_col: str = "text",
                     rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every version with the findings of its blob under the present rules, in order."""
    present = F.lit(False)
    for r in rules:
        present = present | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
    hits = (ledger.filter(present & (F.size("findings") > 0)).groupBy("blob")
            .agg(F.array_sort(F.flatten(F.collect_set("findings"))).alias("findings")))
    paths = versions.select(F.col(path_col).alias("path"), content_address(F.col(text_col)).alias("blob"))
    return paths.join(hits, "blob", "left").select(
        "path", "blob", F.coalesce("findings", no_spans()).alias("findings"))

