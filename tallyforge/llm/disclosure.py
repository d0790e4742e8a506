"""Personal data by information-theoretic sanitisation.

Protected entities are found by fixed rules (mail addresses, network addresses, payment cards,
phone numbers). Around every mention lies a context of neighbouring words. Over the whole corpus it
is counted in how many different contexts of an entity a term stands, and in how many different texts
it occurs at all. The pointwise mutual information of term and entity, in bits, and the share of the
term's documents that lie in the entity's contexts say how strongly the term reveals the entity. A
term above both thresholds is itself personal data wherever it occurs: it is generalised, or removed
when it gives away almost everything.

Everything is DataFrame functions. Contexts and texts that are copies of each other count once, so a
document repeated a thousand times makes no term revealing and hides none.

Defined results: null text counts as empty and has no spans; repeated rows and null ids are documents
like others; extra columns are ignored; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored
from tallyforge.llm.spans import SPANS, match_spans, no_spans
from tallyforge.session import broadcast_if_small

#: The patterns and limits that every scan has. Quantifiers are possessive where
#: nothing follows, and a mail address is tried only where a run of its characters begins, so that
#: long runs cost no more than their length.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

CONTEXT_CHARS = 60
WORD_BREAK = r"[^\p{L}\p{N}]+"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, nines cast out, the sum a multiple of ten."""
    reversed_digits = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(
        F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)),
        F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _card(match: Column) -> Column:
    digits = digits_of(match)
    return F.length(digits).between(14, 19) & passes_luhn(digits)


def entity_spans(text: Column) -> Column:
    """All spans of protected entities, by start and kind."""
    found = [
        match_spans(text, EMAIL, "email", 0, lambda m: F.lit(True)),
        match_spans(text, IP, "ip", 1, lambda m: F.regexp_like(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))),
        match_spans(text, CARD, "card", 2, _card),
        match_spans(text, PHONE, "phone", 3, lambda m: F.length(digits_of(m)).between(10, 15)),
    ]
    return F.array_sort(F.concat(*found))


@dataclass(frozen=True)
class Thresholds:
    """``bits`` and ``share`` mark a term as revealing, ``removed_share`` as giving away almost all;
    a term needs ``support`` different contexts of the entity."""

    bits: float = 6.0
    share: float = 0.5
    removed_share: float = 0.9
    support: int = 3


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: F.length(w) > 2)


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, key of its text, the entity spans, and value and context words of each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("spans", entity_spans(F.col("text")))

    def mention(s):
        value = F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
        left = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        around = F.concat(F.substr(F.col("text"), (left + 1).cast("int"), (s["start"] - left).cast("int")), F.lit(" "),
                          F.substr(F.col("text"), (s["stop"] + 1).cast("int"), F.lit(CONTEXT_CHARS)))
        plain = F.when(s["kind"] == "email", F.lower(value)).otherwise(digits_of(value))
        return F.struct(s["kind"].alias("kind"), plain.alias("value"), around.alias("around"))

    return found.select("id", F.xxhash64("text").alias("text_key"), "spans",
                        F.transform("spans", mention).alias("mentions"))


def different_texts(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """``text_key, text`` of every text once; only texts that occur several times are moved."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    copied = stored(found.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1").select("text_key"), "copied-texts")
    single = texts.join(broadcast_if_small(copied), "text_key", "left_anti")
    several = texts.join(broadcast_if_small(copied), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    return single.select("text_key", "text").unionByName(several)


def revealing_terms(docs: DataFrame, found: DataFrame, text_col: str, limits: Thresholds):
    """(terms, holders): the revealing terms with their measures, and the texts that hold them."""
    contexts = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.value", "m.around").distinct()
    pairs = contexts.select("kind", "value", F.explode(F.array_distinct(words_of(F.col("around")))).alias("term"))
    together = pairs.groupBy("kind", "value", "term").agg(F.count("*").alias("together")) \
        .filter(F.col("together") >= limits.support)
    together = stored(together, "term-entity")
    per_entity = contexts.groupBy("kind", "value").agg(F.count("*").alias("contexts"))
    # texts of every term of the corpus, added up inside the tasks first
    held = different_texts(docs, found, text_col).select(
        "text_key", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    spread = held.groupBy("term").agg(F.count("*").alias("docs"))
    corpus = found.select("text_key").distinct().count()
    measured = together.join(per_entity, ["kind", "value"]).join(spread, "term").select(
        "kind", "value", "term", "together", "contexts", "docs",
        F.log2(F.col("together") * F.lit(float(max(corpus, 1))) / (F.col("docs") * F.col("contexts"))).alias("bits"),
        F.least(F.col("together") / F.col("docs"), F.lit(1.0)).alias("share"))
    revealing = measured.filter((F.col("bits") >= limits.bits) & (F.col("share") >= limits.share))
    terms = stored(revealing.groupBy("term").agg(
        F.max("bits").alias("bits"), F.max("share").alias("share"),
        (F.max("share") >= limits.removed_share).alias("removed")), "revealing-terms")
    # a revealing term has few texts: at most its share's inverse times those of the entity
    holders = held.join(broadcast_if_small(terms), "term").groupBy("text_key").agg(
        F.sort_array(F.collect_set(F.struct("term", "removed"))).alias("terms"))
    return terms, holders


def term_spans(text: Column, terms: Column) -> Column:
    """Spans of whole words among ``terms``, an array of (term, removed)."""
    return F.flatten(F.transform(terms, lambda t: match_spans(
        text, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), t["term"], F.lit(r"\E(?![\p{L}\p{N}])")), TERM, len(KINDS),
        lambda m: F.lit(True))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  limits: Thresholds = Thresholds()) -> DataFrame:
    """One row per document: id, ``base`` (entity spans) and ``spans`` (with those of revealing terms)."""
    found = stored(mentions(docs, id_col, text_col), "mentions")
    _, holders = revealing_terms(docs, found, text_col, limits)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    added = (texts.join(broadcast_if_small(stored(holders, "term-holders")), "text_key")
             .select("text_key", term_spans(F.col("text"), F.col("terms")).alias("added"))
             .groupBy("text_key").agg(F.min("added").alias("added")))
    rows = found.select("id", "text_key", "spans").join(added, "text_key", "left")
    return rows.select(F.col("id").alias(id_col), F.col("spans").alias("base"), F.array_sort(F.concat(
        "spans", F.coalesce("added", no_spans()))).cast(SPANS).alias("spans"))


def sanitise(text: Column, spans: Column, removed: Column | None = None) -> Column:
    """The text with every span replaced by its kind in brackets, or by nothing where the span's text
    is among the ``removed`` terms; of overlapping spans the first counts."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        value = F.substr(text, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        if removed is not None:
            mark = F.when((s["kind"] == TERM) & F.array_contains(removed, value), F.lit("")).otherwise(mark)
        before = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.when(s["start"] < state["at"], state).otherwise(
            F.struct(s["stop"].alias("at"), F.concat(state["out"], before, mark).alias("out")))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
