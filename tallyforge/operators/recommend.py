"""Item-to-item recommendations from co-occurrence, and ranked propensity lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import vocab
from tallyforge.operators.ordering import positions
from tallyforge.session import materialise

# Items of one user that are paired in one row; a longer basket is cut into blocks of about so many.
BASKET_BLOCK = 256
# Pairs that a task counts.
TASK_PAIRS = 2_000_000


def baskets(df: DataFrame, user: str, item: str, limit: int | None = None) -> DataFrame:
    """Distinct items per user, compared as text; with ``limit``, the first so many in order."""
    pairs = df.select(F.col(user).cast("string").alias("user"), F.col(item).cast("string").alias("item"))
    distinct = pairs.filter("user IS NOT NULL AND item IS NOT NULL").distinct()
    if limit is None:
        return distinct
    place = F.row_number().over(Window.partitionBy("user").orderBy("item"))
    return distinct.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def item_counts(basket: DataFrame) -> DataFrame:
    return basket.groupBy("item").agg(F.count("*").alias("users"))


def cooccurrence(basket: DataFrame, min_support: int = 2) -> DataFrame:
    """Neighbours ``(item, neighbour, support, confidence)`` in both directions.

    Items of fewer than ``min_support`` users cannot be in any pair that counts and are left out
    before the pairs are made; the rest are numbered from the rarest on. A basket is cut into blocks
    that meet block by block, each meeting in a row of its own, so neither a row nor a task holds a
    whole long basket. What is shuffled is a list of partners per basket and item, dealt by the rarer
    item of the pair, so frequent items draw few rows; the pairs are made and counted where they arrive,
    in tasks of about ``TASK_PAIRS`` pairs. The basket is read twice: hand over a stored one.
    """
    frequent = item_counts(basket).filter(F.col("users") >= min_support)
    items = materialise(positions(frequent, ["users", "item"], "code"))
    lists = _blocks(basket.join(items.withColumn("code", F.col("code").cast("int")), "item"))
    tasks = max(int(basket.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_number_of_pairs(lists) // TASK_PAIRS))
    partners = _partners(_met(lists)).repartition(tasks, "a")
    support = partners.select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("support"))
    kept = support.filter(F.col("support") >= min_support)
    both = kept.select(F.inline(F.array(
        F.struct(F.col("a").alias("code"), F.col("b").alias("other"), F.col("support").alias("support")),
        F.struct(F.col("b").alias("code"), F.col("a").alias("other"), F.col("support").alias("support")))))
    names = items.select(F.col("code").alias("other"), F.col("item").alias("neighbour"))
    return both.join(items, "code").join(names, "other").select(
        "item", "neighbour", "support", (F.col("support") / F.col("users").cast("double")).alias("confidence"))


def _blocks(coded: DataFrame) -> DataFrame:
    """``user, blocks, own, codes``: the baskets in blocks, the codes of a block in order."""
    blocks = coded.groupBy("user").agg(F.ceil(F.count("*") / BASKET_BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    codes = F.sort_array(F.collect_list("code")).alias("codes")
    return materialise(coded.join(blocks, "user").groupBy("user", "blocks", block.alias("own")).agg(codes))


def _number_of_pairs(lists: DataFrame) -> int:
    """About how many pairs the baskets hold."""
    size = F.size("codes").cast("bigint")
    each = F.when(F.col("blocks") == 1, size * (size - 1) / 2).otherwise(size * F.col("blocks") * BASKET_BLOCK / 2)
    return int(lists.agg(F.sum(each).alias("n")).first().n or 0)


def _met_blocks(coded: DataFrame) -> DataFrame:
    return _met(_blocks(coded))


def _met(lists: DataFrame) -> DataFrame:
    """``i, j, xs, ys``: every pair of blocks of a basket once, ``i`` not above ``j``.

    A basket of one block meets itself where it is. The blocks of a longer one are copied to the key
    (user, lower block, upper block), so the meetings of one user spread over tasks.
    """
    alone = lists.filter("blocks = 1").select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("codes").alias("xs"), F.col("codes").alias("ys"))
    long = lists.filter("blocks > 1")
    lower = long.select("user", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("codes").alias("xs"))
    upper = long.select("user", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("codes").alias("ys"))
    return alone.unionByName(lower.join(upper, ["user", "i", "j"]).select("i", "j", "xs", "ys"))


def _partners(met: DataFrame) -> DataFrame:
    """``a, bs``: for every item of a meeting the partners with a higher code, each pair once."""
    def higher(mine: str, others: str) -> Column:
        return F.transform(mine, lambda a: F.struct(a.alias("a"), F.filter(others, lambda b: b > a).alias("bs")))

    own = F.transform("xs", lambda a, at: F.struct(a.alias("a"), F.slice("xs", at + 2, F.size("xs")).alias("bs")))
    both = F.when(F.col("i") == F.col("j"), own).otherwise(F.concat(higher("xs", "ys"), higher("ys", "xs")))
    return met.select(F.explode(both).alias("one")).select("one.a", "one.bs").filter(F.size("bs") > 0)


def top_neighbours(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best neighbours per item by support, then confidence, then name."""
    order = Window.partitionBy("item").orderBy(F.desc("support"), F.desc("confidence"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def summary(df: DataFrame, user: str, item: str, basket: DataFrame, pairs: DataFrame) -> DataFrame:
    """Interactions, items, and items that have a neighbour."""
    used = df.filter(F.col(user).isNotNull() & F.col(item).isNotNull())
    parts = [
        used.agg(F.count("*").alias("n")).select(F.lit("interactions").alias("measure"), "n"),
        item_counts(basket).agg(F.count("*").alias("n")).select(F.lit("items"), "n"),
        pairs.select("item").distinct().agg(F.count("*").alias("n")).select(F.lit("items_with_neighbours"), "n"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def ranking_columns(columns: list[str]) -> list[str]:
    """The columns that name a key."""
    return [c for c in columns if re.search(vocab.ID_NAME_RANKING, c, re.IGNORECASE)]


def rank_by_score(df: DataFrame, score: str, key: str, target: str | None = None, top: int = 50) -> DataFrame:
    """The ``top`` rows by probability with the 0.5 decision, key columns first."""
    flagged = df.withColumn("predicted", (F.col(score) >= 0.5).cast("int"))
    shown = ranking_columns([c for c in df.columns if c not in (score, target)])
    shown += [c for c in (key, target, score, "predicted") if c and c not in shown]
    return flagged.select(*shown).orderBy(F.desc(score), key).limit(top)
