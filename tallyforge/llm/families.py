"""Families of candidates around pivots, verified on whole sets.

A family is a pivot and its members, the nodes that share an index entry with it. First every member
that can be linked with the pivot is compared with it; the linked ones are one component. Members that
this leaves outside are compared with the rest of the family, block against block inside a task. Each
comparison of sets stands behind a test of sizes and of short digests of the sets, which the caller
supplies. Texts are moved, not sets: they are shorter, and only those of nodes that the test has left.

Memory follows the longest text, ``DIGESTS`` and ``TOKENS``; ``BLOCK`` bounds the members that one copy
of a pivot meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bytesets import blocks, flat, shingle_hashes
from tallyforge.llm.common import join_groups, stored
from tallyforge.operators.components import connected_components
from tallyforge.session import broadcast_if_small

BLOCK = 128  # members of a family that are sent to one copy of their pivot
DIGESTS = 2048  # digests that one task compares with as many others
TOKENS = 500_000  # and members of sets


def set_blocks(column: pa.Array, width: int):
    """(row numbers, distinct hashes of each) for some megabytes of text at a time."""
    data, offsets = flat(column)
    for i, j in blocks(offsets):
        hashes, bounds = shingle_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
        yield range(i, j), [np.unique(hashes[bounds[k]:bounds[k + 1]]) for k in range(j - i)]


def shingle_sets(column: pa.Array, width: int):
    """(row number, distinct hashes) of every text of a batch."""
    for places, sets in set_blocks(column, width):
        yield from zip(places, sets)


def alike_sizes(a, b, percent: int):
    """Whether sets of these sizes can link at all."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), -1)


def likely_pairs(pairs: DataFrame, held: DataFrame, percent: int, alike) -> DataFrame:
    """The pairs whose sizes and digests leave a link possible."""
    small = broadcast_if_small(held)
    both = pairs.join(small, "node").join(small.select(
        F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("bytes").alias("pivot_bytes")), "pivot")
    sized = both.filter(alike_sizes(F.col("n"), F.col("pivot_n"), percent)).select(
        "pivot", "node", "bytes", "pivot_bytes", "n", "pivot_n")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (matrix(batch.column(i).to_pylist()) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            near = pa.array(alike(a, b, n_a, n_b))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["pivot", "node"])

    return sized.mapInArrow(run, "pivot long, node long")


def with_texts(rows: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the text of their node. ``texts``: ``node, digest, own`` (the id that reads it)."""
    placed = broadcast_if_small(stored(rows.join(texts.withColumnRenamed("digest", "of"), "node"), "family-placed"))
    found = docs.join(placed, (docs["digest"] == F.col("of")) & docs["id"].eqNullSafe(F.col("own")))
    return found.select(*rows.columns, "text")


def blocks_of(node: str, members: str, salt: int):
    """A node's block, of about ``BLOCK`` nodes each."""
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.ceil(F.col(members) / BLOCK)).cast("int")


def blocks_with_heads(families: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pivot, block, node, text`` of all members and, for each block, of its pivot, which comes first."""
    sizes = stored(families.groupBy("pivot").agg(F.count("*").alias("members")), "family-sizes")
    blocked = families.join(broadcast_if_small(sizes), "pivot").withColumn("block", blocks_of("node", "members", 0)).select("pivot", "block", "node")
    heads = sizes.select("pivot", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("members") / BLOCK) - 1).cast("int"))).alias("block"),
                         F.col("pivot").alias("node"))
    placed = with_texts(blocked.unionByName(heads), docs, texts)
    return placed.repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.col("node") != F.col("pivot"))


def labelled_members(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pivot, node, label, pivot_label`` of all families, pivots included; a node without links is its own label."""
    own = labels.select("node", F.col("root").alias("label"))
    members = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("node")).distinct())
    members = members.join(own, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return members.join(own.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), "pivot", "left") \
        .withColumn("pivot_label", F.coalesce("pivot_label", "pivot"))


def pivot_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` between a pivot and members of its block.

    ``rows``: ``pivot, block, node, text``, sorted by pivot, block and whether it is another node, so
    that the pivot comes first and one set is kept in memory.
    """
    def run(batches):
        current, own = None, None
        for batch in batches:
            pivots, places, nodes = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for i, members in shingle_sets(batch.column(3), width):
                if (pivots[i], places[i]) != current:
                    current, own = (pivots[i], places[i]), members
                elif nodes[i] != pivots[i]:
                    overlap = len(np.intersect1d(own, members, assume_unique=True))
                    if linked(overlap, len(own), len(members), percent):
                        found.append((pivots[i], nodes[i]))
            if found:
                yield _links(found)

    return rows.mapInArrow(run, "a long, b long")


def grouped_run(rows: DataFrame, keys: int, function, schema: str) -> DataFrame:
    """``function`` of the rows of every run of equal leading ``keys`` columns; rows sorted by them."""
    def run(batches):
        current, group = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:keys] != current:
                    out += function(current, group)
                    current, group = row[:keys], []
                group.append(row[keys:])
            if out:
                yield _batch(out, schema)
        out = list(function(current, group))
        if out:
            yield _batch(out, schema)

    return rows.mapInArrow(run, schema)


def _batch(rows, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _links(pairs) -> pa.RecordBatch:
    return _batch(pairs, "a long, b long")


def open_members(members: DataFrame) -> DataFrame:
    """``pivot, probe, node, label``: the families that still have members outside their pivot's
    component; those are the probes, and all members are targets.

    ``members``: ``pivot, node, label, pivot_label`` with the pivot itself.
    """
    outside = F.col("label") != F.col("pivot_label")
    sizes = stored(members.groupBy("pivot").agg(F.count("*").alias("m"), F.count_if(outside).alias("u")).filter("u > 0"), "family-open")
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    sides = F.when(outside, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    return join_groups(members, sizes, "pivot", "m", total).select("pivot", F.explode(sides).alias("probe"), "node", "label")


def block_pairs(rows: DataFrame, weight, limit: int) -> DataFrame:
    """``rows`` (``pivot, probe, ...``) once for every block of their family's other side; a block's
    weights sum up to about ``limit``. Adds ``probe_block, target_block``; one block each is the rule."""
    weight = weight.cast("double")
    sizes = stored(rows.groupBy("pivot").agg(
        F.count("*").alias("rows"), *[F.greatest(F.lit(1), F.ceil(F.sum(F.when(side, weight).otherwise(0)) / limit)).cast("int").alias(name)
                                      for side, name in ((F.col("probe"), "probes"), (~F.col("probe"), "targets"))]), "family-blocks")
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    own = F.pmod(F.xxhash64("node", "probe"), F.when(F.col("probe"), F.col("probes")).otherwise(F.col("targets"))).cast("int")
    others = F.when(F.col("probe"), F.col("targets")).otherwise(F.col("probes"))
    dealt = join_groups(rows, sizes, "pivot", "rows", total).withColumns(
        {"own": own, "other": F.explode(F.sequence(F.lit(0), others - 1))})
    return dealt.select("pivot", F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).alias("probe_block"),
                        F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).alias("target_block"),
                        *[c for c in rows.columns if c != "pivot"])


def sorted_blocks(rows: DataFrame) -> DataFrame:
    keys = ["pivot", "probe_block", "target_block"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def alike_members(rows: DataFrame, percent: int, alike) -> DataFrame:
    """``pivot, probe, node, label, n`` of the members that have a partner of another label in a block
    pair whose size and digest leave a link possible.

    ``rows``: ``pivot, probe_block, target_block, probe, node, label, n, bytes``.
    """
    def compare(key, group):
        probes, targets = [r for r in group if r[0]], [r for r in group if not r[0]]
        if not probes or not targets:
            return
        right = matrix([r[4] for r in targets])
        labels, sizes = (np.array([r[k] for r in targets]) for k in (2, 3))
        wanted = np.zeros(len(targets), bool)
        for row in probes:
            near = (labels != row[2]) & alike_sizes(sizes, row[3], percent)
            near[near] = alike(right[near], np.frombuffer(row[4], np.uint8), sizes[near], row[3])
            wanted |= near
            if near.any():
                yield (key[0], *row[:4])
        for i in np.flatnonzero(wanted):
            yield (key[0], *targets[i][:4])

    found = grouped_run(sorted_blocks(rows), 3, compare, "pivot long, probe boolean, node long, label long, n long")
    return found.distinct()


def block_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that join all labels which links between the probes and targets of a block pair
    join, on whole sets; not every such link, so dense groups give few rows.

    ``rows``: ``pivot, probe_block, target_block, probe, node, label, n, text``.
    """
    def sets(side):
        return [m for _, m in shingle_sets(pa.array([r[4] for r in side], pa.large_string()), width)]

    def compare(_, group):
        probes, targets = [r for r in group if r[0]], [r for r in group if not r[0]]
        if not probes or not targets:
            return
        others = sets(targets)
        sizes = np.array([len(m) for m in others])
        tokens, owner = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        merged: dict[int, int] = {}

        def root(label):
            while label in merged:
                label = merged[label]
            return label

        labels = np.array([r[2] for r in targets])
        for probe, mine in zip(probes, sets(probes)):
            low, high = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
            counts = high - low
            places = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            overlap = np.bincount(owner[places], minlength=len(others))
            label, near = root(probe[2]), linked(overlap, len(mine), sizes, percent) & (overlap > 0)
            while (apart := near & (labels != label)).any():
                target = int(np.argmax(apart))
                yield probe[1], targets[target][1]
                other = int(labels[target])
                merged[label] = other
                labels[labels == label] = other
                label = other

    return grouped_run(sorted_blocks(rows), 3, compare, "a long, b long")


# -- all of it -----------------------------------------------------------------------------------

def linked_components(pairs: DataFrame, held: DataFrame, docs: DataFrame, texts: DataFrame, width: int, percent: int,
                      alike) -> DataFrame:
    """``node, root`` of all nodes with a link to another one of a common family.

    ``pairs``: ``pivot, node``, stored. ``held``: ``node, n, bytes`` of all nodes in pairs, the size and
    digest of their sets, stored. ``docs``: ``id, text, digest``; ``texts``: ``node, digest, own``, the row
    to read a node's text from. ``alike(a, b, n_a, n_b)`` tells of matrices of digests and sizes of sets
    row by row (or of many on the left and one on the right) whether a link is possible.
    """
    families = stored(likely_pairs(pairs, held, percent, alike), "family-near")
    links = stored(pivot_links(blocks_with_heads(families, docs, texts), width, percent), "family-links")
    labels = stored(connected_components(links), "family-labels")

    members = stored(labelled_members(pairs, labels), "family-members")
    unsettled = block_pairs(stored(open_members(members), "family-unsettled"), F.lit(1), DIGESTS)
    rows = unsettled.join(broadcast_if_small(held), "node").select(
        "pivot", "probe_block", "target_block", "probe", "node", "label", "n", "bytes")
    left = block_pairs(stored(alike_members(rows, percent, alike), "family-alike"), F.col("n"), TOKENS)
    more = stored(block_links(with_texts(left, docs, texts), width, percent), "family-more")
    return labels if more.isEmpty() else stored(connected_components(links.unionByName(more)), "family-labels")
