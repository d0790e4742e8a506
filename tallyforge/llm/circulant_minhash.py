"""Near-dedup by circulant MinHash.

The set of a document are its distinct word shingles, as 64-bit hashes. A first permutation of the
64-bit numbers breaks up their order; a second one, shifted by 0, 1, 2, ... places, gives one
signature coordinate a shift: the smallest place that any member takes. Two permutations therefore
make all coordinates. ``ROWS`` consecutive coordinates are a band; texts that agree on a band are
candidates. At the least similarity that links (85 %), a pair misses all bands once in 10**8.

What shares a band is a bucket, but the pairs inside it are not listed. Each bucket names its smallest
node as pivot and every member is verified against it on the whole sets. Members that this leaves
outside the pivot's component are compared with the rest of the pivot's family, block against block
inside a task: first signatures of a byte a coordinate (a pair at the least similarity expects 136 of 160 equal
bytes and has fewer than 96 once in 10**14), then whole sets of what is left; of the links found there
those are sent on that join components. Texts are moved, not sets:
they are shorter, and only those of texts that some bucket holds.

Equal texts are one node. Inside a task they are found by comparison with its own digests, over tasks
by SHA-256 (128 bits of it); a node's number is the place where its first text was read.

Defined results: null and empty texts and texts without words have empty sets and link with nothing; a
text of fewer words than a shingle has its whole sequence as the only member; repeated rows are one
node; null ids take part, ``component_id`` is the smallest other id or null, and a row with a null id
is kept only if nothing else in its component has an id; extra columns are ignored; an empty table
gives no rows. Memory follows the longest text and the blocks of ``families``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.bytesets import mix
from tallyforge.llm.common import join_groups, stored
from tallyforge.llm.families import linked_components, set_blocks
from tallyforge.session import broadcast_if_small

ROWS, BANDS = 5, 32
COORDINATES = ROWS * BANDS
_FIRST = np.uint64(0xA24BAED4963EE407)  # what the first permutation adds before it mixes
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)  # odd factors of the second
_CHUNK = 1 << 13  # members whose places are computed at once, so that they stay in the cache


def signatures(members: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All coordinates, one row a set. ``members`` end to end, ``bounds`` of sets that are not empty."""
    out = np.full((len(bounds) - 1, COORDINATES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), _CHUNK):
        place = mix(members[at:at + _CHUNK] + _FIRST)  # the first permutation
        low, high = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, at + len(place), "left")
        starts = np.maximum(bounds[low:high] - at, 0)
        work, top = np.empty_like(place), np.empty_like(place)
        for k in range(COORDINATES):  # the second one, shifted by k
            np.add(place, np.uint64(k), out=work)
            np.multiply(work, _A, out=work)
            np.right_shift(work, np.uint64(32), out=top)
            np.bitwise_xor(work, top, out=work)
            np.multiply(work, _B, out=work)
            column = out[low:high, k]
            np.minimum(column, np.minimum.reduceat(work, starts), out=column)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One key per set and band; equal coordinates in different bands give different keys."""
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(coordinates), BANDS))
    for row in range(ROWS):
        total = mix(total + coordinates[:, row::ROWS])
    return total.view(np.int64)


def byte_signatures(coordinates: np.ndarray) -> np.ndarray:
    return (mix(coordinates) >> np.uint64(56)).astype(np.uint8)


def alike_least(percent: int) -> int:
    """Equal bytes that a linked pair has for certain, as good as: 25 of 100 fewer than expected."""
    return COORDINATES * (percent - 25) // 100


# -- nodes ---------------------------------------------------------------------------------------

def signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """``id, n, node, digest`` of every row; ``bands, bytes`` where a task reads a text first.

    ``docs``: ``id, text, digest``. The node is the same for equal texts of one task.
    """
    id_field = docs.schema["id"]
    schema = T.StructType([T.StructField("id", id_field.dataType)] + T._parse_datatype_string(
        "n long, node long, digest binary, bands array<long>, bytes binary").fields)

    def run(batches):
        part, nodes, sizes = TaskContext.get().partitionId() << 40, {}, {}
        for batch in batches:
            digests, fresh = batch.column(2).to_pylist(), []
            for i, digest in enumerate(digests):
                if digest not in nodes:
                    nodes[digest] = part + len(nodes)
                    fresh.append(i)
            bands, low = [None] * len(digests), [None] * len(digests)
            for places, sets in set_blocks(batch.column(1).take(pa.array(fresh, pa.int64())), width):
                places = [fresh[k] for k in places]
                sizes.update((digests[i], len(members)) for i, members in zip(places, sets))
                full = [(i, members) for i, members in zip(places, sets) if len(members)]
                if full:
                    coordinates = signatures(np.concatenate([m for _, m in full]),
                                             np.cumsum([0] + [len(m) for _, m in full]))
                    for (i, _), keys, short in zip(full, band_keys(coordinates), byte_signatures(coordinates)):
                        bands[i], low[i] = keys, short.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sizes[d] for d in digests], pa.int64()),
                 pa.array([nodes[d] for d in digests], pa.int64()), batch.column(2),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def digested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)
    return df.select(F.col(id_col).alias("id"), text.alias("text"), digest.alias("digest"))


# -- candidates ----------------------------------------------------------------------------------

def bucket_pairs(nodes: DataFrame) -> DataFrame:
    """``pivot, node``: every node with the smallest node of each of its buckets."""
    entries = nodes.select("node", F.explode("bands").alias("band"))
    buckets = stored(entries.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("members"))
                     .filter("members > 1"), "minhash-buckets")
    total = buckets.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    pairs = join_groups(entries, buckets, "band", "members", total)
    return pairs.filter("node <> pivot").select("pivot", "node").distinct()


def alike_signatures(percent: int):
    """Test for ``linked_components``: whether the signatures leave a link possible."""
    least = alike_least(percent)
    return lambda a, b, n_a, n_b: (a == b).sum(axis=1) >= least


# -- the operator --------------------------------------------------------------------------------

def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    percent: int = 85) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the smallest id that links reach)
    and ``kept`` (whether that is its own)."""
    docs = digested(df, id_col, text_col)
    rows = stored(signed_rows(docs, width), "minhash-rows")
    # equal texts over all tasks: the smallest node, the smallest id and the number of rows
    texts = stored(rows.filter("n > 0").groupBy("digest").agg(
        F.min("node").alias("node"), F.min("id").alias("id"), F.count("*").alias("copies")), "minhash-texts")
    first = rows.filter("bands is not null").select("node", "n", "bands", "bytes")
    nodes = first.join(broadcast_if_small(texts.select("node")), "node", "left_semi")

    pairs = stored(bucket_pairs(nodes), "minhash-pairs")
    involved = stored(pairs.select("node").union(pairs.select(F.col("pivot").alias("node"))).distinct(), "minhash-involved")
    held = stored(nodes.select("node", "n", "bytes").join(broadcast_if_small(involved), "node", "left_semi"), "minhash-held")
    named = texts.select("digest", "node", F.col("id").alias("own"))
    labels = linked_components(pairs, held, docs, named, width, percent, alike_signatures(percent))

    roots = texts.join(labels, "node", "left").select("digest", "id", "copies", F.coalesce("root", "node").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    component = stored(roots.join(smallest, "root").select("digest", "component_id", "copies"), "minhash-components")
    total = component.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    full = join_groups(rows.filter("n > 0").select("id", "n", "digest"), component, "digest", "copies", total)
    empty = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.select("id", "n", "component_id").unionByName(empty).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
