"""Exact n-gram Jaccard join by token-combination prefixes.

The set of a document are its distinct word shingles, as 64-bit hashes. Equal sets are one class and
take part once. A fixed table of counters orders the tokens, rare before frequent. Two sets with
similarity ``percent`` share a token in their prefixes; with prefixes k - 1 tokens longer they share k.
Here k grows with the set (``shared_needed``). What a linked pair shares is at least one rare token or
two frequent ones, so the index holds every rare prefix token and every pair of frequent prefix tokens;
for sets above ``PAIRED_SIZE`` tokens, where pairs would grow with the square, single frequent tokens
(sets near that size are indexed both ways, so no link is lost). A set whose prefix shares fewer than
k tokens with all others together has no link and leaves, which lets others leave in turn.

What shares an index entry is a candidate, but the pairs inside an entry are not listed. Each entry
names a pivot, its most typical set, and all its sets join the pivot's family. First every member is
verified against the pivot; linked members are one component and need no further comparison with
each other. Only members that are not connected to the pivot's component are then compared with the
rest of the family, block against block inside a task. Sets are compared only where their sizes and
bitmaps of the parity of their tokens leave a link possible, a bound that no linked pair breaks. Every
comparison counts all tokens of both sets, so the links are exact up to collisions of 64-bit hashes.

Defined results: null and empty texts and texts without words have empty sets, linked with nothing;
a text of fewer words than a shingle has its whole sequence as the only token; repeated rows fall
into one class; null ids take part and a component without any other id is null; extra columns are
ignored; an empty table gives no rows. Memory follows the longest text and the blocks of ``families``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyforge.llm.bytesets import blocks, flat, mix, shingle_hashes
from tallyforge.llm.common import join_groups, stored
from tallyforge.llm.families import linked_components
from tallyforge.session import broadcast_if_small

COUNTER_BITS = 22
COUNTERS = 1 << COUNTER_BITS  # of the table that orders tokens (16 MB); its size does not depend on the input
_CHUNK = 1 << 14
PAIRED_SIZE = 256
BITS = 1024  # cells of the bitmap that stands for a set
_SALT = np.uint64(0x5851F42D4C957F2D)


def token_sets(column: pa.Array, width: int):
    """(row number, ascending distinct hashes) of every text of a batch."""
    data, offsets = flat(column)
    for i, j in blocks(offsets):
        hashes, bounds = shingle_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
        for k in range(j - i):
            yield i + k, np.unique(hashes[bounds[k]:bounds[k + 1]])


def class_key(tokens: np.ndarray) -> int | None:
    """64-bit digest of a set; null for the empty one."""
    if not len(tokens):
        return None
    total = np.add.reduce(mix(tokens ^ _SALT)) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


# -- first pass: classes and the counters --------------------------------------------------------

def classes_and_counters(docs: DataFrame, width: int) -> DataFrame:
    """Rows ``id, n, key, digest, bits`` of documents (``bits`` where a task meets a class first), and rows
    ``chunk, counts`` of each task's counters, packed."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType)] + T._parse_datatype_string(
        "n long, key long, digest long, bits binary, chunk int, counts binary").fields)
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def run(batches):
        counters, seen = np.zeros(COUNTERS, np.int32), set()
        for batch in batches:
            sizes, keys, bits = [], [], []
            for _, tokens in token_sets(batch.column(1), width):
                key = class_key(tokens)
                fresh = key is not None and key not in seen
                sizes.append(len(tokens))
                keys.append(key)
                bits.append(parity_bits(tokens) if fresh else None)
                seen.add(key)
                np.add.at(counters, _cell(tokens), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), batch.column(2),
                 pa.array(bits, pa.binary()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())],
                schema.fieldNames())
        rows = []
        for chunk in range(COUNTERS // _CHUNK):
            part = counters[chunk * _CHUNK:(chunk + 1) * _CHUNK]
            if part.any():
                rows.append((chunk, _packed(part)))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows), id_type), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()),
             pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int32()),
             pa.array([r[1] for r in rows], pa.binary())],
            schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _packed(counts: np.ndarray) -> bytes:
    """Counters in the smallest width that holds them, compressed."""
    width = next(w for w in (1, 2, 4) if counts.max() < 256 ** w)
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def total_counters(parts: DataFrame) -> np.ndarray:
    """The counters of all tasks added up; the driver gets one fixed-size table."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[chunk] = sums.get(chunk, 0) + _unpacked(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in sums.values()], pa.binary())],
            ["chunk", "counts"])

    out = np.zeros(COUNTERS, np.int32)
    chunks = parts.filter("chunk is not null").select("chunk", "counts").repartition("chunk")
    for r in chunks.mapInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"] * _CHUNK:(r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], np.int32)
    return out


# -- second pass: the index ----------------------------------------------------------------------

def overlap_needed(percent: int, size: int) -> int:
    """Least overlap of a set with any partner."""
    return -(-percent * size // 100)


def shared_needed(size):
    """Prefix tokens that a set shares with any linked set, as far as its own size goes."""
    return 2 + size // 20


def shared_needed_of(size):
    """``shared_needed`` of a column."""
    return 2 + F.floor(size / 20)


def signatures(tokens: np.ndarray, counters: np.ndarray, frequent: int, percent: int):
    """Index entries of a set: rare tokens; pairs or singles of frequent ones; and how many of the
    prefix tokens are frequent."""
    n = len(tokens)
    counts = counters[_cell(tokens)]
    order = np.lexsort((tokens, counts))[:min(n, n - overlap_needed(percent, n) + shared_needed(n))]
    tokens, hot = tokens[order], counts[order] >= frequent
    many, out = tokens[hot], [np.zeros(0, np.uint64)]
    if len(many) and n * 100 > PAIRED_SIZE * percent:
        out.append(mix(many ^ np.uint64(1)))
    if len(many) > 1 and n * percent <= PAIRED_SIZE * 100:
        a, b = np.triu_indices(len(many), 1)
        low, high = np.minimum(many[a], many[b]), np.maximum(many[a], many[b])
        out.append(mix(mix(low) + high))
    return mix(tokens[~hot]), np.concatenate(out), len(many)


def index_rows(docs: DataFrame, width: int, percent: int, counters, frequent: int) -> DataFrame:
    """``sig, hot, key, n, many, typical`` of every class, once per task; ``many`` is the number of
    frequent prefix tokens, ``typical`` is high for sets of frequent tokens."""
    def run(batches):
        table, seen = counters.value, set()
        for batch in batches:
            columns = [[] for _ in range(6)]
            for _, tokens in token_sets(batch.column(1), width):
                key = class_key(tokens)
                if key is None or key in seen:
                    continue
                seen.add(key)
                rare, hot, many = signatures(tokens, table, frequent, percent)
                size = len(rare) + len(hot)
                own = (np.concatenate([rare, hot]).view(np.int64), np.arange(size) >= len(rare), np.full(size, key, np.int64),
                       np.full(size, len(tokens), np.int32), np.full(size, many, np.int32),
                       np.full(size, np.log2(table[_cell(tokens)] + 1.0).mean(), np.float32))
                for column, values in zip(columns, own):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns],
                                                 ["sig", "hot", "key", "n", "many", "typical"])

    return docs.mapInArrow(run, "sig long, hot boolean, key long, n int, many int, typical float")


def shared_entries(index: DataFrame) -> DataFrame:
    """The index rows whose entry has several classes.

    A rare token has fewer documents than ``frequent``, as its counter says, so a window over its
    rows is small; entries of frequent tokens are added up inside the tasks and joined back.
    """
    entry = Window.partitionBy("sig")
    rare = index.filter("not hot").withColumns({"low": F.min("key").over(entry), "high": F.max("key").over(entry)})
    hot = index.filter("hot")
    several = hot.groupBy("sig").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high")
    return rare.filter("low <> high").drop("low", "high").unionByName(hot.join(several.select("sig"), "sig", "left_semi"))


def core_entries(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of classes that share enough prefix tokens to have a link at all."""
    smaller = (F.col("n") * percent / 100).cast("int")
    enough = rows.groupBy("key").agg(F.count_if(~F.col("hot")).alias("rare"), F.max("many").alias("many"), F.max("n").alias("n")) \
        .filter(F.col("rare") + F.col("many") >= shared_needed_of(smaller)).select("key")
    return rows.join(broadcast_if_small(stored(enough, "jaccard-core")), "key", "left_semi")


def family_pairs(rows: DataFrame) -> DataFrame:
    """``pivot, node``: every class with the most typical class of each of its entries."""
    best = F.max(F.struct("typical", "key"))
    slim = rows.select("sig", "hot", "key", "typical")
    rare = slim.filter("not hot").withColumn("pivot", best.over(Window.partitionBy("sig")))
    hot = slim.filter("hot")
    named = hot.join(hot.groupBy("sig").agg(best.alias("pivot")), "sig")
    pairs = rare.select("key", "pivot").unionByName(named.select("key", "pivot"))
    return pairs.select(F.col("pivot.key").alias("pivot"), F.col("key").alias("node")).filter("node <> pivot").distinct()


# -- verification --------------------------------------------------------------------------------

def parity_bits(tokens: np.ndarray) -> bytes:
    """For each of ``BITS`` cells, whether an odd number of tokens falls into it."""
    cells = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def alike_bits(percent: int):
    """Test for ``linked_components``. Two bitmaps differ in no more cells than the sets have tokens that
    are not common, and linked sets have at most (100 - percent) / (100 + percent) of both sizes such
    tokens, so no link is lost."""
    def alike(a, b, n_a, n_b):
        apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return (100 + percent) * apart <= (100 - percent) * (n_a + n_b)
    return alike


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    # an id may stand at several texts, so the row to read a class from is known by both
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    spark = docs.sparkSession
    first = stored(classes_and_counters(docs, width), "jaccard-classes")
    documents = first.filter("chunk is null").select("id", "n", "key", "digest")
    counters = total_counters(first)
    frequent = max(1000, int(counters.sum(dtype=np.int64)) // 100_000)
    shared = spark.sparkContext.broadcast(counters)
    index = stored(index_rows(docs.select("id", "text"), width, percent, shared, frequent), "jaccard-index")
    core = core_entries(stored(shared_entries(index), "jaccard-shared"), percent)

    pairs = stored(family_pairs(core), "jaccard-families")
    classes = stored(documents.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("own"),
        F.count("*").alias("copies")), "jaccard-sets")
    involved = broadcast_if_small(stored(pairs.select("node").union(pairs.select("pivot")).distinct(), "jaccard-involved"))
    held = stored(first.filter("bits is not null").select(F.col("key").alias("node"), "n", F.col("bits").alias("bytes"))
                  .join(involved, "node", "left_semi").dropDuplicates(["node"]), "jaccard-held")
    texts = classes.select(F.col("key").alias("node"), "own.digest", F.col("own.id").alias("own")).join(involved, "node", "left_semi")
    labels = linked_components(pairs, held, docs, texts, width, percent, alike_bits(percent))

    roots = classes.join(labels.select(F.col("node").alias("key"), "root"), "key", "left") \
        .select("key", "id", "copies", F.coalesce("root", "key").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    component = stored(roots.join(smallest, "root").select("key", "component_id", "copies"), "jaccard-components")
    total = component.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    full = join_groups(documents.filter("key is not null"), component, "key", "copies", total)
    empty = documents.filter("key is null").withColumn("component_id", F.col("id"))
    return full.select("id", "n", "component_id").unionByName(empty.select("id", "n", "component_id")).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
