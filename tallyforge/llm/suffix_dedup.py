"""Removal of repeated byte strings with suffix arrays built by induced sorting.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id
is removed. Sorting all suffixes of the corpus would move each byte fifty times, so only text that
can repeat is sorted:

1. Of equal texts only the one with the smallest id takes part; the others are covered whole.
2. Anchors: the smallest hash of the ``gram``-byte strings in each window of ``length`` bytes. Equal
   windows have equal anchors. Stored parts of the texts send each of their anchors once, and one
   shuffle by anchor finds those that occur in more than one document and names one of these, the
   anchor's head.
3. A document cuts the regions around such anchors, all windows that contain them, and sends each to
   the shard of the anchors' head. Near copies share the head all along, so a region is long and
   moved once; all documents with a window meet in the same shard.
4. A shard sorts the suffixes of its regions by induction; permuted common prefixes mark the
   suffixes that agree on ``length`` bytes with the one before; each such run has a smallest id.
5. The windows with a smaller id than their document's are removed from the text.

The texts are written once, bucketed by row, so no later join moves them again.

Defined results: null counts as empty; texts shorter than ``length`` lose nothing; rows with the same
id never remove anything from each other; a null id is larger than every other; extra columns are
ignored; an empty table gives no rows. Ids are integers. Memory follows the longest text and the
regions that one head gathers.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bytesets import BYTE_CODES, blocks, flat
from tallyforge.llm.common import stored
from tallyforge.llm.induced_sort import shares_prefix, suffix_array
from tallyforge.session import shared_folder

LENGTH = 50
GRAM = 20
LAST = 2**63 - 1  # stands for a null id
SHARD_BYTES = 500_000  # of segments whose suffixes are sorted together
ANCHOR_BYTES = 100_000  # of texts hashed together, so that the arrays stay in the cache
FLUSH = 2_000_000  # anchors that a task gathers before it sends them
GATHERED = 2**16  # texts that these may come from, at most
_BASE = 0x9E3779B97F4A7C15
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# -- anchors -------------------------------------------------------------------------------------

def _sliding(values: np.ndarray, width: int, function) -> np.ndarray:
    """``function`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = function(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = function(values[:len(values) - (width - span)], values[width - span:])
    return values


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """48-bit hash of every run of ``gram`` bytes: polynomials of 1, 2, 4, ... bytes, put together."""
    done, found, span, part = 0, None, 1, BYTE_CODES[data]
    while True:
        if gram & span:
            if found is None:
                found = part.copy()
            else:  # the bytes so far, then these
                n = len(data) - done - span + 1
                found = found[:n] * np.uint64(pow(_BASE, span, 2 ** 64)) + part[done:done + n]
            done += span
        if span * 2 > gram:
            break
        part = part[:-span] * np.uint64(pow(_BASE, span, 2 ** 64)) + part[span:]
        span *= 2
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        found ^= found >> np.uint64(shift)
        found *= np.uint64(factor)
    found >>= np.uint64(16)
    return found


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """48-bit hash of every gram, the smallest one in each window, and which windows lie in one text."""
    if len(data) < length:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool)
    hashes = _gram_hashes(data, gram)
    least = _sliding(hashes, length - gram + 1, np.minimum)
    sizes = np.diff(offsets)
    fit = np.maximum(sizes - length + 1, 0)
    inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([fit, sizes - fit], axis=1).ravel())
    return hashes, least, inside[:len(least)]


def text_anchors(data, offsets, length, gram):
    """(text number, anchor) pairs in the order of the text; an anchor comes again only where it
    stands in the text again."""
    _, least, inside = window_anchors(data, offsets, length, gram)
    new = inside.copy()
    new[1:] &= least[1:] != least[:-1]
    begins = offsets[:-1][offsets[:-1] < len(new)]
    new[begins] = inside[begins]
    at = np.flatnonzero(new)
    return np.searchsorted(offsets, at, "right") - 1, least[at]


def _pieces(offsets):
    """Ranges of texts that are hashed together."""
    for a, b in blocks(offsets, ANCHOR_BYTES):
        for i in range(a, b, GATHERED):
            yield i, min(b, i + GATHERED)


def _part_anchors(batches, length, gram):
    """(part, anchors, numbers) of every stored part, each pair once, sorted by anchor and number; a
    large part comes in several pieces."""
    part, numbers, places, anchors, size, texts = None, [], [], [], 0, 0

    def gathered():
        number = np.concatenate(numbers)
        by_number = np.argsort(number, kind="stable")
        rank = np.empty(len(number), np.uint64)
        rank[by_number] = np.arange(len(number), dtype=np.uint64)
        pairs = np.concatenate(anchors) << np.uint64(16) | rank[np.concatenate(places)]
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        return part, pairs >> np.uint64(16), number[by_number][(pairs & np.uint64(GATHERED - 1)).astype(np.int64)]

    for batch in batches:
        parts, own = (np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1))
        data, offsets = flat(batch.column(2))
        turns = np.flatnonzero(np.diff(parts)) + 1
        pieces = [(a + i, a + j) for a, b in zip([0, *turns], [*turns, len(parts)]) for i, j in _pieces(offsets[a:b + 1])]
        for i, j in pieces:
            if parts[i] != part or size > FLUSH or texts + j - i > GATHERED:
                if size:
                    yield gathered()
                part, numbers, places, anchors, size, texts = int(parts[i]), [], [], [], 0, 0
            owner, found = text_anchors(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length, gram)
            numbers.append(own[i:j])
            places.append(owner + texts)
            anchors.append(found)
            size += len(found)
            texts += j - i
    if size:
        yield gathered()


def _low(anchors):
    return (anchors & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def _high(anchors):
    return (anchors >> np.uint64(32)).astype("<u2").tobytes()


def _joined(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)


def _heads(anchors):
    """Where each anchor of a sorted array begins, and how often it stands there."""
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return first, np.diff(np.append(first, len(anchors)))


def anchor_blobs(texts: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """``shard, part, local, low, high, numbers``: every anchor of a part once, with its first document
    there; where the part has more of them, the number is -1 - number. Rows that are ``local`` hold the
    anchors that several documents of a part have, with all of these; they go with the others, so that
    texts are read and hashed once."""
    def run(batches):
        for part, anchor, number in _part_anchors(batches, length, gram):
            first, count = _heads(anchor)
            several = np.repeat(count > 1, count)
            rows = [(part % shards, True, anchor[several], number[several])] if several.any() else []
            anchor, number = anchor[first], np.where(count > 1, -1 - number[first], number[first])
            shard = (anchor % np.uint64(shards)).astype(np.uint16 if shards <= 2 ** 16 else np.int64)
            by_shard = np.argsort(shard, kind="stable")
            anchor, number = anchor[by_shard], number[by_shard]
            bounds = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            rows += [(s, False, anchor[a:b], number[a:b]) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if a < b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()),
                 pa.array([r[1] for r in rows]), pa.array([_low(r[2]) for r in rows], pa.binary()),
                 pa.array([_high(r[2]) for r in rows], pa.binary()),
                 pa.array([r[3].astype("<i4").tobytes() for r in rows], pa.binary())],
                ["shard", "part", "local", "low", "high", "numbers"])

    return texts.select("part", "number", "text").mapInArrow(
        run, "shard int, part int, local boolean, low binary, high binary, numbers binary")


_ANSWER = "part int, number long, anchors binary, heads binary"
#: What a part gathers: anchors of single documents, anchors of all its documents that have them, and
#: which documents these are (as they came: short numbers, low and high bytes of the anchors).
_DIRECT, _GENERAL, _LOCAL = 0, 1, 2
_GATHERED = "part int, kind int, numbers binary, anchors binary, heads binary"
_NAMES = ["part", "kind", "numbers", "anchors", "heads"]


def _answers(part, number, anchor, head):
    """One row for each document of a part, with its anchors and their heads."""
    order = np.lexsort((anchor, number))
    number, anchor, head = number[order], anchor[order], head[order]
    first, count = _heads(number)
    cuts = list(zip(first.tolist(), (first + count).tolist()))
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(cuts), pa.int32()), pa.array(number[first]),
         pa.array([anchor[a:b].tobytes() for a, b in cuts], pa.binary()),
         pa.array([head[a:b].tobytes() for a, b in cuts], pa.binary())], ["part", "number", "anchors", "heads"])


def repeated_anchors(blobs: DataFrame, shards: int) -> DataFrame:
    """The anchors that more than one document has, with their heads: one row for each part and kind."""
    def run(batches):
        gathered = []
        for batch in batches:
            local = np.asarray(batch.column(2).to_pylist(), bool)
            if local.any():
                passed = batch.filter(pa.array(local))
                yield pa.RecordBatch.from_arrays(
                    [passed.column(1), pa.array([_LOCAL] * len(passed), pa.int32()), passed.column(5), passed.column(3),
                     passed.column(4)], _NAMES)
                batch = batch.filter(pa.array(~local))
            _, parts, _, low, high, numbers = (c.to_pylist() for c in batch.columns)
            for part, a, b, n in zip(parts, low, high, numbers):
                n = np.frombuffer(n, "<i4").astype(np.int64)
                gathered.append((np.full(len(n), part, np.int64), n, _joined(a, b)))
        if not gathered:
            return
        part, number, anchor = (np.concatenate(x) for x in zip(*gathered))
        place = part << 32 | np.where(number < 0, -1 - number, number)
        order = np.lexsort((place, anchor))
        part, number, anchor, place = part[order], number[order], anchor[order], place[order]
        first, count = _heads(anchor)
        head = np.repeat(place[first], count)
        wanted = np.flatnonzero(np.repeat(count > 1, count) | (number < 0))
        if not len(wanted):
            return
        kind = np.where(number[wanted] < 0, _GENERAL, _DIRECT)
        order = np.lexsort((kind, part[wanted]))
        wanted, kind = wanted[order], kind[order]
        first, count = _heads(part[wanted] * 2 + kind)
        cuts = [wanted[a:a + n] for a, n in zip(first.tolist(), count.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[wanted[first]].astype(np.int32)), pa.array(kind[first].astype(np.int32)),
             pa.array([number[c].tobytes() for c in cuts], pa.binary()),
             pa.array([anchor[c].tobytes() for c in cuts], pa.binary()),
             pa.array([head[c].tobytes() for c in cuts], pa.binary())], _NAMES)

    return blobs.repartition(shards, "shard").mapInArrow(run, _GATHERED)


def spread_answers(answers: DataFrame, shards: int) -> DataFrame:
    """The answers of every part, dealt out to its documents."""
    def deal(part, rows):
        held = {k: [r for r in rows if r[0] == k] for k in (_DIRECT, _GENERAL, _LOCAL)}
        column = lambda k, i, kind: np.concatenate([np.frombuffer(r[i], kind) for r in held[k]] or [np.zeros(0, kind)])
        number, anchor, head = (column(_DIRECT, i, t) for i, t in ((1, np.int64), (2, np.uint64), (3, np.int64)))
        if held[_GENERAL]:
            keys, heads = column(_GENERAL, 2, np.uint64), column(_GENERAL, 3, np.int64)
            order = np.argsort(keys, kind="stable")
            several = np.concatenate([_joined(low, high) for _, _, low, high in held[_LOCAL]])
            at = order[np.searchsorted(keys, several, sorter=order)]
            number = np.concatenate([number, column(_LOCAL, 1, "<i4")])
            anchor, head = np.concatenate([anchor, several]), np.concatenate([head, heads[at]])
        if len(number):
            yield _answers(part, number, anchor, head)

    def run(batches):
        part, rows = None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part:
                    if rows:
                        yield from deal(part, rows)
                    part, rows = own, []
                rows.append(row)
        if rows:
            yield from deal(part, rows)

    return answers.repartition(shards, "part").sortWithinPartitions("part").mapInArrow(run, _ANSWER)


# -- regions -------------------------------------------------------------------------------------

def regions(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``head, ord, row, start, region`` of rows ``row, ord, text, wanted`` (lists of anchors and heads)."""
    reach = length - gram

    def cut(data, offsets, owner, anchors, heads):
        """Text, head, begin and end of every region of a block; ``owner, anchors, heads`` are wanted."""
        hashes, least, inside = window_anchors(data, offsets, length, gram)
        # the largest of the minima of the windows around a gram equals it where it is one of them
        padded = np.zeros(len(least) + 2 * reach, np.uint64)
        np.copyto(padded[reach:reach + len(least)], least, where=inside)
        at = np.flatnonzero(_sliding(padded, reach + 1, np.maximum)[:len(hashes)] == hashes)
        text = np.searchsorted(offsets, at, "right") - 1
        keys = owner << np.uint64(48) | anchors
        order = np.argsort(keys)
        keys, heads = keys[order], heads[order]
        asked = text.astype(np.uint64) << np.uint64(48) | hashes[at]
        found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[found] == asked
        at, text, head = at[hit], text[hit], heads[found[hit]]
        order = np.lexsort((head, text))  # places ascend already
        at, text, head = at[order], text[order], head[order]
        begin, stop = np.maximum(at - reach, offsets[text]), np.minimum(at + length, offsets[text + 1])
        new = np.ones(len(at), bool)
        new[1:] = (text[1:] != text[:-1]) | (head[1:] != head[:-1]) | (begin[1:] > stop[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return text[first], head[first], begin[first], stop[last]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = flat(batch.column(2))
            lists = batch.column(3)
            pairs = lists.flatten()
            entries = np.diff(np.asarray(lists.offsets))
            sizes = np.array([len(x) // 8 for x in pairs.field(0).to_pylist()], np.int64)
            anchors, heads = (np.frombuffer(b"".join(pairs.field(k).to_pylist()), kind) for k, kind in ((0, np.uint64), (1, np.int64)))
            owner = np.repeat(np.repeat(np.arange(len(entries)), entries), sizes)
            for i, j in _pieces(offsets):
                mine = slice(*np.searchsorted(owner, [i, j]))
                if mine.start == mine.stop or offsets[j] - offsets[i] < length:  # no anchors to look for
                    continue
                part = data[offsets[i]:offsets[j]]
                text, head, begin, stop = cut(part, offsets[i:j + 1] - offsets[i], (owner[mine] - i).astype(np.uint64),
                                              anchors[mine], heads[mine])
                ends = np.cumsum(stop - begin)
                rest = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + (stop - begin), stop - begin)
                regions = pa.Array.from_buffers(pa.binary(), len(text), [
                    None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(part[rest].tobytes())])
                own = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(head), batch.column(1).take(own), batch.column(0).take(own),
                     pa.array(begin - (offsets[i:j] - offsets[i])[text]), regions], ["head", "ord", "row", "start", "region"])

    return texts.mapInArrow(run, "head long, ord long, row long, start long, region binary")


def repeated_windows(shards: DataFrame, length: int) -> DataFrame:
    """``row, ord, begin, stop``: runs of windows that a document with a smaller id has too, of rows
    ``head, ord, row, start, region`` that are sorted by head in each partition."""
    def solve(rows):
        sizes = np.array([len(r[4]) for r in rows])
        ords = np.array([r[1] for r in rows], np.int64)
        # byte values move up by two: 1 ends a region, 0 the text
        joined = np.frombuffer(b"\x00".join(r[4] for r in rows) + b"\x00", np.uint8).astype(np.uint16) + np.uint16(2)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        joined[begins + sizes] = 1
        text = np.append(joined, np.uint16(0))
        order = suffix_array(text, length)
        shared = shares_prefix(text, order, length)
        region = np.repeat(np.arange(len(rows)), sizes + 1)
        region = np.append(region, len(rows) - 1)
        fits = np.arange(len(text)) + length <= (begins + sizes)[region]
        owners = np.where(fits, ords[region], LAST)
        heads = np.flatnonzero(~(shared & fits)[order])
        least = np.minimum.reduceat(owners[order], heads)
        best = np.empty(len(text), np.int64)
        best[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
        at = np.flatnonzero(fits & (best < owners))
        if not len(at):
            return
        new = np.concatenate([[True], (np.diff(at) > 1) | (region[at[1:]] != region[at[:-1]])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        of = region[at[first]]
        shift = np.array([r[3] for r in rows], np.int64)[of] - begins[of]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[2] for r in rows], np.int64)[of]), pa.array(ords[of]),
             pa.array(at[first] + shift), pa.array(at[last] + length + shift)], ["row", "ord", "begin", "stop"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD_BYTES and rows[-1][0] != row[0]:
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) + 1
        if rows:
            yield from solve(rows)

    return shards.mapInArrow(run, "row long, ord long, begin long, stop long")


# -- the whole -----------------------------------------------------------------------------------

def _bucketed(df: DataFrame, column: str, buckets: int, label: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``column``; joins on it move nothing."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", os.path.join(shared_folder(spark), name)).option(
        "compression", "zstd").bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only; the files belong to the folder
    return out


def _numbered(df: DataFrame) -> DataFrame:
    """Rows ``row, ord, text`` with their task and number in it."""
    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array([part] * n, pa.int32()), pa.array(np.arange(at, at + n))],
                ["row", "ord", "text", "part", "number"])
            at += n

    return df.mapInArrow(run, "row long, ord long, text string, part int, number long")


def _remove(df: DataFrame, length: int) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of rows ``ord, text, cuts``."""
    def run(batches):
        for batch in batches:
            ords = batch.column(0).to_pylist()
            data, offsets = flat(batch.column(1))
            out = []
            for i, cuts in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[i]:offsets[i + 1]].tobytes()
                kept, at, removed, spans = [], 0, 0, 0
                for begin, stop in sorted((c["begin"], c["stop"]) for c in cuts or [] if c["ord"] == ords[i]):
                    if begin > at or not spans:
                        spans += 1
                        kept.append(raw[at:begin])
                        at = begin
                    if stop > at:
                        removed += stop - at
                        at = stop
                kept = b"".join(kept) + raw[at:]
                out.append((None if ords[i] == LAST else ords[i], len(raw), removed, spans,
                            hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], kind) for k, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return df.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept``,
    the bytes that remain."""
    spark = df.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("row", F.xxhash64("ord", "text"))
    digests = stored(base.select("row", "ord", F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                                 F.octet_length("text").cast("long").alias("n")), "repeat-digests")
    first = digests.groupBy("sha").agg(F.min(F.struct("ord", "row")).alias("first"))
    owners = first.select("sha", F.col("first.ord").alias("first_ord"), F.col("first.row").alias("row"))
    texts = _bucketed(_numbered(base.join(owners.select("row").distinct(), "row", "left_semi")
                                .select("row", "ord", "text")), "row", shards, "repeat_texts")

    dealt = spread_answers(repeated_anchors(anchor_blobs(texts, shards, length, gram), shards), shards)
    wanted = dealt.join(texts.select("part", "number", "row"), ["part", "number"]) \
        .groupBy("row").agg(F.collect_list(F.struct("anchors", "heads")).alias("wanted"))
    cut = regions(texts.join(wanted, "row").select("row", "ord", "text", "wanted"), length, gram)
    found = repeated_windows(cut.repartition(shards, "head").sortWithinPartitions("head"), length)
    cuts = found.groupBy("row").agg(F.collect_set(F.struct("ord", "begin", "stop")).alias("cuts"))
    parts = _remove(texts.join(cuts, "row", "left").select("ord", "text", "cuts"), length)

    copies = digests.join(owners.select("sha", "first_ord"), "sha").filter("ord > first_ord")
    whole = F.col("n") >= length
    covered = copies.select(
        F.when(F.col("ord") < LAST, F.col("ord")).alias("id"), F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_removed"), whole.cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"))
    return parts.unionByName(covered, allowMissingColumns=True).withColumnRenamed("id", id_col)
