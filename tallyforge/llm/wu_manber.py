"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``width`` consecutive benchmark words; an item of fewer words is one
pattern of its own length. Patterns of one length share a block shift table: the last two words of
the position under test say how far the search may jump. Where the shift is zero, the bucket of
that suffix holds the windows to test, a prefix check thins them, and a direct comparison of all
words confirms.

Defined results: null or empty texts have no words and no hits; items without words never occur; an
item without an id hits words but is in no list of items; equal items under one id are one; an empty
benchmark hits nothing; repeated rows are searched each on its own; extra columns pass through, whatever
their names, but in ``find_occurrences``, whose own three columns replace any of the same name. A text is
searched whole, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.bytesets import flat
from tallyforge.llm.common import named_columns, numbered_columns

#: Bytes of words after lowering A-Z: digits, a-z and every byte of a non-ASCII character.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
                   for b in range(256))
#: Benchmark words sent to the tasks at once (about 60 bytes each); more are searched in more passes.
SHARD_WORDS = 1_000_000
LANE = 512  # positions that one search pointer covers
_SHIFT_BITS = 18


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class PatternTable:
    """Patterns of one length with their shift table and suffix buckets."""

    width: int
    shift: np.ndarray      # block hash -> how far the end may move
    patterns: np.ndarray   # (n, width) word numbers, sorted by the hash of the last block
    suffix: np.ndarray     # hash of the last block of each pattern, ascending
    prefixes: np.ndarray   # first word of each pattern
    owners: list           # items of each pattern

    @staticmethod
    def block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)

    @classmethod
    def build(cls, width: int, windows: dict[tuple, set]) -> PatternTable:
        patterns = np.array(sorted(windows), dtype=np.int64).reshape(-1, width)
        block = min(2, width)
        shift = np.full(1 << _SHIFT_BITS, width - block + 1, np.int64)
        for end in range(block, width + 1):
            first, last = patterns[:, end - block], patterns[:, end - 1]
            np.minimum.at(shift, cls.block_hash(first, last), width - end)
        suffix = cls.block_hash(patterns[:, width - block], patterns[:, -1])
        order = np.argsort(suffix, kind="stable")
        patterns = patterns[order]
        return cls(width, shift, patterns, suffix[order], patterns[:, 0],
                   [sorted(windows[tuple(p)]) for p in patterns.tolist()])

    def search(self, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(start position, pattern number) of every occurrence that lies inside one text."""
        width, back = self.width, min(2, self.width) - 1
        # one pointer per lane of end positions; every lane starts where a whole window fits
        lanes, stops = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= width:
                at = np.arange(a + width - 1, b, LANE)
                lanes.append(at)
                stops.append(np.minimum(at + LANE, b))
        if not lanes:
            return []
        pointer, stop = np.concatenate(lanes), np.concatenate(stops)
        hashes = self.block_hash(words[:len(words) - back], words[back:])
        found = []
        while len(pointer):
            move = self.shift[hashes[pointer - back]]
            zero = pointer[move == 0]
            if len(zero):
                found += self._confirm(words, hashes, zero, back)
            pointer = pointer + np.maximum(move, 1)
            on = pointer < stop
            pointer, stop = pointer[on], stop[on]
        return found

    def _confirm(self, words, hashes, ends, back):
        keys = hashes[ends - back]
        low, high = np.searchsorted(self.suffix, keys, "left"), np.searchsorted(self.suffix, keys, "right")
        counts = high - low
        which = np.repeat(np.arange(len(ends)), counts)
        candidates = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        starts = ends[which] - self.width + 1
        fits = self.prefixes[candidates] == words[starts]
        starts, candidates = starts[fits], candidates[fits]
        for k in range(1, self.width):
            if not len(starts):
                break
            fits = self.patterns[candidates, k] == words[starts + k]
            starts, candidates = starts[fits], candidates[fits]
        return list(zip(starts.tolist(), candidates.tolist()))


class Patterns:
    """All pattern tables of a group of benchmark items, and the numbers of their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.numbers: dict[bytes, int] = {}
        by_width: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            n = min(width, len(ids))
            if n:
                windows = by_width.setdefault(n, {})
                for i in range(len(ids) - n + 1):
                    windows.setdefault(tuple(ids[i:i + n]), set()).update([] if item is None else [item])
        self.tables = [PatternTable.build(n, w) for n, w in sorted(by_width.items())]

    def scan(self, texts: list[bytes]):
        """Per text: number of words, hit spans (start, end) of words, items that occur."""
        number = self.numbers.get
        lists = [[number(w, 0) for w in words_of(t)] for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        words = np.fromiter((n for x in lists for n in x), np.int64, offsets[-1])
        spans = [[] for _ in texts]
        items = [set() for _ in texts]
        for table in self.tables:
            for start, pattern in table.search(words, offsets):
                i = int(np.searchsorted(offsets, start, "right")) - 1
                at = start - int(offsets[i])
                spans[i].append((at, at + table.width))
                items[i].update(table.owners[pattern])
        return [len(x) for x in lists], [merged(s) for s in spans], [sorted(i) for i in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "wm_words long, wm_spans array<struct<start:long,end:long>>, wm_items array<string>"


def _shards(items: DataFrame, shard_words: int) -> int:
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    return int(size // shard_words) + 1


def find_occurrences(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                     item_text: str = "text", width: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``wm_words`` (their number), ``wm_spans`` (maximal runs of hit words) and
    ``wm_items`` (those that occur, as strings).

    The benchmark goes to the tasks in shards of at most about ``shard_words`` words, one pass over
    the rows for each, so a broadcast never grows with the benchmark.
    """
    spark = docs.sparkSession
    shared = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).distinct()
    shards = _shards(shared, shard_words)
    out = docs
    for shard in range(shards):
        # by id and text, so that items of one text are spread as well
        part = shared if shards == 1 else shared.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        items = [(r["item"], (r["text"] or "").encode()) for r in part.collect()]
        out = _pass(out, spark.sparkContext.broadcast(items), text_col, width, first=shard == 0)
    return out


def _pass(docs: DataFrame, shared, text_col: str, width: int, first: bool) -> DataFrame:
    added = T._parse_datatype_string(_FOUND)
    names = [c for c in docs.columns if c.lower() not in added.fieldNames()]
    schema = T.StructType([docs.schema[c] for c in names] + added.fields)

    def search(batches):
        patterns = Patterns(shared.value, width)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = flat(column)
            raw = data.tobytes()
            counts, spans, items = [], [], []
            for i in range(0, len(column), 500):
                bounds = offsets[i:i + 501].tolist()
                a, b, c = patterns.scan([raw[x:y] for x, y in zip(bounds[:-1], bounds[1:])])
                counts += a
                spans += b
                items += c
            if not first:
                old = batch.column(batch.schema.get_field_index("wm_spans")).to_pylist()
                was = batch.column(batch.schema.get_field_index("wm_items")).to_pylist()
                spans = [merged(s + [(x["start"], x["end"]) for x in o]) for s, o in zip(spans, old)]
                items = [sorted({*s, *o}) for s, o in zip(items, was)]
            pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(counts, pa.int64()),
                   pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pair)),
                   pa.array(items, pa.list_(pa.string()))],
                names + added.fieldNames())

    return docs.mapInArrow(search, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """Per document: words, hit words, occurring items and whether anything was hit."""
    found = find_occurrences(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, **options)
    hits = F.aggregate("wm_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col("id").alias(id_col), F.col("wm_words").alias("n_words"), hits.alias("n_hit"),
        F.size("wm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("wm_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    found = find_occurrences(numbered_columns(docs), benchmark, text_col=f"c{docs.columns.index(text_col)}", **options)
    return named_columns(found.filter(F.size("wm_spans") == 0), docs.columns)
