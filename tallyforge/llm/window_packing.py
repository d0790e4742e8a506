"""Packing of token sequences into windows by non-negative least squares.

Documents are cut into whole windows and one remainder. The lengths of all pieces form a histogram
of at most ``window`` numbers. Shallow combinations of lengths that fill a window exactly (a length
repeated with its complement, and triples) are enumerated, non-negative least squares fits how often
each should be used to the histogram, the counts are rounded within what there is, and the residual
pieces are packed greedily, longest first, cutting the piece that crosses a window's end. So only the
very last window can be short.

Which piece goes where follows from its rank among the pieces of its length: a rank inside the task
that tokenised it plus the count of earlier tasks. The token table is written once, so ranks stay
what they are when executors are lost.

Defined results: null text counts as empty and gives one piece, the end id alone; repeated rows and
null ids are documents like others; an empty table gives no pieces; extra columns are ignored. The
tokens of a text are all kept, in order; memory follows the longest text.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.bytesets import blocks, flat
from tallyforge.llm.common import stored
from tallyforge.session import broadcast_if_small

WINDOW = 2048
END_ID = 1
CACHE_RUNS = 150_000
#: Anything but white space, printable ASCII and precomposed Latin letters; texts without it are cut
#: into runs here, as no normalisation changes them but lowering.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]")
#: Fixed by the tokenizer: its contractions, runs of letters, single digits, runs of other marks.
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u017e]+|[0-9]|"
                   "[^\\sa-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u017e]+")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts by a byte-level tokenizer that encodes runs of letters, digits and marks one by one.

    Runs repeat, so their ids are remembered in two generations of about ``CACHE_RUNS`` each: when the
    younger one is full it becomes the older one, and a run met again moves up, so frequent runs stay.
    New runs go straight to the tokenizer's model, spelled in its letters for bytes. Texts with other
    characters or special tokens are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or "(?!)")
        self.spelling = {c: "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c)))
                         for c in range(0xc0, 0x17f)}
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _encode_run(self, run: str) -> bytes:
        spelled = run if run.isascii() else run.translate(self.spelling)
        return np.array([t.id for t in self.model.tokenize(spelled)], self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [(not _OTHER.search(t)) and not self.special.search(t) for t in texts]
        cut = [_RUNS.findall(t.lower()) if p else [] for t, p in zip(texts, plain)]
        known, older = self.runs, self.older
        new: set[str] = set()
        for runs in cut:
            new.update(set(runs).difference(known))
        for run in new:
            known[run] = older.get(run) or self._encode_run(run)
        out = [b"".join([known[r] for r in runs]) if p else self._encode(t) for t, p, runs in zip(texts, plain, cut)]
        if len(known) > CACHE_RUNS:
            self.runs, self.older = {}, known
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``window`` ids: ``id, start, length, ids, doc_tokens, part, rank``.

    ``ids`` holds the ids as little-endian integers of two or four bytes, after the vocabulary;
    ``rank`` numbers the pieces of one length inside their task ``part``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)] + T._parse_datatype_string(
        "start long, length int, ids binary, doc_tokens long, part int, rank long").fields)

    def cut(batches):
        own = encoder(tokenizer_path)
        end, size = np.array([end_id], own.kind).tobytes(), own.kind.itemsize
        part, ranks = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            raw = data.tobytes()
            for i, j in blocks(offsets, 4_000_000):
                texts = [raw[offsets[k]:offsets[k + 1]].decode() for k in range(i, j)]
                owners, starts, lengths, pieces, totals, places = [], [], [], [], [], []
                for k, encoded in enumerate(own.encode(texts), i):
                    encoded += end
                    total = len(encoded) // size
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        owners.append(k)
                        starts.append(start)
                        lengths.append(length)
                        pieces.append(encoded[start * size:(start + length) * size])
                        totals.append(total)
                        places.append(ranks[length])
                        ranks[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int32()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64()),
                     pa.array([part] * len(owners), pa.int32()), pa.array(places, pa.int64())], schema.fieldNames())

    return rows.mapInArrow(cut, schema)


# -- the plan: how often each combination of lengths is used -------------------------------------

def combinations(counts: np.ndarray, window: int, depth: int = 8, triples: int = 6) -> list[tuple[int, ...]]:
    """Lengths that fill a window: up to ``depth`` pieces of one length with the complement, and for
    each length the ``triples`` triples whose other lengths are the most frequent."""
    there = np.flatnonzero(counts[:window])
    there = there[there > 0]
    found = set()
    for a in there.tolist():
        for k in range(1, min(depth, window // a) + 1):
            rest = window - k * a
            if rest == 0 or counts[rest]:
                found.add(tuple(sorted([a] * k + [rest] * (rest > 0))))
        others = there[(there < window - a)]
        thirds = window - a - others
        fits = counts[thirds] > 0
        others, thirds = others[fits], thirds[fits]
        weight = np.minimum(counts[others], counts[thirds])
        for i in np.argsort(-weight, kind="stable")[:triples]:
            found.add(tuple(sorted((a, int(others[i]), int(thirds[i])))))
    return sorted(found)


def fit_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares for the repeat counts, by accelerated projected gradients."""
    rows = np.array([p for ps in patterns for p in ps])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])

    def forward(x):
        return np.bincount(rows, x[cols], minlength=len(counts))

    def backward(y):
        return np.bincount(cols, y[rows], minlength=len(patterns))

    goal = counts.astype(np.float64)
    v = np.ones(len(patterns))
    for _ in range(30):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(z - backward(forward(z) - goal) / (norm * 1.01), 0)
        grown = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        z = new + (momentum - 1) / grown * (new - x)
        x, momentum = new, grown
    return x


@dataclass
class PackingPlan:
    """Slots ``(length, first rank, sequence, offset)`` sorted by length and rank, and where the
    residual pieces of each length begin in the stream that follows the planned sequences."""

    window: int
    slot_keys: np.ndarray
    slot_ends: np.ndarray
    slot_sequence: np.ndarray
    slot_offset: np.ndarray
    used: np.ndarray
    stream: np.ndarray
    first_residual: int

    @classmethod
    def build(cls, counts: np.ndarray, window: int) -> PackingPlan:
        left = counts.astype(np.int64).copy()
        slots, sequence = [], 0

        def use(pattern, times):
            nonlocal sequence
            offset = 0
            for length in pattern:
                slots.append((length, int(counts[length] - left[length]), times, sequence, offset))
                left[length] -= times
                offset += length
            sequence += times

        if left[window]:
            use((window,), int(left[window]))
        patterns = combinations(left, window)
        if patterns:
            fitted = fit_counts(patterns, np.where(np.arange(window + 1) < window, left, 0))
            for i in np.argsort(-fitted, kind="stable"):
                times = int(fitted[i] + 0.5)
                for length in set(patterns[i]):
                    times = min(times, int(left[length]) // patterns[i].count(length))
                if times > 0:
                    use(patterns[i], times)
        stream, at = np.zeros(window + 1, np.int64), 0
        for length in range(window, 0, -1):
            stream[length] = at
            at += int(left[length]) * length
        slots.sort()
        array = np.array(slots, np.int64).reshape(-1, 5)
        return cls(window, array[:, 0] << 48 | array[:, 1], array[:, 1] + array[:, 2], array[:, 3], array[:, 4],
                   counts - left, stream, sequence)

    def place(self, lengths: np.ndarray, ranks: np.ndarray):
        """(sequence, offset) of each piece; a residual piece may run over its window's end."""
        slot = np.searchsorted(self.slot_keys, lengths.astype(np.int64) << 48 | ranks, "right") - 1
        planned = ranks < self.used[lengths]
        at = self.stream[lengths] + (ranks - self.used[lengths]) * lengths
        sequence = self.first_residual + at // self.window
        offset = at % self.window
        if len(self.slot_keys):
            own = np.maximum(slot, 0)
            first = self.slot_keys[own] & ((1 << 48) - 1)
            sequence = np.where(planned, self.slot_sequence[own] + ranks - first, sequence)
            offset = np.where(planned, self.slot_offset[own], offset)
        return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian), ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``."""
    pieces = stored(token_pieces(docs, tokenizer_path, id_col, text_col, window, end_id), "token-pieces")
    by_part = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(window + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        counts[r["length"]] = r["n"]
    spark = docs.sparkSession
    plan = spark.sparkContext.broadcast(PackingPlan.build(counts, window))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = pieces.join(broadcast_if_small(bases), ["part", "length"]).select(
        "id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens",
        (F.col("base") + F.col("rank")).alias("rank"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + T._parse_datatype_string(
        "start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields)

    def place(batches):
        for batch in batches:
            starts, lengths, ranks = (np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), np.int64)
                                      for c in ("start", "length", "rank"))
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            sequence, offset = plan.value.place(lengths, ranks)
            rows, out = [], [[] for _ in range(6)]
            for i, raw in enumerate(ids):
                size = len(raw) // int(lengths[i])
                first = min(int(lengths[i]), window - int(offset[i]))
                parts = [(0, first, int(sequence[i]), int(offset[i]))]
                if first < lengths[i]:
                    parts.append((first, int(lengths[i]) - first, int(sequence[i]) + 1, 0))
                for begin, length, where, at in parts:
                    piece = raw[begin * size:(begin + length) * size]
                    wide = np.frombuffer(piece, f"<u{size}").astype("<u4").tobytes()
                    rows.append(i)
                    for column, value in zip(out, (int(starts[i]) + begin, length, piece, zlib.crc32(wide), where, at)):
                        column.append(value)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64()),
                 batch.column(batch.schema.get_field_index("doc_tokens")).take(rows),
                 pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64())], schema.fieldNames())

    return placed.mapInArrow(place, schema)
