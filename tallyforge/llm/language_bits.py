"""Language identification with a bit-sliced Bloom filter.

Row ``r`` of the filter is a bitmask of languages. An n-gram's rows, found by its hashes, are ANDed:
the set bits are the languages that (probably) contain it. Per language the set bits of all n-grams
of a text are counted, corrected for the false positives that the filter's fill predicts, and the
largest corrected count decides.

N-grams are runs of 3 and 4 characters of the lowered text, where every run of non-letters reads as
one blank, without a blank inside; a language contains an n-gram when it is frequent there (share of
sampled documents at least ``least_share``) and not much rarer than in its most typical language.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text of letters
without known n-grams gets the most frequent language, with its share as score; ties go to the more
frequent language, then by name; repeated rows are scored alike; without training rows every text is
``und``; extra columns pass through. A text is read whole; memory follows the longest one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.hashing import hash_unit
from tallyforge.llm.bytesets import mix

SIZES = (3, 4)
BLOCK_CHARS = 1_000_000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def text_blocks(texts: list[str | None]):
    """Ranges of texts with about ``BLOCK_CHARS`` characters together."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < BLOCK_CHARS):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of every n-gram, ordered by text, and whether each text has letters."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.concatenate([[0], owner])
    letter = _letter_table()[points]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    points, owner, letter = np.where(letter, points, 0)[keep].astype(np.uint64), owner[keep], letter[keep]
    hashes, owners = [], []
    for n in SIZES:
        count = len(points) - n + 1
        if count <= 0:
            continue
        code = np.full(count, n, np.uint64)
        fits = np.ones(count, bool)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + points[k:k + count]
            if 0 < k < n - 1:
                fits &= letter[k:k + count]
        hashes.append(mix(code[fits]))
        owners.append(owner[1:1 + count][fits])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order], has


@dataclass
class LanguageBits:
    """The filter: ``rows`` (one mask, or several words of it, per row), the languages in bit order
    (most frequent first), their shares, and the expected false positive rate of each."""

    languages: list[str]
    shares: list[float]
    rows: np.ndarray
    hashes: int = 3

    @classmethod
    def build(cls, languages, shares, grams: dict[str, np.ndarray], hashes: int = 3, bits_per_gram: int = 16):
        count = max((len(g) for g in grams.values()), default=1)
        size = 1 << max(10, int(np.ceil(np.log2(count * bits_per_gram))))
        kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64))
                    if len(languages) <= n or n == 64)
        words = -(-len(languages) // (np.dtype(kind).itemsize * 8))
        self = cls(languages, shares, np.zeros((max(words, 1), size), kind), hashes)
        for bit, language in enumerate(languages):
            word, place = divmod(bit, np.dtype(kind).itemsize * 8)
            for rows in self.positions(grams.get(language, np.zeros(0, np.uint64))):
                np.bitwise_or.at(self.rows[word], rows, kind(1 << place))
        return self

    def positions(self, hashed: np.ndarray):
        size = np.uint64(self.rows.shape[1] - 1)
        step = (hashed >> np.uint64(32)) | np.uint64(1)
        for i in range(self.hashes):
            yield ((hashed + np.uint64(i) * step) & size).astype(np.int64)

    def bit(self, masks: np.ndarray, place: int) -> np.ndarray:
        return (masks >> masks.dtype.type(place)) & masks.dtype.type(1)

    def false_rates(self) -> np.ndarray:
        width = self.rows.dtype.itemsize * 8
        fill = [self.bit(self.rows[b // width], b % width).mean() for b in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def counts(self, hashed: np.ndarray, owners: np.ndarray, texts: int) -> np.ndarray:
        """Corrected number of n-grams that each language contains, by text."""
        bounds = np.searchsorted(owners, np.arange(texts + 1))
        total = np.diff(bounds)
        width = self.rows.dtype.itemsize * 8
        places = list(self.positions(hashed))
        out = np.zeros((texts, len(self.languages)))
        for word in range(self.rows.shape[0]):
            masks = self.rows[word][places[0]]
            for p in places[1:]:
                masks = masks & self.rows[word][p]
            for bit in range(word * width, min((word + 1) * width, len(self.languages))):
                sums = np.concatenate([[0], np.cumsum(self.bit(masks, bit - word * width), dtype=np.int64)])
                out[:, bit] = sums[bounds[1:]] - sums[bounds[:-1]]
        rates = self.false_rates()
        return np.maximum(0, (out - total[:, None] * rates) / (1 - np.minimum(rates, 0.999)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i, j in text_blocks(texts):
            hashed, owners, has = ngrams(texts[i:j])
            if not self.languages:
                names += ["und"] * (j - i)
                scores += [0.0] * (j - i)
                continue
            counts = self.counts(hashed, owners, j - i)
            best = counts.argmax(axis=1)  # the first of equals: the more frequent language
            total = counts.sum(axis=1)
            for k in range(j - i):
                if not has[k]:
                    names.append("und")
                    scores.append(0.0)
                elif total[k] <= 0:
                    names.append(self.languages[0])
                    scores.append(float(self.shares[0]))
                else:
                    names.append(self.languages[best[k]])
                    scores.append(float(counts[k, best[k]] / total[k]))
        return names, scores


def learn_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    sample_rows: int = 2000, least_share: float = 0.004, typical: float = 0.35,
                    max_languages: int = 1000) -> LanguageBits:
    """The filter of a labelled table.

    Learns from about ``sample_rows`` documents of each language, chosen by a hash of the id. A language
    has at most its mean number of different n-grams a document over ``least_share`` n-grams, so what
    reaches the driver follows the number of languages; more than ``max_languages`` are refused.
    """
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = [r["lang"] for r in found]
    if not languages:
        return LanguageBits.build([], [], {})
    spark = labelled.sparkSession
    rates = spark.createDataFrame([(i, r["lang"], min(1.0, sample_rows / r["count"])) for i, r in enumerate(found)],
                                  "number int, lang string, rate double")
    sample = labelled.join(F.broadcast(rates), "lang").filter(hash_unit("id", "language") < F.col("rate")) \
        .select("number", "text")

    def count(batches):
        for batch in batches:
            texts, numbers = batch.column(1).to_pylist(), np.array(batch.column(0).to_pylist(), np.uint64)
            grams, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for i, j in text_blocks(texts):
                hashed, owners, _ = ngrams(texts[i:j])
                # each n-gram of a text once; a mixed pair stands for (n-gram, text), later (n-gram, language)
                _, first = np.unique(mix(hashed + mix(owners.astype(np.uint64))), return_index=True)
                grams.append(hashed[first])
                of.append(numbers[i:j][owners[first]])
            grams, of = np.concatenate(grams), np.concatenate(of)
            _, first, n = np.unique(mix(grams + mix(of)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[first].astype(np.int32)), pa.array(grams[first].view(np.int64)), pa.array(n.astype(np.int64))],
                ["number", "gram", "docs"])

    sizes = sample.groupBy("number").agg(F.count("*").alias("size"))
    grams = (sample.mapInArrow(count, "number int, gram long, docs long").groupBy("number", "gram")
             .agg(F.sum("docs").alias("docs")).filter("docs >= 2").join(F.broadcast(sizes), "number")
             .withColumn("share", F.col("docs") / F.col("size")).filter(F.col("share") >= least_share))
    typical_of = grams.groupBy("gram").agg(F.max("share").alias("most"))
    kept = (grams.join(typical_of, "gram").filter(F.col("share") >= typical * F.col("most"))
            .select("number", "gram").collect())
    by_language: dict[str, list[int]] = {}
    for r in kept:
        by_language.setdefault(languages[r["number"]], []).append(r["gram"])
    total = sum(r["count"] for r in found)
    return LanguageBits.build(languages, [r["count"] / total for r in found],
                              {k: np.array(v, np.int64).view(np.uint64) for k, v in by_language.items()})


def identify_languages(df: DataFrame, model: LanguageBits, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` of its texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([df.schema[c] for c in names]
                          + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        for batch in batches:
            languages, scores = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(languages, pa.string()), pa.array(scores, pa.float64())], schema.fieldNames())

    return df.mapInArrow(predict, schema)
