"""Language identification with bit-sliced Bloom filters over byte 4-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, lower_bytes, row_sums, small_batches

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


@dataclass(frozen=True)
class LanguageParams:
    """``train_rows`` bounds the labelled rows fitted on in each language; ``slots`` is a power of two.

    An n-gram is in a language's filter if its share there is at least ``min_share`` and ``ratio`` of its share in any other.
    """

    train_rows: int = 1500
    slots: int = 1 << 20
    min_share: float = 2e-5
    ratio: float = 0.3
    min_score: float = 0.25
    min_lead: float = 0.02


def _grams(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all 4-byte windows of each row, padded with a blank at both ends, runs of other characters as one blank; row offsets."""
    n = len(offsets) - 1
    padded = np.full(len(b) + 2 * n, 32, dtype=np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(b)) + 2 * row + 1] = _LETTERS[lower_bytes(b)]
    at = offsets + 2 * np.arange(n + 1)
    blank = padded == 32
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1]] = True
    t = padded[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    if len(t) < 4:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    w = t.astype(np.uint32)
    key = w[:-3] | (w[1:-2] << np.uint32(8)) | (w[2:-1] << np.uint32(16)) | (w[3:] << np.uint32(24))
    ok = np.ones(len(t), dtype=bool)
    for j in (1, 2, 3):
        ok[np.maximum(at[1:] - j, at[:-1])] = False
    ok = ok[: len(key)]
    return key[ok], np.concatenate([[0], np.cumsum(ok)])[np.minimum(at, len(key))]


def _slots(key: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint32(32 - int(math.log2(slots)))
    mixed = key ^ (key >> np.uint32(15))
    return (mixed * _M1) >> shift, ((mixed ^ (key >> np.uint32(7))) * _M2) >> shift


@dataclass(frozen=True)
class LanguageModel:
    """``table[slot]`` holds one bit a language; ``rates`` are the filters' false-positive rates."""

    languages: tuple[str, ...]
    table: np.ndarray
    rates: np.ndarray
    params: LanguageParams

    def masks(self, key: np.ndarray) -> np.ndarray:
        """All languages whose filter holds each n-gram."""
        one, two = _slots(key, self.params.slots)
        return self.table[one] & self.table[two]

    def score(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Each text's share of n-grams in each language, without expected false positives, and its number of n-grams."""
        scores, counts = [], []
        for lo, hi, b, offsets in chunks(column):
            key, at = _grams(b, offsets)
            n = np.diff(at)
            m = self.masks(key)
            hits = np.zeros((hi - lo, len(self.languages)))
            for i in range(len(self.languages)):
                hits[:, i] = row_sums((m >> m.dtype.type(i)) & m.dtype.type(1), at)
            scores.append(np.clip((hits - n[:, None] * self.rates) / np.maximum(1 - self.rates, 1e-9), 0, None) / np.maximum(n, 1)[:, None])
            counts.append(n)
        if not scores:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        return np.concatenate(scores), np.concatenate(counts)

    def decide(self, column) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language ('und' if undecided), best score, lead over the second, n-grams."""
        scores, n = self.score(column)
        if not len(self.languages):
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), n
        order = np.argsort(-scores, axis=1, kind="stable")
        rows = np.arange(len(n))
        best = scores[rows, order[:, 0]]
        lead = best - (scores[rows, order[:, 1]] if scores.shape[1] > 1 else 0)
        ok = (n > 0) & (best >= self.params.min_score) & (lead >= self.params.min_lead)
        return [self.languages[i] if k else "und" for i, k in zip(order[:, 0], ok, strict=True)], best, lead, n


def train_language_model(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit the filters on at most ``train_rows`` labelled rows of each language, chosen by a hash of doc_id.

    Rows with null doc_id, and null or empty lang or text, are not fitted on; of rows that repeat an id the smallest text is. More than 64 languages raise ValueError. Without labelled rows
    the model has no language and decides 'und' for all.
    """
    labelled = docs.select("doc_id", "lang", "text").filter("lang is not null and lang <> '' and text is not null and text <> ''")
    small_batches(docs.sparkSession)
    ids = labelled.select("doc_id", "lang").filter("doc_id is not null").distinct().withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(256)))
    for parts in (["lang", "_part"], ["lang"]):  # first inside parts, so that no task ranks all of a language
        w = Window.partitionBy(*parts).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= params.train_rows)
    sample = labelled.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                rows = batch.column("text").filter(pa.array(langs == lang))
                for _, _, b, offsets in chunks(rows):
                    keys, n = np.unique(_grams(b, offsets)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n >= 2").toPandas()
    languages = tuple(sorted(counted["lang"].unique()))
    if len(languages) > 64:
        raise ValueError(f"{len(languages)} languages; a mask holds 64")
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros(params.slots, dtype=kind)
    keys = np.unique(counted["gram"].to_numpy(np.int64))
    share = np.zeros((len(keys), len(languages)))
    for i, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        share[np.searchsorted(keys, own["gram"].to_numpy(np.int64)), i] = own["n"].to_numpy() / own["n"].sum()
    top = share.max(axis=1) if len(languages) else np.zeros(0)
    for i in range(len(languages)):
        inside = keys[(share[:, i] >= params.min_share) & (share[:, i] >= params.ratio * top)].astype(np.uint32)
        for slot in _slots(inside, params.slots):
            np.bitwise_or.at(table, slot, kind(1 << i))
    rates = np.array([float(((table >> kind(i)) & kind(1)).mean()) ** 2 for i in range(len(languages))])
    return LanguageModel(languages, table, rates, params)


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row for each input row: doc_id, language, score, lead, ngrams, keep (the language was decided).

    Null and empty texts, and texts without letters, get 'und', keep false. Ties within ``min_lead`` get 'und'. Repeated
    rows give repeated results, other columns are ignored, an empty table gives no rows; long texts are read whole.
    """
    small_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, best, lead, n = cast.value.decide(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.round(best, 6)), pa.array(np.round(lead, 6)), pa.array(n.astype(np.int64)), pa.array([x != "und" for x in lang], pa.bool_())],
                names=["doc_id", "language", "score", "lead", "ngrams", "keep"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, language string, score double, lead double, ngrams long, keep boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language was decided, with all their columns."""
    small_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x != "und" for x in cast.value.decide(batch.column(at))[0]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
