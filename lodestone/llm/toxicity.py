"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, fitted to document labels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U, chunks, lower_bytes, shared_dir, small_batches, span_hashes, stored, words

PREFIXES = (4, 6)
_END = np.zeros(256, dtype=bool)
_END[[*map(ord, ".!?\n")]] = True


@dataclass(frozen=True)
class ToxicityParams:
    """``train_rows`` bounds the labelled documents fitted on, half of them toxic if there are enough. A feature
    marks nothing that fewer toxic ones have than a share of ``toxic_share`` of them, 2 at least and ``min_toxic`` at most."""

    train_rows: int = 8000
    buckets: int = 1 << 18
    min_toxic: int = 5
    toxic_share: float = 0.015
    steps: int = 60
    rate: float = 0.5
    sparsity: float = 0.002
    document_threshold: float = 0.5
    sentence_threshold: float = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float


def _sentences(b: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Three features a word (itself and its beginnings of ``PREFIXES`` bytes), each sentence's first word and its row, word starts and ends."""
    low = lower_bytes(b)
    starts, ends, at = words(low, offsets)
    stems = [span_hashes(low, starts, np.minimum(ends, starts + n)) ^ U(0x9E3779B97F4A7C15 + n - 6) for n in PREFIXES]
    f = (np.stack([span_hashes(low, starts, ends), *stems], axis=1) & U(buckets - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    mark = np.cumsum(_END[b])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return f, first, row[first], starts, ends


def evidence(pos: np.ndarray, neg: np.ndarray, toxic: float, clean: float, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each feature, less 1.64 standard errors, and which can mark a sentence: not what few toxic documents have, or clean ones have as well."""
    odds = np.log((pos + 0.5) / (toxic + 1)) - np.log((neg + 0.5) / (clean + 1)) - 1.64 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    least = min(params.min_toxic, max(2, math.ceil(params.toxic_share * toxic)))
    return odds, (pos >= least) & (odds > 1)


def fit_toxicity(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, params: ToxicityParams) -> ToxicityModel:
    """Fit to documents given as their features and the index of each sentence's first one."""
    pos, neg = np.zeros(params.buckets), np.zeros(params.buckets)
    for (f, _), toxic in zip(docs, y, strict=True):
        (pos if toxic else neg)[np.unique(f)] += 1
    odds, usable = evidence(pos, neg, y.sum(), len(y) - y.sum(), params)
    kept = [np.flatnonzero(usable[f]) for f, _ in docs]
    features = [f[k] for (f, _), k in zip(docs, kept, strict=True)]
    sentences = [np.searchsorted(first, k, side="right") - 1 for (_, first), k in zip(docs, kept, strict=True)]
    return _solve(features, sentences, np.array([len(first) for _, first in docs], np.int64), y, odds, params)


def _solve(features: list[np.ndarray], sentences: list[np.ndarray], n_sentences: np.ndarray, y: np.ndarray, odds: np.ndarray, params: ToxicityParams) -> ToxicityModel:
    """Proximal AdaGrad over the usable features of each document and the sentences that hold them.

    A sentence's score is the logistic of the sum of its words' weights and the bias; a document's is 1 - prod(1 - score).
    Without documents of both kinds the model finds nothing toxic.
    """
    w = np.zeros(params.buckets, np.float32)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(w, -20.0)
    base = np.concatenate([[0], np.cumsum(n_sentences)[:-1]])
    doc = np.repeat(np.arange(len(y)), n_sentences)
    ids, at = np.unique(np.concatenate(features), return_inverse=True)
    sentence = np.concatenate([s + b for s, b in zip(sentences, base, strict=True)]).astype(np.int64)
    v = np.clip(odds[ids], 0, 6)
    bias, bias_sum, squares = -6.0, 1e-6, np.full(len(ids), 1e-6)
    n, share = len(doc), 1 / len(y)
    for _ in range(params.steps):
        z = bias + np.bincount(sentence, v[at], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        q = np.bincount(doc, np.logaddexp(0, z), len(y))
        pull = np.where(y > 0, -1 / np.expm1(np.clip(q, 1e-6, 50)), 1.0)
        gz = pull[doc] * p * share
        g = np.bincount(at, gz[sentence], len(ids))
        squares += g * g
        step = params.rate / np.sqrt(squares)
        v = np.maximum(v - step * (g + params.sparsity * share), 0)
        bias_sum += gz.sum() ** 2
        bias = min(bias - params.rate * gz.sum() / np.sqrt(bias_sum), -6.0)
    w[ids] = v
    w[w < 1.0] = 0  # a weak word never adds up over a long sentence
    return ToxicityModel(w, float(bias))


def train_toxicity_model(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on at most ``train_rows`` labelled documents, chosen by a hash of doc_id, toxic ones first up to half.

    Null ids, null labels and labels without a document are not used; where labels of an id disagree, the largest counts.
    Of rows that repeat an id the smallest text is fitted on. The driver gets two counts a feature, then of each document the
    features that can mark a sentence and no other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("_y = 1").orderBy(*order).limit(params.train_rows // 2).unionByName(known.filter("_y = 0").orderBy(*order).limit(params.train_rows // 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("_y").alias("_y"), F.min("text").alias("text"))
    rows = stored(rows.select("doc_id", "_y", "text"), f"{shared_dir(spark)}/labelled")
    buckets = params.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets + 1), np.int64)
        for batch in batches:
            y = batch.column("_y").to_numpy()
            for lo, hi, b, offsets in chunks(batch.column("text")):
                f, first, row, _, _ = _sentences(b, offsets, buckets)
                own = np.unique(np.repeat(row, np.diff(np.append(first, len(f))))[:, None] * buckets + f)
                for kind in (0, 1):
                    some = y[lo:hi] == kind
                    sums[kind, :buckets] += np.bincount(own[some[own // buckets]] % buckets, minlength=buckets)
                    sums[kind, buckets] += some.sum()
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[1, at]), pa.array(sums[0, at])], names=["feature", "pos", "neg"])

    counted = rows.mapInArrow(count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg = np.zeros(buckets + 1), np.zeros(buckets + 1)
    pos[counted["feature"].to_numpy()], neg[counted["feature"].to_numpy()] = counted["pos"].to_numpy(), counted["neg"].to_numpy()
    odds, usable = evidence(pos[:-1], neg[:-1], pos[-1], neg[-1], params)
    cast = spark.sparkContext.broadcast(np.packbits(usable))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = np.unpackbits(cast.value, count=buckets).astype(bool)
        for batch in batches:
            for lo, hi, b, offsets in chunks(batch.column("text")):
                f, first, row, _, _ = _sentences(b, offsets, buckets)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                n_words = np.diff(np.append(first, len(f)))
                of = np.repeat(np.arange(len(first)), n_words)
                word, which = np.nonzero(good[f])
                ends = np.searchsorted(row[of[word]], np.arange(hi - lo + 1))
                fs = [f[word[i:j], which[i:j]].astype("<i4").tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                ss = [(of[word[i:j]] - k).astype("<i4").tobytes() for i, j, k in zip(ends[:-1], ends[1:], at[:-1], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("_y")[lo:hi], pa.array(fs, pa.binary()), pa.array(ss, pa.binary()), pa.array(np.diff(at).astype(np.int64))], names=["doc_id", "_y", "f", "s", "n"])

    found = rows.mapInArrow(cut, "doc_id long, _y int, f binary, s binary, n long").toArrow().sort_by("doc_id")
    ints = lambda c: [np.frombuffer(x, "<i4") for x in found[c].to_pylist()]
    return _solve(ints("f"), ints("s"), found["n"].to_numpy(), found["_y"].to_numpy().astype(float), odds, params)


def find_toxic(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """One row for each offending sentence of the documents found toxic, and none for others: doc_id, toxicity (of the
    document), sentence_no (from 0, among sentences that hold words), sentence, sentence_score.

    A document is toxic if noisy-or over all its sentences reaches ``document_threshold``; its offending sentences are those
    that reach ``sentence_threshold``, or the first highest one. Null and empty texts are never toxic. Repeated rows give
    repeated results, other columns are ignored, an empty table gives no rows; long texts are read whole.
    """
    small_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for lo, hi, b, offsets in chunks(batch.column("text")):
                f, first, row, starts, ends = _sentences(b, offsets, len(m.weights))
                if not len(first):
                    continue
                z = m.bias + np.add.reduceat(m.weights[f].sum(axis=1, dtype=np.float64), first)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                doc = 1 - np.exp(-np.bincount(row, np.logaddexp(0, z), hi - lo))
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in np.flatnonzero(doc >= params.document_threshold):
                    own = p[at[i] : at[i + 1]]
                    hits = np.flatnonzero(own >= params.sentence_threshold)
                    for k in hits if len(hits) else [int(own.argmax())]:
                        s = at[i] + k
                        end = ends[(first[s + 1] if s + 1 < len(first) else len(f)) - 1]
                        rows.append((ids[lo + int(i)].as_py(), float(doc[i]), int(k), b[starts[first[s]] : end].tobytes().decode("utf-8", "replace"), float(own[k])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(np.round(np.array(cols[1], float), 6)), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(np.round(np.array(cols[4], float), 6))],
                names=["doc_id", "toxicity", "sentence_no", "sentence", "sentence_score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, toxicity double, sentence_no int, sentence string, sentence_score double")
