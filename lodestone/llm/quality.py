"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, row_sums, small_batches, span_hashes

FEATURES = ("n_words", "word_length", "upper", "digits", "symbols", "non_ascii", "unique_words", "top_word", "line_repeats", "line_length", "ended_lines", "pipes")
#: +1: the score may only rise with the feature, -1: only fall, 0: free.
MONOTONE = {"upper": -1, "symbols": -1, "unique_words": 1, "top_word": -1, "line_repeats": -1, "pipes": -1}

_UPPER, _DIGIT, _SYMBOL, _HIGH, _BLANK = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_HIGH[128:] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[[*map(ord, "#$%&*+<=>@\\^_`{|}~![]")]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*map(ord, ".!?:;\"')")]] = True


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that stay inside a row, and the rows' offsets into them."""
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        at = cut[cut < len(inside)]
        first[at] = inside[at]
        at = cut[cut > 0] - 1
        last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _repeats(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in each row, and how often its commonest one occurs."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate([at, [len(v)]]))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, r[at], size)
    return np.bincount(r[at], minlength=n), most


def statistics(column) -> np.ndarray:
    """The FEATURES of each text, whole texts, null as empty."""
    out = []
    for lo, hi, b, offsets in chunks(column):
        x = np.zeros((hi - lo, len(FEATURES)))
        blank = _BLANK[b]
        starts, ends, at = _runs(~blank, offsets)
        n = np.diff(at)
        some, solid = np.maximum(n, 1), np.maximum(row_sums(~blank, offsets), 1)
        x[:, 0] = n
        x[:, 1] = row_sums(ends - starts, at) / some
        for i, kind in ((2, _UPPER), (3, _DIGIT), (4, _SYMBOL), (5, _HIGH)):
            x[:, i] = row_sums(kind[b], offsets) / solid
        distinct, most = _repeats(span_hashes(b, starts, ends), at)
        x[:, 6], x[:, 7] = distinct / some, most / some
        ls, le, lat = _runs(b != 10, offsets)
        lines = np.maximum(np.diff(lat), 1)
        x[:, 8] = 1 - np.where(np.diff(lat) > 0, _repeats(span_hashes(b, ls, le), lat)[0], 1) / lines
        x[:, 9] = row_sums(le - ls, lat) / lines
        x[:, 10] = row_sums(_STOP[b[le - 1]], lat) / lines if len(le) else 0
        x[:, 11] = row_sums(b == 124, offsets) / some
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class QualityParams:
    """``train_rows`` bounds the labelled rows fitted on; a document is kept from ``threshold`` upwards."""

    train_rows: int = 16000
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 64
    min_leaf: float = 2.0
    ridge: float = 1.0
    threshold: float = 0.5


@dataclass(frozen=True)
class TreeModel:
    """All trees' nodes in flat arrays; a leaf is its own child. ``roots`` holds each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality, all rows and all trees at once."""
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))[:, None]
        for lo in range(0, len(self.roots), 16):
            node = np.repeat(self.roots[None, lo : lo + 16], len(x), axis=0)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, params: QualityParams = QualityParams(), monotone: tuple[int, ...] = tuple(MONOTONE.get(f, 0) for f in FEATURES)) -> TreeModel:
    """Boost logistic loss by histograms. A split on a constrained feature that would order its sides wrongly is not taken,
    and the midpoint of the sides bounds all values beneath. With no rows or one class the model is a constant."""
    n, width = x.shape
    p0 = np.clip(y.mean(), 0.001, 0.999) if n else 0.999
    prior = float(np.log(p0 / (1 - p0)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, params.bins + 1)[1:-1])) for j in range(width)] if n else []
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else None
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(0)
        cut.append(0.0)
        left.append(len(value))
        right.append(len(value))
        value.append(v * params.rate)
        return len(value) - 1

    score = np.full(n, prior)
    for _ in range(params.trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            clip = lambda a, b: np.clip(a / (b + params.ridge), low, high)
            gain_of = lambda v, a, b: 2 * v * a - v * v * (b + params.ridge)
            here = clip(gs, hs)
            best = (1e-6, None)
            for j in range(width if depth < params.depth else 0):
                k = len(edges[j])
                if not k:
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], k + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], k + 1))[:-1]
                vl, vr = clip(gl, hl), clip(gs - gl, hs - hl)
                gain = gain_of(vl, gl, hl) + gain_of(vr, gs - gl, hs - hl) - gain_of(here, gs, hs)
                ok = (hl >= params.min_leaf) & (hs - hl >= params.min_leaf) & (monotone[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), (j, i, float(vl[i]), float(vr[i])))
            at = leaf(float(here))
            if best[1] is None:
                score[rows] += here * params.rate
                return at
            j, i, vl, vr = best[1]
            mid, goes = (vl + vr) / 2, binned[rows, j] <= i
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[j]]
            feature[at], cut[at] = j, float(edges[j][i])
            left[at] = grow(rows[goes], depth + 1, *bounds[0])
            right[at] = grow(rows[~goes], depth + 1, *bounds[1])
            return at

        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
    ints = lambda a: np.array(a, dtype=np.int32)
    return TreeModel(ints(feature), np.array(cut, dtype=float), ints(left), ints(right), np.array(value, dtype=float), ints(roots), params.depth, prior)


def train_quality_model(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> TreeModel:
    """Fit on at most ``train_rows`` rows whose label is 0 or 1, chosen by a hash of doc_id.

    Null ids, null labels and labels without a document are not used; where labels of an id disagree, the smallest counts.
    Of rows that repeat an id the smallest text is fitted on.
    Without labels of both kinds all documents get the same score and are kept.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.train_rows)
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("_y").alias("_y"), F.min("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text")).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "_y", "x"])

    found = rows.select(F.col("doc_id").cast("long"), F.col("_y").cast("int"), "text").mapInArrow(measure, "doc_id long, _y int, x binary").toPandas()
    found = found.sort_values(["doc_id", "x"])
    x = np.stack([np.frombuffer(v, "<f8") for v in found["x"]]) if len(found) else np.zeros((0, len(FEATURES)))
    y = found["_y"].to_numpy(float)
    if len(y) and y.mean() in (0.0, 1.0):
        y = np.ones(len(y))
    return fit_trees(x, y, params)


def score_quality(docs: DataFrame, model: TreeModel, params: QualityParams = QualityParams()) -> DataFrame:
    """One row for each input row: doc_id, quality (probability), keep.

    Null texts count as empty: all statistics 0, scored like any other. Repeated rows give repeated results, other columns
    are ignored, an empty table gives no rows; long texts are read whole.
    """
    small_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = cast.value.predict(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(p, 6)), pa.array(p >= params.threshold)], names=["doc_id", "quality", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, quality double, keep boolean")


def keep_good(docs: DataFrame, model: TreeModel, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(cast.value.predict(statistics(batch.column(at))) >= params.threshold))

    return docs.mapInArrow(keep, docs.schema)
