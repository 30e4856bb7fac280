"""Language-model scoring by prediction by partial matching over bytes: escape method C with symbol exclusion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U, chunks, mix, read_arrays, shared_dir, small_batches, stored, trim, write_arrays


@dataclass(frozen=True)
class PpmParams:
    """``order`` is the number of context bytes (7 at most). Each document is scored by the trie of the ``folds`` - 1 folds that
    it isn't in. A trie is cut by a hash of its last two context bytes into shards of about ``shard_nodes`` leaves, each a
    file that workers map.
    """

    order: int = 4
    folds: int = 2
    shard_nodes: int = 1 << 20
    count_bytes: int = 1 << 25


def grams_of(b: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte the key of it and the ``order`` bytes before it in its text, which zeros precede."""
    key = b.astype(np.uint64)
    first = np.repeat(offsets[:-1], np.diff(offsets))
    into = np.arange(len(b)) - first
    for j in range(1, order + 1):
        before = np.zeros(len(b), dtype=np.uint64)
        before[j:] = b[:-j] if len(b) > j else 0
        before[into < j] = 0
        key |= before << U(8 * j)
    return key


@dataclass(frozen=True)
class Trie:
    """Level k holds the sorted keys of k context bytes and a symbol with their counts, and of the contexts of k bytes
    their keys, totals, distinct symbols, and the total that those symbols have one level lower."""

    keys: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    totals: tuple[np.ndarray, ...]
    distinct: tuple[np.ndarray, ...]
    lower: tuple[np.ndarray, ...]

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, order: int, low: Trie | None = None) -> Trie:
        """From the counts of the longest grams; shorter ones are their sums, or those of ``low`` as far as it goes."""
        ks, cs, xs, ts, ds, ls = map(list, (low.keys, low.counts, low.contexts, low.totals, low.distinct, low.lower)) if low else ([] for _ in range(6))
        all_keys = keys.astype(np.uint64)
        for k in range(len(ks), order + 1):
            level, at = np.unique(all_keys & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(level)).astype(np.int64)
            context, where = np.unique(level >> U(8), return_inverse=True)
            ks.append(level)
            cs.append(n)
            xs.append(context)
            ts.append(np.bincount(where, n, len(context)).astype(np.int64))
            ds.append(np.bincount(where, minlength=len(context)).astype(np.int64))
            if k:
                below = cs[k - 1][np.searchsorted(ks[k - 1], level & U((1 << 8 * k) - 1))]
                ls.append(np.bincount(where, below, len(context)).astype(np.int64))
            else:
                ls.append(np.zeros(len(context), np.int64))
        return Trie(*map(tuple, (ks, cs, xs, ts, ds, ls)))

    def arrays(self) -> dict[str, np.ndarray]:
        return {f"{name}{k}": a for name in ("keys", "counts", "contexts", "totals", "distinct", "lower") for k, a in enumerate(getattr(self, name))}

    @staticmethod
    def of(arrays: dict[str, np.ndarray], order: int) -> Trie:
        """From what ``arrays`` gave."""
        return Trie(*(tuple(arrays[f"{name}{k}"] for k in range(order + 1)) for name in ("keys", "counts", "contexts", "totals", "distinct", "lower")))

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each gram after the bytes before it.

        From the longest context that the trie holds: its symbols have count / (total + distinct), the rest is the escape to
        the context one byte shorter, from which the symbols of the longer one are excluded. After order 0 all bytes not
        excluded are equally likely.
        """
        order = len(self.keys) - 1
        bits = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        shut_total, shut_distinct = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for k in range(order, -1, -1):
            if not len(open_):
                break
            g = grams[open_] & U((1 << 8 * (k + 1)) - 1)
            context = g >> U(8)
            c = np.minimum(np.searchsorted(self.contexts[k], context), max(len(self.contexts[k]) - 1, 0))
            known = self.contexts[k][c] == context if len(self.contexts[k]) else np.zeros(len(g), bool)
            i = np.minimum(np.searchsorted(self.keys[k], g), max(len(self.keys[k]) - 1, 0))
            hit = self.keys[k][i] == g if len(self.keys[k]) else np.zeros(len(g), bool)
            total = np.where(known, self.totals[k][c] if len(self.contexts[k]) else 0, 0) - shut_total[open_] * known
            fresh = np.where(known, self.distinct[k][c] if len(self.contexts[k]) else 0, 0) - shut_distinct[open_] * known
            room = total + fresh
            own = self.counts[k][i[hit]] if hit.any() else np.zeros(0)
            bits[open_[hit]] += np.log2(room[hit]) - np.log2(own)
            miss = ~hit
            out = miss & known & (fresh > 0)
            bits[open_[out]] += np.log2(room[out]) - np.log2(fresh[out])
            seen = miss & known
            shut_total[open_[seen]] = self.lower[k][c[seen]]
            shut_distinct[open_[seen]] = self.distinct[k][c[seen]]
            open_ = open_[miss]
        bits[open_] += np.log2(256 - shut_distinct[open_])
        return bits


def adaptive_bits(text: str | bytes | None, order: int = 4) -> float:
    """Code length of one text by a trie that starts empty and learns each byte after coding it; None counts as empty."""
    data = text.encode() if isinstance(text, str) else (text or b"")
    trie: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    padded = bytes(order) + data
    for at in range(order, len(padded)):
        symbol, shut, found = padded[at], set(), False
        for k in range(order, -1, -1):
            seen = trie.get(padded[at - k : at])
            if seen is None:
                continue
            free = {s: c for s, c in seen.items() if s not in shut}
            room = sum(free.values()) + len(free)
            if symbol in free:
                bits += math.log2(room / free[symbol])
                found = True
                break
            if free:
                bits += math.log2(room / len(free))
            shut = set(seen)
        if not found:
            bits += math.log2(256 - len(shut))
        for k in range(order + 1):
            level = trie.setdefault(padded[at - k : at], {})
            level[symbol] = level.get(symbol, 0) + 1
    return bits


def _tally(held: list, parts: int) -> Iterator[pa.RecordBatch]:
    for fold in range(parts):
        keys = np.concatenate([k for f, k, _ in held if f == fold] or [np.zeros(0, np.uint64)])
        n = np.concatenate([c for f, _, c in held if f == fold] or [np.zeros(0, np.int64)])
        at, level = pd.factorize(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(level), fold, np.int32)), pa.array(level.astype(np.int64)), pa.array(np.bincount(at, n, len(level)).astype(np.int64))], names=["fold", "gram", "n"])


def count_grams(docs: DataFrame, params: PpmParams) -> DataFrame:
    """The corpus's counts of the longest grams by fold: fold, gram, n."""
    order, folds, limit = params.order, params.folds, params.count_bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for lo, hi, b, offsets in chunks(batch.column("text")):
                g = grams_of(b, offsets, order)
                of = np.repeat(fold[lo:hi], np.diff(offsets))
                for f in range(folds):
                    at, level = pd.factorize(g[of == f])
                    held.append((f, level, np.bincount(at, minlength=len(level))))
                size += len(b)
                if size >= limit or sum(len(k) for _, k, _ in held) > 1 << 22:
                    yield from _tally(held, folds)
                    held, size = [], 0
        if held:
            yield from _tally(held, folds)

    return docs.select(_fold(params).alias("fold"), "text").mapInArrow(count, "fold int, gram long, n long").groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def _fold(params: PpmParams):
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(params.folds)).cast("int")


_LOADED: dict[tuple[str, int, int], Trie] = {}


def _load(folder: str, side: int, shard: int, order: int) -> Trie:
    """One shard of a fold's trie, with the fold's two lowest levels; a worker keeps what it has mapped."""
    if (folder, side, shard) not in _LOADED:
        if any(f != folder for f, _, _ in _LOADED):
            _LOADED.clear()
        _LOADED[folder, side, shard] = Trie.of(read_arrays(folder, f"{side}-{shard}"), order)
    return _LOADED[folder, side, shard]


def _shards_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return (mix(grams >> U(8) & U(0xFFFF)) % U(shards)).astype(np.int64)


def score_documents(docs: DataFrame, params: PpmParams = PpmParams()) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, code_bits, bits_per_byte, by the trie of the other folds' documents.

    Null and empty texts have 0 bytes, 0 bits and null bits_per_byte. Repeated rows are counted and scored each; rows without
    doc_id share a fold; a fold without other documents is coded at 8 bits a byte. Other columns are ignored, an empty table
    gives no rows; long texts are read whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order, folds = params.order, params.folds
    counts = stored(count_grams(docs, params), f"{shared_dir(spark)}/grams")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fold(params).alias("fold"), "text")
    shards = max(1, -(-counts.count() // params.shard_nodes)) if order > 1 else 1
    other = counts.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter((F.col("side") != F.col("fold")) | F.lit(folds == 1))
    # the levels of one context byte and none are whole: 65536 keys a fold at most
    top = min(order, 1)
    sums = other.groupBy("side", F.col("gram").bitwiseAND(F.lit(0xFFFF if top else 0xFF)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    side, key, n = (sums[c].to_numpy() for c in ("side", "key", "n"))
    lows = [Trie.build(key[side == f].astype(np.uint64), n[side == f], top) for f in range(folds)]
    cast, folder = spark.sparkContext.broadcast(lows), shared_dir(spark)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _shards_of(batch.column("gram").to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([batch.column("side"), pa.array(at.astype(np.int32)), batch.column("gram"), batch.column("n")], names=["side", "shard", "gram", "n"])

    def grow(table: pa.Table) -> pa.Table:
        f, k = table["side"][0].as_py(), table["shard"][0].as_py()
        grams, at = np.unique(table["gram"].to_numpy().view(np.uint64), return_inverse=True)
        trie = Trie.build(grams, np.bincount(at, table["n"].to_numpy(), len(grams)), order, cast.value[f])
        write_arrays(folder, f"{f}-{k}", trie.arrays())
        trim()
        return pa.table({"side": pa.array([f], pa.int32()), "shard": pa.array([k], pa.int32())})

    rows = other.select("side", "gram", "n").mapInArrow(place, "side int, shard int, gram long, n long")
    grown = rows.repartition(shards * folds, "side", "shard").groupBy("side", "shard").applyInArrow(grow, "side int, shard int").collect()
    for f, k in {(f, k) for f in range(folds) for k in range(shards)} - {tuple(r) for r in grown}:
        write_arrays(folder, f"{f}-{k}", Trie.build(np.zeros(0, np.uint64), np.zeros(0, np.int64), order, lows[f]).arrays())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            sizes, bits = [], []
            for lo, hi, b, offsets in chunks(batch.column("text"), 1 << 21):
                g = grams_of(b, offsets, order)
                of = np.repeat(fold[lo:hi], np.diff(offsets))
                each = np.zeros(len(b))
                for f in range(folds):
                    own = np.flatnonzero(of == f)
                    at, level = pd.factorize(g[own])
                    shard = _shards_of(level, shards)
                    cost = np.zeros(len(level))
                    by = np.argsort(shard, kind="stable")
                    cut = np.searchsorted(shard[by], np.arange(shards + 1))
                    for k in np.flatnonzero(np.diff(cut)):
                        here = by[cut[k] : cut[k + 1]]
                        cost[here] = _load(folder, f, int(k), order).code_lengths(level[here])
                    each[own] = cost[at]
                total = np.concatenate([[0], np.cumsum(each)])
                bits.append(total[offsets[1:]] - total[offsets[:-1]])
                sizes.append(np.diff(offsets))
            size, total = np.concatenate(sizes) if sizes else np.zeros(0, np.int64), np.concatenate(bits) if bits else np.zeros(0)
            rate = pa.array(np.round(total / np.maximum(size, 1), 6), mask=size == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(np.round(total, 3)), rate], names=["doc_id", "n_bytes", "code_bits", "bits_per_byte"])
        trim()

    return source.mapInArrow(score, "doc_id long, n_bytes long, code_bits double, bits_per_byte double")
