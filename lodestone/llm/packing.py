"""Packing documents into windows of tokens by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, stored
from lodestone.llm.mixing import count_tokens


@dataclass(frozen=True)
class PackParams:
    """``window`` tokens at most; ``bucket`` pieces on average, fewer than twice as many always, are balanced against each other."""

    window: int = 4096
    bucket: int = 512


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp with k parts: the two partial partitions of greatest imbalance are merged, the largest part of one with
    the smallest of the other. Returns the items of each part. Ties go to the earlier item."""
    if k <= 1:
        return [list(range(len(sizes)))]
    # a part is (sum, tree of items); only parts that hold items are kept, largest first
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # b's smallest parts meet a's largest: b has k - len(b) empty parts, which come first
        empty = k - len(b)
        merged = a[:empty]
        rest = a[empty:]
        tail = b[::-1]
        for j, (s, t) in enumerate(tail):
            if j < len(rest):
                merged.append((rest[j][0] + s, (rest[j][1], t)))
            else:
                merged.append((s, t))
        merged.sort(key=lambda p: -p[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], serial, merged))
        serial += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def pack(sizes: list[int], window: int) -> list[list[int]]:
    """Parts of near-equal sums, none above ``window``: as few as the total allows, one more whenever a part is too full."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // window))
    while True:
        parts = difference(sizes, k)
        if max(sum(sizes[i] for i in p) for p in parts) <= window:
            return parts
        k += 1


def pack_documents(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """One row for each piece of a document: doc_id, copy, piece, start_token, n_tokens, bucket, window (in its bucket),
    window_tokens.

    A text longer than a window is cut into whole windows, which stay alone, and a rest. The rests of a bucket are balanced
    against each other; those of a bucket of twice ``bucket`` or more (rows that share ids) in groups of like sizes. Texts
    without tokens (null, empty) have no piece. Rows that repeat a doc_id are packed each, numbered by copy; null ids are
    packed like any other. Equal sizes are taken in order of doc_id. An empty table gives no rows; other columns are ignored.
    """
    where = shared_dir(docs.sparkSession)
    w = params.window
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count_tokens("text").alias("_n")).filter("_n > 0")
    rows = stored(counted, f"{where}/tokens")
    total = rows.count()
    buckets = max(1, -(-total // params.bucket))
    placed = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    limit = params.bucket

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("_n", "ascending")], null_placement="at_start")).combine_chunks()
        known, ids, n = table["doc_id"].is_valid().to_numpy(), table["doc_id"].fill_null(0).to_numpy(), table["_n"].to_numpy()
        new = np.ones(len(n), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
        first = np.flatnonzero(new)
        copy = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
        rest, full = n % w, n // w
        rows, at = [], 0  # row, piece, tokens, window, window's tokens
        for i in np.flatnonzero(full):
            for p in range(full[i]):
                rows.append((i, p, w, at, w))
                at += 1
        open_ = np.flatnonzero(rest)
        open_ = open_[np.argsort(-rest[open_], kind="stable")]
        groups = max(1, len(open_) // limit)  # more than one only where many rows share ids; dealt by size, they are alike
        for g in range(groups):
            own = open_[g::groups]
            sizes = [int(x) for x in rest[own]]
            for part in pack(sizes, w):
                filled = sum(sizes[j] for j in part)
                rows.extend((own[j], full[own[j]], sizes[j], at, filled) for j in part)
                at += 1
        i, piece, size, window, filled = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        return pa.table({"doc_id": pa.array(ids[i], mask=~known[i]), "copy": copy[i].astype(np.int32), "piece": piece.astype(np.int32), "start_token": piece * w, "n_tokens": size, "bucket": np.full(len(i), table["_b"][0].as_py()), "window": window.astype(np.int32), "window_tokens": filled})

    return placed.groupBy("_b").applyInArrow(run, "doc_id long, copy int, piece int, start_token long, n_tokens long, bucket long, window int, window_tokens long")
