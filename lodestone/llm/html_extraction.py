"""Main-text extraction: a suffix array over each host's pages finds repeated long substrings, the rest is kept."""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U, chunks, lower_bytes, release, shared_dir, shingles, small_batches, span_hashes, stored, words


@dataclass(frozen=True)
class ExtractionParams:
    """Substrings of ``length`` words (a power of two) or more that distinct pages of a host share are boilerplate.

    A task holds about ``shard_chars`` of a host's HTML; a host with more is cut into shards of whole pages.
    """

    length: int = 8
    shard_chars: int = 8_000_000


def visible_text(html):
    """HTML without comments, scripts, styles and tags, as a column."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def suffix_ranks(tokens: np.ndarray, page_end: np.ndarray, length: int) -> np.ndarray:
    """By prefix doubling, each suffix's rank among all by its first ``length`` tokens: equal ranks share them.

    ``page_end`` is the end of the page that holds each token; suffixes shorter than ``length`` have ranks of their own.
    Sorting positions by rank gives the suffix array to that depth.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    at, width = np.arange(n), 1
    while width < length:
        whole = at + 2 * width <= page_end
        second = rank[np.minimum(at + width, max(n - 1, 0))] + 1
        key = rank * np.int64(n + 1) + np.where(whole, second, 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width *= 2
    short = np.flatnonzero(at + length > page_end)
    rank[short] = n + short
    return rank


def boilerplate(tokens: np.ndarray, page: np.ndarray, page_end: np.ndarray, length: int, elsewhere: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a substring of ``length`` or more that pages share; ``elsewhere`` marks substrings' starts that other shards have."""
    n = len(tokens)
    if not n:
        return np.zeros(0, bool)
    rank = suffix_ranks(tokens, page_end, length)
    order = np.argsort(rank, kind="stable")
    r, p = rank[order], page[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    shared = np.minimum.reduceat(p, first) != np.maximum.reduceat(p, first)
    start = np.zeros(n, bool)
    start[order] = np.repeat(shared, np.diff(np.append(first, n)))
    if elsewhere is not None:
        start |= elsewhere
    edge = np.zeros(n + length, np.int64)
    edge[:n] += start
    edge[length:] -= start
    return np.cumsum(edge)[:n] > 0


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text column the words' hashes, starts and ends in their own text, and the texts' offsets into them."""
    hs, ss, es, counts = [], [], [], []
    for _, _, b, offsets in chunks(texts):
        low = lower_bytes(b)
        s, e, at = words(low, offsets)
        n = np.diff(at)
        base = np.repeat(offsets[:-1], n)
        hs.append(span_hashes(low, s, e))
        ss.append(s - base)
        es.append(e - base)
        counts.append(n)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(hs, np.uint64), join(ss, np.int64), join(es, np.int64), np.concatenate([[0], np.cumsum(join(counts, np.int64))])


def windows(texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words inside each text, and the texts' offsets into them."""
    h, _, _, at = _tokens(texts)
    g, off = shingles(h, at, length)
    row = np.repeat(np.arange(len(at) - 1), np.diff(off))
    keep = np.diff(at)[row] >= length
    return g[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def extract_main_text(pages: DataFrame, params: ExtractionParams = ExtractionParams()) -> DataFrame:
    """One row for each input row: page_id, host, n_words, n_kept, text (the unique runs, one a line).

    Words are compared without case; a run's punctuation stays with it. Pages with the same page_id are one page and share
    nothing with themselves, a page all of whose text other pages have is left empty. Null or empty HTML gives an empty
    text; null and unparsable URLs share the host ''. Character references are decoded. An empty table gives no rows, other
    columns are ignored, long pages are read whole. In hosts of several shards substrings that shards share are compared by
    64-bit hashes.
    """
    spark = pages.sparkSession
    small_batches(spark)
    where, length = shared_dir(spark), params.length
    size = pages.select(host_of("url").alias("_h"), F.char_length(F.coalesce("html", F.lit(""))).alias("_n")).groupBy("_h").agg(F.sum("_n").alias("_chars"))
    size = stored(size.select("_h", F.greatest(F.ceil(F.col("_chars") / params.shard_chars), F.lit(1)).cast("int").alias("_shards")), f"{where}/hosts")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of("url").alias("host"), visible_text("html").alias("text"))
    rows = rows.join(size, F.col("host") == F.col("_h")).withColumn("shard", F.pmod(F.xxhash64("page_id"), "_shards").cast("int"))
    several = size.filter("_shards > 1").count() > 0
    tasks = int(size.agg(F.sum("_shards")).first()[0] or 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, ids = batch.column("page_id").is_valid().to_numpy(False), batch.column("page_id").fill_null(0).to_numpy()
            part = batch.select(["host", "shard", "text"]).to_pandas()
            for key, own in part.groupby(["host", "shard"], sort=False).indices.items():
                texts = [entities.unescape(x) if "&" in x else x for x in part["text"].iloc[own]]
                data = [x.encode("utf-8", "replace") for x in texts]
                blob = b"".join(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]]), pa.array([int(key[1])], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([known[own].tobytes()]), pa.array([np.array([len(x) for x in data], "<i8").tobytes()]), pa.array([len(blob)], pa.int64()), pa.array([pa.compress(blob, codec="zstd", asbytes=True)], pa.binary())],
                    names=["host", "shard", "ids", "known", "lengths", "size", "texts"],
                )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, part in batch.to_pandas().groupby(["host", "shard", "_shards"], sort=False):
                g = np.unique(windows(pa.array([entities.unescape(x) if "&" in x else x for x in part["text"]], pa.string()), length)[0])
                parts = int(key[2])
                f = ((g >> U(32)) * U(parts) >> U(32)).astype(np.int64)
                cut = np.searchsorted(f, np.arange(parts + 1))
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array([int(key[1])] * len(used), pa.int32()), pa.array([g[cut[k] : cut[k + 1]].tobytes() for k in used], pa.binary())], names=["host", "fragment", "shard", "hashes"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        by_shard = {s: np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in part["hashes"]])) for s, part in pdf.groupby("shard")}
        every = np.sort(np.concatenate(list(by_shard.values())))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        for s, own in by_shard.items():
            hit = np.intersect1d(own, again, assume_unique=True)
            if len(hit):
                found.append((pdf["host"].iloc[0], s, hit.tobytes()))
        return pd.DataFrame(found, columns=["host", "shard", "hashes"])

    def extract(group: pd.DataFrame, marks: pd.DataFrame | None) -> pd.DataFrame:
        blobs = [pa.decompress(x, decompressed_size=int(n), codec="zstd", asbytes=True) for x, n in zip(group["texts"], group["size"], strict=True)]
        lengths = [np.frombuffer(x, "<i8") for x in group["lengths"]]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in group["ids"]])
        known = np.concatenate([np.frombuffer(x, bool) for x in group["known"]])
        sizes = np.concatenate(lengths)
        data = b"".join(blobs)
        off = np.concatenate([[0], np.cumsum(sizes)])
        texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(off.astype("<i8").tobytes()), pa.py_buffer(data)])
        h, s, e, at = _tokens(texts)
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        page = np.unique(np.where(known, ids, -(1 << 63)), return_inverse=True)[1]
        elsewhere = None
        if marks is not None and len(marks):
            shared = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in marks["hashes"]]))
            g, goff = shingles(h, at, length)
            full = np.flatnonzero(np.isin(g, shared) & np.repeat(n >= length, np.diff(goff)))
            grow = np.searchsorted(goff, full, side="right") - 1
            elsewhere = np.zeros(len(h), bool)
            elsewhere[at[grow] + full - goff[grow]] = True
        gone = boilerplate(h, page[row], at[1:][row], length, elsewhere)
        out = []
        for i in range(len(n)):
            lo, hi = at[i], at[i + 1]
            keep = ~gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]])))
            runs = []
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                end = s[lo + b] if lo + b < hi else sizes[i]
                runs.append(data[off[i] + s[lo + a] : off[i] + end].decode("utf-8", "replace").strip())
            out.append("\n".join(runs))
        return pd.DataFrame({"page_id": pd.array(np.where(known, ids, 0), "Int64").copy() if known.all() else pd.array([int(x) if k else None for x, k in zip(ids, known, strict=True)], "Int64"), "host": group["host"].iloc[0], "n_words": n, "n_kept": np.bincount(row[~gone], minlength=len(n)) if len(row) else n, "text": out})

    schema = "page_id long, host string, n_words long, n_kept long, text string"
    packed = rows.mapInArrow(pack, "host string, shard int, ids binary, known binary, lengths binary, size long, texts binary").repartition(tasks, "host", "shard")
    if not several:
        return packed.groupBy("host", "shard").applyInPandas(lambda g: extract(g, None), schema)
    crossing = rows.filter("_shards > 1").mapInArrow(emit, "host string, fragment int, shard int, hashes binary").repartition(tasks, "host", "fragment")
    marks = stored(crossing.groupBy("host", "fragment").applyInPandas(meet, "host string, shard int, hashes binary"), f"{where}/marks")
    release(spark)

    def both(group: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        return extract(group, marks) if len(group) else pd.DataFrame({"page_id": pd.array([], "Int64"), "host": [], "n_words": [], "n_kept": [], "text": []})

    return packed.groupBy("host", "shard").cogroup(marks.groupBy("host", "shard")).applyInPandas(both, schema)
