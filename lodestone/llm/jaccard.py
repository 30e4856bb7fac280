"""Exact n-gram Jaccard join by vertical partitioning of the global n-gram order, and classes of near duplicates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SharedArrays, U, chunks, distinct_per_row, forget, mix, packed, release, row_sums, shared_dir, shingles, small_batches, span_hashes, stored, text_array, trim, unpacked, words

SLOTS = 1 << 27


@dataclass(frozen=True)
class JaccardParams:
    """Pairs of sets of ``n``-word grams with a Jaccard similarity of ``threshold`` or more.

    ``vertical`` fragments of the gram order are counted apart for each pair. ``fragment_grams`` and ``block_grams`` set how
    many grams a task holds, of the order and of whole sets; a component of more is compared block by block.
    """

    n: int = 3
    threshold: float = 0.5
    vertical: int = 4
    fragment_grams: int = 1_000_000
    block_grams: int = 500_000

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """How many of a set's first grams include one of any similar set's first grams."""
        return np.minimum(size, size - np.ceil(self.threshold * size - 1e-9).astype(np.int64) + 1)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least overlap of sets of these sizes that is similar."""
        return np.ceil(self.threshold / (1 + self.threshold) * (a + b) - 1e-9)

    def reach(self, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The level of the largest set that a set can be similar to if their first common gram is in this place of it; 0 if
        that is no set of its own size or more, so that it can only be the larger one."""
        most = np.minimum(size / self.threshold, (1 + self.threshold) / self.threshold * (size - place) - size) + 1e-6
        return np.where(most >= size, size_level(np.maximum(most, 1)), 0).astype(np.uint8)


def size_level(size: np.ndarray) -> np.ndarray:
    return (1 + np.floor(8 * np.log2(np.maximum(size, 1)))).astype(np.uint8)


def gram_sets(column, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first and end row, sorted distinct gram hashes, row offsets. Words are lower case; texts of fewer than n words have one gram."""
    for lo, hi, low, offsets in chunks(pc.utf8_lower(text_array(column))):
        starts, ends, at = words(low, offsets)
        yield lo, hi, *distinct_per_row(*shingles(span_hashes(low, starts, ends), at, n))


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 63-bit signature of each set."""
    one = row_sums(mix(grams ^ U(0xA0761D6478BD642F)), offsets).astype(np.uint64)
    two = row_sums(mix(grams * U(0xE7037ED1A0B428DB)), offsets).astype(np.uint64)
    return (mix(one ^ mix(two + np.diff(offsets).astype(np.uint64))) >> U(1)).astype(np.int64)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that edges a, b connect each of n nodes to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


_SURVEY = "kind int, a long, b long, n long, grams binary, rows binary, sets binary, sizes binary"


def _survey(docs: DataFrame, params: JaccardParams) -> DataFrame:
    """kind 0: a document (a), its signature (b) and size (n), 0 without words. kind 1: a chunk (a) of n grams of distinct sets."""

    def chunk(held: list) -> pa.RecordBatch:
        g, sig, size = (np.concatenate(x) for x in zip(*held, strict=True))
        sets, pick, same = np.unique(sig, return_index=True, return_inverse=True)
        row = np.repeat(np.arange(len(sig)), size)
        use = np.isin(row, pick)
        g, row = g[use] >> U(8), same[row[use]]
        o = np.argsort(g, kind="stable")
        blob = lambda x: pa.array([x], pa.binary())
        one = [pa.array([1], pa.int32()), *(pa.array([x], pa.int64()) for x in (uuid.uuid4().int >> 65, 0, len(g)))]
        return pa.RecordBatch.from_arrays([*one, blob(_squeeze(g[o])), blob(_planes(row[o])), blob(sets.astype("<i8").tobytes()), blob(size[pick].astype("<u4").tobytes())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for lo, hi, g, at in gram_sets(batch.column("text"), params.n):
                n, sig, none = hi - lo, signatures(g, at), pa.nulls(hi - lo, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc_id")[lo:hi], pa.array(sig), pa.array(np.diff(at).astype(np.int64)), *[none] * 4], names=names)
                some = np.diff(at) > 0
                held.append((g, sig[some], np.diff(at)[some]))
                total += len(g)
                if total > 1 << 20:
                    yield chunk(held)
                    held, total = [], 0
        if total:
            yield chunk(held)
        trim()

    names = [c.split()[0] for c in _SURVEY.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").mapInArrow(run, _SURVEY)


def _squeeze(x: np.ndarray) -> bytes:
    """Ascending integers as the compressed byte planes of their differences."""
    d = np.diff(x, prepend=U(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4").tobytes()


def _planes(x: np.ndarray) -> bytes:
    """Small integers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


def _fragments(g: np.ndarray, fragments: int) -> np.ndarray:
    """Where ascending 56-bit grams pass from one fragment to the next."""
    return np.searchsorted(((g >> U(24)) * U(fragments) >> U(32)).astype(np.int64), np.arange(fragments + 1))


def _counts(chunks_: DataFrame, fragments: int) -> DataFrame:
    """Of each chunk and fragment the bit length of its grams' number of sets, in the chunk's order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g = _unsqueeze(r["grams"], r["n"])
                at = _fragments(g, fragments)
                for ks in np.array_split(np.flatnonzero(np.diff(at)), max(1, fragments // 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(ks.astype(np.int32)), pa.array([r["a"]] * len(ks), pa.int64()), pa.array(np.diff(at)[ks]), pa.array([_squeeze(g[at[k] : at[k + 1]]) for k in ks], pa.binary())], names=["fragment", "chunk", "n", "grams"])
        trim()

    def count(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        g = np.concatenate([_unsqueeze(x.as_py(), k) for x, k in zip(table["grams"], n, strict=True)])
        o = np.argsort(g)
        first = np.flatnonzero(np.concatenate([[True], g[o][1:] != g[o][:-1]]))
        many = np.diff(np.append(first, len(g)))
        level = np.empty(len(g), np.uint8)
        level[o] = np.repeat(np.frexp(many.astype(float))[1], many)
        end = np.cumsum(n)
        trim()
        return pa.table({"chunk": table["chunk"], "fragment": table["fragment"], "n": table["n"], "levels": pa.array([pa.compress(level[b - k : b].tobytes(), codec="zstd", asbytes=True) for b, k in zip(end, n, strict=True)], pa.binary())})

    parts = chunks_.select("a", "n", "grams").mapInArrow(cut, "fragment int, chunk long, n long, grams binary")
    return parts.repartition(fragments, "fragment").groupBy("fragment").applyInArrow(count, "chunk long, fragment int, n long, levels binary")


_LINKS = "fragment int, n int, grams binary, sets binary, rows binary, low binary, reach binary, edges binary"


def _runs(g: np.ndarray, low: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by gram, size level and falling reach: which begin a run, and which entry links each that doesn't.

    Of a similar pair the smaller set reaches the larger one's size at their first common gram; so an entry within reach
    of one before it is linked to that, and no pair crosses from one run to another.
    """
    if not len(g):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    fresh = np.ones(len(g), bool)
    fresh[1:] = g[1:] != g[:-1]
    top = np.maximum.accumulate((np.cumsum(fresh) << 40 | reach.astype(np.int64) << 32) | np.arange(len(g)))
    before = np.concatenate([[0], top[:-1]])
    new = fresh | (low > (before >> 32 & 255))
    return new, before & 0xFFFFFFFF


def _blocks(g: np.ndarray, row: np.ndarray, low: np.ndarray, reach: np.ndarray, sets: np.ndarray, fragments: int) -> pa.Table:
    """Prefix grams by fragment, each with a set that has it here, the set's size level and reach.

    What a gram links here is linked at once, and only one set of a run goes on, with the reach and sizes of all.
    """
    o = np.lexsort((255 - reach, low, g))
    g, row, low, reach = g[o], row[o].astype(np.int64), low[o], reach[o]
    new, to = _runs(g, low, reach)
    again = np.flatnonzero(~new)
    root = roots(len(sets), row[to[again]], row[again])
    linked = np.flatnonzero(root != np.arange(len(sets)))
    first = np.flatnonzero(new)
    if len(first):
        last = np.append(first[1:], len(g)) - 1
        reach = np.where(last > first, np.maximum(np.maximum.reduceat(reach, first), low[last]), reach[first])
    g, row, low = g[first], row[first], low[first]
    cut = _fragments(g, fragments)
    out: list[tuple] = []
    if len(linked):
        edges = np.stack([sets[linked], sets[root[linked]]]).astype("<i8").tobytes()
        out.append((int(sets[0] % fragments), 0, b"", b"", b"", b"", b"", edges))
    for k in np.flatnonzero(np.diff(cut)):
        s = slice(cut[k], cut[k + 1])
        own, code = np.unique(row[s], return_inverse=True)
        out.append((int(k), len(code), _squeeze(g[s]), sets[own].astype("<i8").tobytes(), _small(code), low[s].tobytes(), reach[s].tobytes(), b""))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=[c.split()[0] for c in _LINKS.split(", ")])


def _prefixes(chunks_: DataFrame, counts: DataFrame, n_chunks: int, params: JaccardParams, fragments: int) -> DataFrame:
    """The prefix grams that more than one set has; rare grams come first in the order, then the hash decides."""

    def prefix(key, chunk: pa.Table, counted: pa.Table) -> pa.Table:
        out = []
        for r in chunk.to_pylist():
            g = _unsqueeze(r["grams"], r["n"])
            counted = counted.sort_by("fragment")
            level = np.concatenate([np.frombuffer(pa.decompress(x.as_py(), decompressed_size=n, codec="zstd", asbytes=True), np.uint8) for x, n in zip(counted["levels"], counted["n"].to_pylist(), strict=True)])
            row, size, sets = _unplanes(r["rows"], len(g)), np.frombuffer(r["sizes"], "<u4").astype(np.int64), np.frombuffer(r["sets"], "<i8")
            o = np.argsort(row * 64 + level, kind="stable")
            g, row, level = g[o], row[o], level[o]
            place = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
            use = (place < params.prefix(size)[row]) & (level > 1)
            g, row, place = g[use], row[use], place[use]
            out.append(_blocks(g, row, size_level(size)[row], params.reach(size[row], place), sets, fragments))
        trim()
        return pa.concat_tables(out) if out else _blocks(*(np.zeros(0, k) for k in (np.uint64, np.int64, np.uint8, np.uint8, np.int64)), fragments)

    one = chunks_.withColumnRenamed("a", "chunk").repartition(n_chunks, "chunk").groupBy("chunk")
    return one.cogroup(counts.repartition(n_chunks, "chunk").groupBy("chunk")).applyInArrow(prefix, _LINKS)


def link(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each set of a fragment to the smallest one that it is linked to: by edges given, and by grams shared by sets of sizes that can be similar."""
    gs, ss, lows, reaches, edges = [], [], [], [], []
    for r in table.to_pylist():
        if r["n"]:
            sets = np.frombuffer(r["sets"], "<i8")
            gs.append(_unsqueeze(r["grams"], r["n"]))
            ss.append(sets[_wide(r["rows"], r["n"])])
            lows.append(np.frombuffer(r["low"], np.uint8))
            reaches.append(np.frombuffer(r["reach"], np.uint8))
        else:
            edges.append(np.frombuffer(r["edges"], "<i8").reshape(2, -1))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    g, s, low, reach = join(gs, np.uint64), join(ss, np.int64), join(lows, np.uint8), join(reaches, np.uint8)
    given = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    o = np.lexsort((255 - reach, low, g))
    g, s, low, reach = g[o], s[o], low[o], reach[o]
    new, to = _runs(g, low, reach)
    k = np.flatnonzero(~new)
    ids, code = np.unique(np.concatenate([s, given.ravel()]), return_inverse=True)
    a, b = code[len(s) :].reshape(2, -1)
    root = roots(len(ids), np.concatenate([code[: len(s)][k], a]), np.concatenate([code[: len(s)][to[k]], b]))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _expand(lists: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry i with each of the entries after it up to ``ends[i]``."""
    many = ends - lists - 1
    i = np.repeat(lists, many)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)


def overlaps(grams: np.ndarray, at: np.ndarray, group: np.ndarray, vertical: int, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of sets of one group that share n grams: i, j, n.

    The order of the grams is cut into ``vertical`` fragments; each counts its part of every pair, and the parts are summed. Small groups are counted by their lists of sets a gram; in a large one the grams that many of its sets
    have are counted by products of matrices.
    """
    size = np.diff(at)
    m = len(size)
    owner = np.repeat(np.arange(m), size)
    o = np.lexsort((owner, grams, group[owner]))
    g, who, of = grams[o], owner[o], group[owner[o]]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(g)))
    keep = np.repeat(length > 1, length)
    cost = np.repeat(length * (length - 1) // 2, length)
    where = np.flatnonzero(keep)
    # the order's fragments hold equal shares of what is shared here
    rank = np.empty(len(g), np.int64)
    by_order = np.argsort(g, kind="stable")
    rank[by_order] = np.cumsum(keep[by_order]) * vertical // max(1, len(where) + 1)
    head = np.zeros(len(g), np.int64)
    head[first] = cost[first]
    groups, begin = np.unique(of, return_index=True)
    work = np.add.reduceat(head, begin) if len(begin) else np.zeros(0, np.int64)
    finish = np.append(begin[1:], len(g))
    end = np.repeat(np.append(first[1:], len(g)), length)
    lo = 0
    while lo < len(groups):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(work[lo:]), step, side="right")))
        inside = where[np.searchsorted(where, begin[lo]) : np.searchsorted(where, finish[hi - 1])]
        if work[lo] > step:
            yield from _dense(inside, g, who, rank, vertical, step)
        elif len(inside):
            keys, counts = [], []
            for v in range(vertical):
                own = inside[rank[inside] == v]
                i, j = _expand(own, end[own])
                key, n = np.unique(who[i] * np.int64(m) + who[j], return_counts=True)
                keys.append(key)
                counts.append(n)
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            yield key // m, key % m, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        lo = hi


def _dense(inside: np.ndarray, g: np.ndarray, who: np.ndarray, rank: np.ndarray, vertical: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of one large group, some of its sets with all of them at a time."""
    ids, row = np.unique(who[inside], return_inverse=True)
    code = np.cumsum(np.concatenate([[0], g[inside][1:] != g[inside][:-1]]))
    first = np.searchsorted(code, np.arange(code[-1] + 1))
    length = np.diff(np.append(first, len(code)))
    m, fragment = len(ids), rank[inside][first]
    often = length >= max(16, m // 32)
    wide = max(1, 4 * step // m)
    for lo in range(0, m, wide):
        hi = min(m, lo + wide)
        total = np.zeros((hi - lo, m), np.float32)
        for v in range(vertical):
            some = np.flatnonzero(often & (fragment == v))
            for k in range(0, len(some), wide):
                part = some[k : k + wide]
                x = np.zeros((m, len(part)), np.float32)
                entry = np.repeat(first[part], length[part]) + np.arange(length[part].sum()) - np.repeat(np.cumsum(length[part]) - length[part], length[part])
                x[row[entry], np.repeat(np.arange(len(part)), length[part])] = 1
                total += x[lo:hi] @ x.T
            here = np.flatnonzero((row >= lo) & (row < hi) & ~often[code] & (fragment[code] == v))
            many = length[code[here]]
            sums = np.cumsum(many)
            at = 0
            while at < len(here):
                to = max(at + 1, int(np.searchsorted(sums, sums[at] - many[at] + step, side="right")))
                n = many[at:to]
                i = np.repeat(here[at:to], n)
                j = np.repeat(first[code[here[at:to]]], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                total += np.bincount((row[i] - lo) * m + row[j], minlength=(hi - lo) * m).reshape(hi - lo, m).astype(np.float32)
                at = to
        i, j = np.nonzero(np.triu(total, lo + 1))
        yield ids[i + lo], ids[j], total[i, j].astype(np.int64)


@dataclass(frozen=True)
class JaccardJoin:
    """``members``: every document with words, its set's signature and representative (the smallest id that has the set), and
    the set's size. ``found``: of sets with similar ones their number (signature, links, class), or all similar pairs of sets
    (set_a < set_b, similarity). The class is its smallest signature. ``without``: the ids of texts without words."""

    members: DataFrame
    found: DataFrame
    without: DataFrame


def jaccard_join(docs: DataFrame, params: JaccardParams = JaccardParams(), pairs: bool = False) -> JaccardJoin:
    """All similar pairs of distinct gram sets, or what they come to for each set.

    Sets that are equal meet once, as the smallest doc_id that has them, so that copies cost no pairs. Grams are ordered by the
    bit length of the number of sets that have them, then by hash. Sets that share a gram of their prefixes, in places that
    allow the threshold, are linked, one link a set and gram, never a pair for each; what links connect is a component,
    whose sets are read together and compared exactly. A component of over ``block_grams`` grams is cut into blocks by a hash, and
    each pair of blocks is a task. Rows without doc_id take no part. Rows that repeat an id are compared each, with the same
    text once. An empty table gives no rows; other columns are ignored; texts are read whole. Equal 63-bit signatures are
    taken for equal sets, equal 64-bit hashes for equal
    grams (links are made by 56 bits of them).
    """
    spark = docs.sparkSession
    small_batches(spark)
    where = shared_dir(spark)
    survey = stored(_survey(docs, params), f"{where}/survey")
    every = survey.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("signature"), F.col("n").alias("size"))
    without = stored(every.filter("size = 0").select("doc_id").distinct(), f"{where}/without")
    sets = every.filter("size > 0")
    first = sets.groupBy("signature").agg(F.min("doc_id").alias("representative"), F.first("size").alias("size"))
    members = stored(sets.select("signature", "doc_id").distinct().join(first, "signature").select("doc_id", "signature", "representative", "size"), f"{where}/members")
    pieces = survey.filter("kind = 1").drop("kind", "b")
    n_chunks, total = pieces.agg(F.count("*"), F.sum("n")).first()
    fragments = max(1, -(-int(total or 0) // params.fragment_grams))
    counts = stored(_counts(pieces, fragments), f"{where}/counts")
    release(spark)

    def join(table: pa.Table) -> pa.Table:
        a, b = link(table)
        trim()
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    few = max(1, fragments // 2)
    links = _prefixes(pieces, counts, max(1, n_chunks), params, few).repartition(few, "fragment").groupBy("fragment").applyInArrow(join, "a long, b long")
    links = stored(links.distinct(), f"{where}/links")
    for name in ("survey", "counts"):
        forget(spark, f"{where}/{name}")
    release(spark)
    component = components(links)
    needed = stored(component.select(F.col("node").alias("signature"), "component").join(members.filter("doc_id = representative").drop("doc_id"), "signature"), f"{where}/needed")
    found = stored(_compare(docs, needed, params, pairs), f"{where}/found")
    if not pairs:
        found = _classes(found, where)
    forget(spark, f"{where}/links")
    forget(spark, f"{where}/needed")
    release(spark)
    return JaccardJoin(members, found, without)


def _slot(name: str):
    return F.pmod(F.xxhash64(name), F.lit(SLOTS))


def _bitmap(ids: DataFrame) -> SharedArrays:
    """A bit for each slot that an ``id`` falls in: as large for any number of ids, so that a task can pass over most rows that aren't among them."""
    slots = ids.select(_slot("id").alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word"))
    found = slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return SharedArrays(ids.sparkSession, {"bits": bits})


def _holds(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & U(1) == U(1)


def _compare(docs: DataFrame, needed: DataFrame, params: JaccardParams, pairs: bool) -> DataFrame:
    """What each component's, or pair of blocks', task finds: pairs; or sets with links here and the smallest set that similarity connects them to here."""
    spark = docs.sparkSession
    total = needed.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-int(total) // params.block_grams))
    large = needed.groupBy("component").agg(F.ceil(F.sum("size") / params.block_grams).cast("int").alias("blocks")).filter("blocks > 1")
    placed = needed.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("signature"), "blocks").cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets)))
    placed = placed.select("signature", "component", "block", (F.col("blocks") > 1).alias("large"), task.alias("task"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    slot, shared = _slot("id"), _bitmap(needed.select(F.col("representative").alias("id")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.load()["bits"], set()
        for batch in batches:
            at = batch.column("slot").to_numpy()
            texts = batch.column("text").filter(pa.array(_holds(bits, at)))
            for lo, hi, g, off in gram_sets(texts, params.n):
                sig = signatures(g, off)
                new = [k for k in np.flatnonzero(np.diff(off)).tolist() if not (sig[k] in seen or seen.add(sig[k]))]
                yield pa.RecordBatch.from_arrays([pa.array(sig[new]), texts[lo:hi].take(pa.array(new, pa.int64())).cast(pa.string())], names=["signature", "text"])
        trim()

    source = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null and text is not null").select(slot.alias("slot"), "text")
    rows = source.mapInArrow(sign, "signature long, text string").join(placed, "signature")

    def compare(table: pa.Table) -> pa.Table:
        sig = table["signature"].to_numpy()
        sig, pick = np.unique(sig, return_index=True)
        table = table.take(pa.array(pick))
        gs, sizes = [], []
        for _, _, g, off in gram_sets(table["text"], params.n):
            gs.append(g)
            sizes.append(np.diff(off))
        g, size = np.concatenate(gs), np.concatenate(sizes)
        at = np.concatenate([[0], np.cumsum(size)])
        group = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        block, across, large_ = table["block"].to_numpy(), table["i"][0].as_py() != table["j"][0].as_py(), table["large"][0].as_py()
        del table, gs
        links, root, out = np.zeros(len(sig), np.int64), np.arange(len(sig)), []
        for i, j, n in overlaps(g, at, group, params.vertical):
            ok = n >= params.overlap(size[i], size[j])
            if across:
                ok &= block[i] != block[j]
            i, j, n = i[ok], j[ok], n[ok]
            if pairs:
                out.append((sig[i], sig[j], n / (size[i] + size[j] - n)))
            else:
                links += np.bincount(i, minlength=len(sig)) + np.bincount(j, minlength=len(sig))
                root = roots(len(sig), np.concatenate([np.arange(len(sig)), i]), np.concatenate([root, j]))
        trim()
        if pairs:
            a, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"set_a": a, "set_b": b, "similarity": np.round(s, 6)})
        some = np.flatnonzero(links)
        return pa.table({"signature": sig[some], "links": links[some], "root": sig[root[some]], "large": np.full(len(some), large_)})

    keys = ["large", "task", "i", "j"]
    return rows.groupBy(*keys).applyInArrow(compare, "set_a long, set_b long, similarity double" if pairs else "signature long, links long, root long, large boolean")


def _classes(found: DataFrame, where: str) -> DataFrame:
    """signature, links, class: sums over the tasks of large components, whose classes may go on from task to task."""
    done = found.filter("not large").select("signature", "links", F.col("root").alias("class"))
    split = found.filter("large")
    if split.isEmpty():
        return done
    group = components(split.select(F.col("signature").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("signature"), F.col("component").alias("class"))
    return done.unionByName(split.groupBy("signature").agg(F.sum("links").alias("links")).join(group, "signature"))


def near_classes(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, n_copies.

    ``n_links`` counts the other gram sets that are similar to the document's own, each one, however many documents have it;
    ``n_copies`` counts the other ids that have the same set. A class is what similar and equal sets connect; its id is its
    smallest doc_id. A document without words, and one like no other, is a class of its own. Rows that repeat an id with other
    words are documents of their own; with the same words they are one. Rows without doc_id give no row.
    """
    found = jaccard_join(docs, params)
    named = found.found.join(found.members.filter("doc_id = representative").select("signature", "representative"), "signature")
    lowest = named.groupBy("class").agg(F.min("representative").alias("class_id"))
    named = named.join(lowest, "class").select("signature", "links", "class_id")
    copies = found.members.groupBy("signature").agg((F.count("*") - 1).alias("n_copies")).filter("n_copies > 0")
    rows = found.members.join(named, "signature", "left").join(copies, "signature", "left")
    none = F.lit(0).cast("long")
    rows = rows.select("doc_id", F.coalesce("class_id", "representative").alias("class_id"), F.coalesce("links", none).alias("n_links"), F.coalesce("n_copies", none).alias("n_copies"))
    return rows.unionByName(found.without.select("doc_id", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies")))


def near_duplicates(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_a < doc_b, similarity: all similar pairs of representatives, and each other document with its representative (1.0).

    A copy's other partners are its representative's, so the rows stand for all pairs without being quadratic in copies. They
    are quadratic in texts that are alike without being equal; ``near_classes`` isn't.
    """
    found = jaccard_join(docs, params, pairs=True)
    name = found.members.filter("doc_id = representative").select("signature", "representative")
    pair = found.found.join(name.toDF("set_a", "a"), "set_a").join(name.toDF("set_b", "b"), "set_b").filter("a <> b")
    pair = pair.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "similarity")
    copies = found.members.filter("doc_id <> representative").select(F.col("representative").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("similarity"))
    return pair.unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("similarity").alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for edges a, b: smallest labels spread to neighbours and jump, until none changes."""
    spark = edges.sparkSession
    where = shared_dir(spark)
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().filter("a <> b"), f"{where}/edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{where}/0")
    k, changed = 0, 1
    while changed:
        k += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jump = step.join(up, "component", "left").select("node", "old", F.least("component", "above").alias("component"))
        new = stored(jump, f"{where}/{k}")
        changed = new.filter("old <> component").count()
        labels = new.select("node", "component")
        if k > 1:
            forget(spark, f"{where}/{k - 1}")
    return labels


def keep_one(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """``docs`` with one document of each class, the one of smallest id, with all columns.

    Rows without doc_id, and without words, stay. Of rows that repeat an id each goes or stays by its own text: one stays of
    equal sets, all whose texts are like no other.
    """
    where = shared_dir(docs.sparkSession)
    found = jaccard_join(docs, params)
    named = found.members.join(found.found, "signature", "left").select("doc_id", "signature", F.coalesce("class", "signature").alias("_group"))
    first = named.groupBy("_group").agg(F.min(F.struct("doc_id", "signature")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    gone = stored(named.join(first, "_group").filter(F.struct("doc_id", "signature") != F.col("_first")).select(F.col("doc_id").alias("_gone"), F.col("signature").alias("_set")), f"{where}/gone")
    rows = packed(docs).withColumn("id", F.col("row.doc_id").cast("long"))
    again = stored(rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("id").alias("_gone")), f"{where}/again")
    shared = _bitmap(gone.select(F.col("_gone").alias("id")).union(again))

    @F.pandas_udf("boolean")
    def among(slot: pd.Series) -> pd.Series:
        return pd.Series(_holds(shared.load()["bits"], slot.to_numpy(np.int64)))

    # most rows stay whatever the texts, and aren't shuffled
    rows = rows.withColumn("among", F.col("id").isNotNull() & among(F.coalesce(_slot("id"), F.lit(0).cast("long"))))
    clear, rows = rows.filter("not among").select("row"), rows.filter("among").drop("among")

    @F.pandas_udf("long")
    def own_set(text: pd.Series) -> pd.Series:
        held = [pd.Series(signatures(g, at), dtype="Int64").where(np.diff(at) > 0) for _, _, g, at in gram_sets(pa.array(text, pa.string(), from_pandas=True), params.n)]
        return pd.concat(held, ignore_index=True) if held else pd.Series([], dtype="Int64")

    same = F.col("id") == F.col("_gone")
    once = rows.join(again, same, "left_anti").join(gone.select("_gone"), same, "left_anti")
    many = rows.join(again, same, "left_semi").withColumn("own", own_set("row.text"))
    few = gone.join(again, "_gone", "left_semi")
    left = many.filter("own is not null").join(few, same & (F.col("own") == F.col("_set")), "left_anti").dropDuplicates(["id", "own"])
    return unpacked(clear.unionByName(once.select("row")).unionByName(left.select("row")).unionByName(many.filter("own is null").select("row")), docs)
