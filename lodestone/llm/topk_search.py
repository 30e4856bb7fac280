"""Exact top-k search by dual-tree traversal of cover trees over queries and data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import local_path, mix, shared_dir, stored

SLACK = 1e-7
ROUNDING = 6e-10


@dataclass(frozen=True)
class TopKParams:
    """``k`` nearest by cosine similarity. The top level of the tree has about a node for each ``node_rows`` vectors, at most
    ``max_nodes``; its centres come from a sample of ``sample`` vectors a node, which affects the cost alone. A node of more
    than ``tree_rows`` vectors is several trees."""

    k: int = 10
    node_rows: int = 1024
    max_nodes: int = 4096
    sample: int = 8
    tree_rows: int = 16384
    leaf: int = 64
    base: float = 1.4


class CoverTree:
    """Nodes in flat arrays: centre, covering radius, range of the points beneath in the tree's own order, children.

    Each level covers its points by balls 1 / ``base`` as wide as the level above; a node that few points or poor covering
    leave is a leaf.
    """

    fields = ("points", "ids", "centres", "radii", "los", "his", "kids", "kid_at")

    def __init__(self, **arrays: np.ndarray):
        for f in self.fields:
            setattr(self, f, arrays[f])

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int, base: float) -> CoverTree:
        centres, radii, los, his, kids, order = [], [], [], [], [], []

        def add(own: np.ndarray, centre: np.ndarray, distance: np.ndarray) -> int:
            at = len(centres)
            centres.append(centre)
            radii.append(float(distance.max()))
            los.append(len(order))
            his.append(0)
            kids.append([])
            groups: list[tuple[np.ndarray, int, np.ndarray]] = []
            left, reach = own, radii[at] / base
            while len(own) > leaf and len(left) and reach > 0:
                d = np.sqrt(np.maximum(0, ((points[left] - points[left[0]]) ** 2).sum(axis=1)))
                near = d <= reach
                groups.append((left[near], int(left[0]), d[near]))
                left = left[~near]
                if len(groups) > len(own) // 8 + 2:
                    groups = []
                    break
            if len(groups) > 1:
                for members, middle, d in groups:
                    kids[at].append(add(members, points[middle], d))
            else:
                order.extend(own.tolist())
            his[at] = len(order)
            return at

        if len(points):
            middle = points.mean(axis=0)
            add(np.argsort(ids, kind="stable"), middle, np.sqrt(((points - middle) ** 2).sum(axis=1)))
        kid_at = np.concatenate([[0], np.cumsum([len(k) for k in kids], dtype=np.int64)]).astype(np.int64)
        o = np.array(order, dtype=np.int64)
        return cls(points=points[o], ids=ids[o], centres=np.array(centres).reshape(len(centres), points.shape[1]), radii=np.array(radii), los=np.array(los, np.int64), his=np.array(his, np.int64), kids=np.array([x for k in kids for x in k], np.int64), kid_at=kid_at)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of the nodes, and which of the nodes each is beneath."""
        n = self.kid_at[nodes + 1] - self.kid_at[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        return self.kids[self.kid_at[nodes][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)], of

    def is_leaf(self, nodes: np.ndarray) -> np.ndarray:
        return self.kid_at[nodes + 1] == self.kid_at[nodes]


class Best:
    """The best k so far of each query: similarities rounded to 9 digits, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, lo: int, hi: int) -> float:
        """The distance that the kth of every query in the range lies within; what rounding adds to a score doesn't count."""
        return float(np.sqrt(np.maximum(0, 2 - 2 * (self.score[lo:hi, -1].min() - ROUNDING)))) + SLACK

    def offer(self, lo: int, hi: int, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.round(scores, 9)
        scores = np.where(own[:, None] == ids[None, :], -np.inf, scores)
        rows = np.flatnonzero((scores >= self.score[lo:hi, -1:]).any(axis=1))
        if not len(rows):
            return
        s = np.concatenate([self.score[lo:hi][rows], scores[rows]], axis=1)
        i = np.concatenate([self.id[lo:hi][rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        cut = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        r, c = np.nonzero(s >= cut[:, None])
        sv, iv = s[r, c], i[r, c]
        o = np.lexsort((iv, -sv, r))
        first = np.searchsorted(r[o], np.arange(len(rows)))
        place = np.arange(len(o)) - first[r[o]]
        o, place = o[place < self.k], place[place < self.k]
        self.score[lo + rows[r[o]], place] = sv[o]
        self.id[lo + rows[r[o]], place] = iv[o]


def dual_search(q: CoverTree, d: CoverTree, best: Best) -> None:
    """Offer to each query what ``d`` holds, descending both trees and dropping pairs of nodes whose balls are further apart
    than the query node's worst kth."""
    if not len(q.radii) or not len(d.radii):
        return
    qs, ds = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    worst = np.array([best.worst(lo, hi) for lo, hi in zip(q.los, q.his, strict=True)])
    while len(qs):
        gap = np.sqrt(((q.centres[qs] - d.centres[ds]) ** 2).sum(axis=1)) - q.radii[qs] - d.radii[ds]
        ok = gap <= worst[qs]
        qs, ds, gap = qs[ok], ds[ok], gap[ok]
        ql, dl = q.is_leaf(qs), d.is_leaf(ds)
        done = ql & dl
        leaves.append((qs[done], ds[done], gap[done]))
        split_q = ~done & (dl | (~ql & (q.radii[qs] >= d.radii[ds])))
        split_d = ~done & ~split_q
        kq, of = q.children(qs[split_q])
        kd, od = d.children(ds[split_d])
        qs, ds = np.concatenate([kq, qs[split_d][od]]), np.concatenate([ds[split_q][of], kd])
    lq, ld, gap = (np.concatenate(x) for x in zip(*leaves, strict=True))
    order = np.lexsort((gap, lq))
    lq, ld, gap = lq[order], ld[order], gap[order]
    for node in np.unique(lq):
        a, b = np.searchsorted(lq, [node, node + 1])
        lo, hi = int(q.los[node]), int(q.his[node])
        while a < b:
            limit = best.worst(lo, hi)
            if gap[a] > limit:
                break
            take, points = [], 0
            while a < b and points < 512 and gap[a] <= limit:
                take.append(np.arange(d.los[ld[a]], d.his[ld[a]]))
                points += len(take[-1])
                a += 1
            at = np.concatenate(take)
            best.offer(lo, hi, q.ids[lo:hi], q.points[lo:hi] @ d.points[at].T, d.ids[at])


def _vectors(column, size: int) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else column, dtype=np.float64).reshape(len(column), size)


def _unit(x: np.ndarray) -> np.ndarray:
    """Each row at length 1; divided by its largest magnitude first, so that no square under- or overflows."""
    with np.errstate(under="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_TREES: dict[tuple[str, int], CoverTree] = {}


def _load_tree(trees: str, node: int, size: int) -> CoverTree:
    """A tree from the shared folder; a worker keeps the last few."""
    if (trees, node) not in _TREES:
        place = local_path(trees)
        fs, base = (pafs.LocalFileSystem(), place) if place else pafs.FileSystem.from_uri(trees)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/name={node}")) if f.path.endswith(".parquet")]
        row = pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read() for f in files]).to_pylist()[0]
        kind = {"points": np.float64, "centres": np.float64, "radii": np.float64}
        arrays = {f: np.frombuffer(row[f], kind.get(f, np.int64)) for f in CoverTree.fields}
        while len(_TREES) >= 48:
            _TREES.pop(next(iter(_TREES)))
        _TREES[trees, node] = CoverTree(**arrays | {f: arrays[f].reshape(-1, size) for f in ("points", "centres")})
    return _TREES[trees, node]


def top_k(vectors: DataFrame, params: TopKParams = TopKParams()) -> DataFrame:
    """vec_id, neighbor_id, rank (from 1), score: each vector's k most similar others, exactly.

    Similarities are rounded to 9 digits, ties go to the smaller id. A vector isn't its own neighbour; equal
    vectors with other ids are. Rows without vec_id, and vectors that are null, empty, all zero, hold null or no number, or
    have another length than most (of equally frequent lengths the greatest counts), take no part. Of rows that repeat an id
    the smallest vector counts. Fewer than k others give fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    where = shared_dir(spark)
    v = F.col("_v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_v"))
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine)
    lengths = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = "vec_id long, neighbor_id long, rank int, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    size = int(lengths["n"])
    rows = stored(rows.filter(F.size(v) == size).groupBy("vec_id").agg(F.min("_v").alias("_v")), f"{where}/rows")
    n = rows.count()
    n_nodes = min(params.max_nodes, -(-n // params.node_rows))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_nodes * params.sample).toPandas()
    points = _unit(_vectors(sample["_v"], size))
    pivots, gap = [0], np.full(len(points), np.inf)
    for _ in range(n_nodes - 1):
        gap = np.minimum(gap, ((points - points[pivots[-1]]) ** 2).sum(axis=1))
        if gap.max() <= 0:
            break
        pivots.append(int(gap.argmax()))
    cast = spark.sparkContext.broadcast(points[pivots])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cast.value), np.int64)
        for batch in batches:
            x = _unit(batch.column("_v").flatten().to_numpy().reshape(batch.num_rows, size))
            n += np.bincount((x @ cast.value.T).argmax(axis=1), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["cell", "n"])

    # a cell of more than a tree should hold is cut by a hash
    held = rows.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    cuts = np.maximum(1, -(-held["n"].to_numpy() // params.tree_rows))
    begin = np.concatenate([[0], np.cumsum(cuts)[:-1]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column("_v").flatten().to_numpy().reshape(batch.num_rows, size))
            node = (x @ cast.value.T).argmax(axis=1)
            node = begin[node] + (mix(batch.column("vec_id").to_numpy().view(np.uint64)) % cuts[node].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "vec_id", "v"])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(r) for r in pdf["v"]])
        tree = CoverTree.build(x, pdf["vec_id"].to_numpy(np.int64), params.leaf, params.base)
        return pd.DataFrame({"node": pdf["node"].iloc[:1], "centre": [tree.centres[0].tobytes()], "radius": [tree.radii[0]], **{f: [np.ascontiguousarray(getattr(tree, f)).tobytes()] for f in CoverTree.fields}})

    binary = ", ".join(f"{f} binary" for f in CoverTree.fields)
    grown = rows.mapInArrow(assign, "node int, vec_id long, v binary").groupBy("node").applyInPandas(grow, f"node int, centre binary, radius double, {binary}")
    trees = f"{where}/trees"
    grown.withColumn("name", F.col("node")).write.partitionBy("name").parquet(trees)
    top = spark.read.parquet(trees).select("node", "centre", "radius").toPandas().sort_values("node")
    nodes = top["node"].to_numpy(np.int64)
    centres, radii = np.stack([np.frombuffer(c) for c in top["centre"]]), top["radius"].to_numpy(float)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node in batch.column("node").to_pylist():
                q = _load_tree(trees, node, size)
                best = Best(len(q.ids), params.k)
                dual_search(q, q, best)
                own = int(np.searchsorted(nodes, node))
                gaps = np.sqrt(((centres - centres[own]) ** 2).sum(axis=1)) - radii - radii[own]
                for other in np.lexsort((nodes, gaps)):
                    if gaps[other] > best.worst(0, len(q.ids)):
                        break
                    if other != own:
                        dual_search(q, _load_tree(trees, int(nodes[other]), size), best)
                ok = np.isfinite(best.score)
                r, c = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[r]), pa.array(best.id[r, c]), pa.array((c + 1).astype(np.int32)), pa.array(best.score[r, c])], names=["vec_id", "neighbor_id", "rank", "score"])

    return spark.createDataFrame([(int(x),) for x in nodes], "node int").repartition(len(nodes), "node").mapInArrow(search, schema)
