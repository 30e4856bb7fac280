import random

import numpy as np
import pytest

from lodestone.llm.topk_search import Best, CoverTree, TopKParams, dual_search, top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, k):
    out = []
    for i, a in vectors.items():
        a = np.array(a, np.float32).astype(float)
        scored = []
        for j, b in vectors.items():
            if i != j:
                b = np.array(b, np.float32).astype(float)
                scored.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), j))
        out += [(i, j, n + 1, -s) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return out


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    return {i: (centres[i % 6] + 0.3 * r.normal(size=d)).tolist() for i in range(n)}


@pytest.mark.parametrize(("params", "n"), [(TopKParams(k=5, node_rows=40, leaf=4), 240), (TopKParams(k=3), 50), (TopKParams(k=4, node_rows=16, max_nodes=3, tree_rows=9, leaf=2, base=2.0), 90)])
def test_same_as_brute_force(spark, params, n):
    vectors = clustered(n, 6, n)
    got = {(r[0], r[2]): (r[1], r[3]) for r in top_k(spark.createDataFrame(list(vectors.items()), SCHEMA), params).collect()}
    want = {(a, n): (b, s) for a, b, n, s in brute(vectors, params.k)}
    assert got.keys() == want.keys()
    assert all(got[x][1] == pytest.approx(want[x][1], abs=2e-9) for x in want)
    assert {x: got[x][0] for x in want} == {x: want[x][0] for x in want}


def test_radii_cover(spark):
    points = np.random.default_rng(3).normal(size=(300, 4))
    tree = CoverTree.build(points, np.arange(300), 8, 1.4)
    assert sorted(tree.ids.tolist()) == list(range(300))
    for c, r, lo, hi in zip(tree.centres, tree.radii, tree.los, tree.his, strict=True):
        assert np.sqrt(((tree.points[lo:hi] - c) ** 2).sum(axis=1)).max() <= r + 1e-9


def test_awkward(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as rank", "'y' as _v", "'z' as node")
    got = sorted(tuple(r) for r in top_k(df, TopKParams(k=2)).collect())
    assert got == [(1, 2, 1, 1.0), (1, 3, 2, 0.0), (2, 1, 1, 1.0), (2, 3, 2, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0


def test_copies_are_ties_by_id(spark):
    random.seed(1)
    got = top_k(spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(30)], SCHEMA), TopKParams(k=3, leaf=4)).collect()
    assert {(r[0], r[1]) for r in got} == {(i, j) for i in range(30) for j in [x for x in range(5) if x != i][:3]}


def _near(seed, n, d=4):
    r = np.random.default_rng(seed)
    centre = r.normal(size=d)
    x = np.concatenate([centre + 1e-6 * r.normal(size=(n, d)), r.normal(size=(50, d))])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def test_ties_of_near_copies_go_to_the_smaller_id():
    x, k = _near(5, 600), 10
    tree = CoverTree.build(x, np.arange(len(x)), 16, 1.4)
    best = Best(len(x), k)
    dual_search(tree, tree, best)
    scores = np.round(x @ x.T, 9)
    np.fill_diagonal(scores, -np.inf)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    assert (best.id == order[tree.ids]).all()


def test_extreme_magnitudes(spark):
    r = np.random.default_rng(6)
    rows = [(i, (v * 10.0 ** ((i % 5 - 2) * 100)).tolist()) for i, v in enumerate(r.normal(size=(60, 5)))]
    got = {(a, n): b for a, b, n, _ in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), TopKParams(k=3, leaf=4)).collect()}
    unit = np.array([np.array(v) / np.abs(v).max() for _, v in rows])
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scores = np.round(unit @ unit.T, 9)
    np.fill_diagonal(scores, -np.inf)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert got == {(i, n + 1): int(order[i, n]) for i in range(60) for n in range(3)}
