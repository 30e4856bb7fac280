import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm.jaccard import JaccardParams, components, keep_one, near_classes, near_duplicates, overlaps, roots

from .corpora import AWKWARD, cluttered, documents, prose


def grams(text, n):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n=3, threshold=0.5):
    """Pairs of representatives, and every other copy with its representative."""
    by = {}
    for r in rows:
        if r[0] is not None and (g := grams(r[1], n)):
            by.setdefault(g, set()).add(r[0])
    out = {}
    reps = {g: min(ids) for g, ids in by.items()}
    for g, ids in by.items():
        for i in ids - {reps[g]}:
            out[reps[g], i] = 1.0
    sets = list(reps)
    for i, a in enumerate(sets):
        for b in sets[:i]:
            s = len(a & b) / len(a | b)
            if s >= threshold and reps[a] != reps[b]:
                key = tuple(sorted((reps[a], reps[b])))
                out[key] = max(out.get(key, 0), round(s, 6))
    return out


def near_copies(seed=11, n=60):
    r = random.Random(seed)
    texts = prose("aa", n, seed)
    out = list(texts)
    for t in texts[: n // 2]:
        w = t.split()
        for _ in range(r.randint(0, 3)):
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = "changed" + str(r.randrange(9))
            out.append(" ".join(w))
    out += texts[:10] * 2
    r.shuffle(out)
    return [(i, t, "aa", "s", len(t)) for i, t in enumerate(out)]


PARAMS = [JaccardParams(), JaccardParams(threshold=0.8, n=2, vertical=1), JaccardParams(n=1, threshold=0.3, vertical=7, fragment_grams=500, block_grams=700), JaccardParams(threshold=0.65, fragment_grams=2000, block_grams=3000)]


@pytest.mark.parametrize("params", PARAMS)
def test_same_as_brute_force(spark, params):
    rows = near_copies() + AWKWARD
    got = {(r[0], r[1]): r[2] for r in near_duplicates(documents(spark, rows), params).collect()}
    assert got == pytest.approx(brute(rows, params.n, params.threshold), abs=2e-6)


def classes(rows, n=3, threshold=0.5):
    """doc_id, class_id, n_links, n_copies of every distinct document, from all pairs of sets."""
    docs = {(r[0], grams(r[1], n)) for r in rows if r[0] is not None}
    sets = sorted({g for _, g in docs if g}, key=sorted)
    alike = {g: [h for h in sets if h != g and len(g & h) / len(g | h) >= threshold] for g in sets}
    ids = {g: sorted(i for i, h in docs if h == g) for g in sets}
    out = []
    for i, g in docs:
        reached, todo = {g}, [g]
        while todo and g:
            fresh = set(alike[todo.pop()]) - reached
            reached |= fresh
            todo += fresh
        out.append((i, min(ids[h][0] for h in reached), len(alike[g]), len(ids[g]) - 1) if g else (i, i, 0, 0))
    return sorted(out)


@pytest.mark.parametrize("params", PARAMS)
def test_classes_same_as_brute_force(spark, params):
    rows = near_copies(5) + AWKWARD + [(3, "another text of id three, like none", "aa", "s", 1), (3, None, None, None, None), (4, "ПРИВЕТ БОЛЬШОЙ МИР СНОВА", "aa", "s", 1), (950, "привет большой мир снова", "aa", "s", 1)]
    got = near_classes(cluttered(documents(spark, rows)), params).collect()
    assert sorted(map(tuple, got)) == classes(rows, params.n, params.threshold)


@pytest.mark.parametrize("step", [1, 50, 1 << 19])
@pytest.mark.parametrize("vertical", [1, 5])
def test_overlaps(step, vertical):
    r = random.Random(8)
    sets = [sorted({r.randrange(40 if k % 3 else 400) for _ in range(r.randint(1, 30))}) for k in range(60)]
    group = np.array([k % 4 for k in range(60)])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    g = np.array([x for s in sets for x in s], np.uint64)
    got = Counter()
    for i, j, n in overlaps(g, at, group, vertical, step):
        for a, b, c in zip(i.tolist(), j.tolist(), n.tolist(), strict=True):
            assert (a, b) not in got
            got[a, b] = c
    want = {(i, j): len(set(sets[i]) & set(sets[j])) for i in range(60) for j in range(i + 1, 60) if group[i] == group[j]}
    assert got == {k: v for k, v in want.items() if v}


def test_roots():
    r = np.random.default_rng(1)
    order = r.permutation(500)
    assert (roots(500, order[:-1], order[1:]) == 0).all()
    assert roots(4, np.array([3]), np.array([1])).tolist() == [0, 1, 2, 1] and roots(2, *np.zeros((2, 0), int)).tolist() == [0, 1]


def test_all_near_copies_meet(spark):
    text = prose("zz", 1, 5, 300, 301)[0].split()
    rows = []
    for i in range(40):
        w = list(text)
        w[i % len(w)] = f"edit{i}"
        rows.append((i, " ".join(w), "zz", "s", 1))
    want = brute(rows)
    assert len(want) == 40 * 39 // 2
    assert {(r[0], r[1]): r[2] for r in near_duplicates(documents(spark, rows)).collect()} == pytest.approx(want, abs=2e-6)


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(21)} | {100: 100, 150: 100, 200: 100}


@pytest.mark.parametrize("params", [JaccardParams(), JaccardParams(fragment_grams=900, block_grams=400)])
def test_keep_one(spark, params):
    rows = near_copies(13, 30) + AWKWARD
    edges = brute(rows)
    group = {}

    def root(x):
        while group.get(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        group[hi] = lo
    want = sorted({r[0] for r in rows if r[0] is not None and root(r[0]) == r[0]})
    df = cluttered(documents(spark, rows))
    kept = keep_one(df, params)
    assert kept.columns == df.columns
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(x for x in got if x is not None) == want and got.count(None) == 1


@pytest.mark.parametrize("params", [JaccardParams(), JaccardParams(fragment_grams=900, block_grams=400)])
def test_texts_that_share_an_id_go_one_by_one(spark, params):
    a, b, c, d, e = prose("aa", 5, 21, 60, 80)
    near = lambda t: t + " changed"
    rows = [(1, a), (7, near(a)), (7, b), (7, c), (7, c), (7, None), (7, "!!"), (8, d), (8, near(d)), (9, e), (9, near(b)), (10, None), (None, a)]
    got = keep_one(documents(spark, [(i, t, "aa", "s", 1) for i, t in rows]), params).collect()
    kept = sorted(((r["doc_id"], r["text"]) for r in got if r["doc_id"] != 8), key=repr)
    assert kept == sorted([(1, a), (7, b), (7, c), (7, None), (7, "!!"), (9, e), (10, None), (None, a)], key=repr)
    assert len([r for r in got if r["doc_id"] == 8]) == 1


def test_empty(spark):
    assert near_duplicates(documents(spark)).count() == 0 and near_classes(documents(spark)).count() == 0
    assert keep_one(documents(spark)).count() == 0
    assert near_duplicates(documents(spark, [(1, None, None, None, None), (2, "", None, None, None)])).count() == 0
