import heapq
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.packing import PackParams, difference, pack, pack_documents

from .corpora import AWKWARD, cluttered, documents, prose


def textbook(sizes, k):
    """Karmarkar-Karp with full k-tuples of sums."""
    heap = [(-s, i, (s, *[0] * (k - 1))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        c = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        heapq.heappush(heap, (c[-1] - c[0], serial, tuple(c)))
        serial += 1
    return sorted(heap[0][2]) if heap else []


@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_differencing_is_the_textbooks(sizes, k):
    parts = difference(sizes, k)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert sorted([0] * (k - len(parts)) + [sum(sizes[i] for i in p) for p in parts]) == textbook(sizes, k)


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_no_window_overflows(sizes):
    parts = pack(sizes, 100)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 100 for p in parts)
    least = -(-sum(sizes) // 100)
    assert len(parts) >= least
    k = least
    while k < len(parts):
        assert max(textbook(sizes, k)) > 100  # fewer windows were tried and too small
        k += 1


@pytest.mark.parametrize("params", [PackParams(window=64, bucket=16), PackParams()])
def test_every_token_is_in_one_window(spark, params):
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(prose("aa", 80, 5, 10, 200))] + AWKWARD
    got = pack_documents(cluttered(documents(spark, rows)), params).collect()
    pieces, filled = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["copy"]), []).append((r["piece"], r["start_token"], r["n_tokens"]))
        filled.setdefault((r["bucket"], r["window"]), []).append((r["n_tokens"], r["window_tokens"]))
    count = lambda t: len(re.findall(r"[^ \t\n\r\f\x0b]+", t or ""))
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if count(r[1]):
            want[r[0], seen.setdefault(r[0], 0)] = count(r[1])
            seen[r[0]] += 1
    assert {k: sum(p[2] for p in v) for k, v in pieces.items()} == want
    for v in pieces.values():
        v.sort()
        assert [p[1] for p in v] == [sum(q[2] for q in v[:i]) for i in range(len(v))]
    for v in filled.values():
        assert sum(n for n, _ in v) == v[0][1] <= params.window and len({w for _, w in v}) == 1


def test_windows_are_nearly_equal():
    r = random.Random(2)
    sizes = [r.randint(20, 400) for _ in range(500)]
    sums = [sum(sizes[i] for i in p) for p in pack(sizes, 4096)]
    assert max(sums) - min(sums) < 40


@pytest.mark.parametrize(("nulls", "most", "spread"), [(0, 1023, 64), (1100, 5000, 200)])
def test_windows_of_full_buckets_are_nearly_equal(spark, nulls, most, spread):
    r = random.Random(4)
    rows = [(None if i < nulls else i, "w " * r.randint(20, 700), "aa", "s", 1) for i in range(4096)]
    pieces, sums = {}, {}
    for p in pack_documents(documents(spark, rows)).collect():
        pieces[p["bucket"]] = pieces.get(p["bucket"], 0) + 1
        sums.setdefault(p["bucket"], []).append(p["window_tokens"])
    assert sum(pieces.values()) == len(rows) and sum(n > 512 for n in pieces.values()) >= (1 if nulls else 2)
    assert (max(pieces.values()) > 1023) == (nulls > 0) and max(pieces.values()) <= most
    assert max(max(v) - min(v) for v in sums.values()) < spread


def test_large_ids_beside_null(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, -5]
    got = pack_documents(documents(spark, [(i, "some words", "aa", "s", 1) for i in ids]), PackParams(bucket=10)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(ids, key=str)


def test_empty(spark):
    assert pack_documents(documents(spark)).count() == 0
    assert pack_documents(documents(spark, [(1, None, None, None, None), (2, "", None, None, None)])).count() == 0
