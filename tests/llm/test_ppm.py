import math

import numpy as np
import pytest

from lodestone.llm.ppm import PpmParams, Trie, _load, adaptive_bits, grams_of, score_documents

from .corpora import AWKWARD, cluttered, documents, prose


def trained(texts, order):
    trie = {}
    for t in texts:
        data = bytes(order) + t.encode()
        for at in range(order, len(data)):
            for k in range(order + 1):
                level = trie.setdefault(data[at - k : at], {})
                level[data[at]] = level.get(data[at], 0) + 1
    return trie


def bits_of(trie, text, order):
    data = bytes(order) + text.encode()
    bits = 0.0
    for at in range(order, len(data)):
        shut = set()
        for k in range(order, -1, -1):
            seen = trie.get(data[at - k : at])
            if seen is None:
                continue
            free = {s: c for s, c in seen.items() if s not in shut}
            room = sum(free.values()) + len(free)
            if data[at] in free:
                bits += math.log2(room / free[data[at]])
                break
            if free:
                bits += math.log2(room / len(free))
            shut = set(seen)
        else:
            bits += math.log2(256 - len(shut))
    return bits


TEXTS = [t.lower() for t in prose("aa", 12, 8)] + ["été naïve", "x"]


@pytest.mark.parametrize("order", [0, 1, 4, 7])
def test_trie_like_brute_force(order):
    seen, held = TEXTS[:8], [*TEXTS[8:], "Qq#1"]
    b = np.frombuffer("".join(seen).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in seen])])
    keys, n = np.unique(grams_of(b, offsets, order), return_counts=True)
    trie, slow = Trie.build(keys, n, order), trained(seen, order)
    for t in held:
        own = np.frombuffer(t.encode(), np.uint8)
        got = trie.code_lengths(grams_of(own, np.array([0, len(own)]), order)).sum()
        assert got == pytest.approx(bits_of(slow, t, order), rel=1e-9)


def test_every_context_adds_up_to_one():
    b = np.frombuffer("".join(TEXTS[:6]).encode(), np.uint8)
    keys, n = np.unique(grams_of(b, np.array([0, len(b)]), 3), return_counts=True)
    trie = Trie.build(keys, n, 3)
    for context in (b"\0\0\0", b"a l", b"zzz", bytes(b[5:8])):
        grams = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (2 ** -trie.code_lengths(grams)).sum() == pytest.approx(1)


@pytest.mark.parametrize("params", [PpmParams(), PpmParams(shard_nodes=100), PpmParams(order=2, folds=3), PpmParams(order=2, folds=1, shard_nodes=50), PpmParams(order=0), PpmParams(order=7, shard_nodes=1000)])
def test_scores(spark, params):
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(prose("aa", 20, 9, 10, 30))] + [r for r in AWKWARD if r[0] != 904]
    df = cluttered(documents(spark, rows))
    from lodestone.llm.ppm import _fold

    fold = {r[0]: r[1] for r in df.select("doc_id", _fold(params)).collect()}
    tries = {f: trained([r[1] or "" for r in rows if fold[r[0]] != f or params.folds == 1], params.order) for f in range(params.folds)}
    want = sorted((str(r[0]), len((r[1] or "").encode()), round(bits_of(tries[fold[r[0]]], r[1] or "", params.order), 1)) for r in rows)
    got = score_documents(df, params).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [w[:2] for w in want]
    assert [x for _, _, x in sorted((str(r[0]), r[1], r[2]) for r in got)] == pytest.approx([w[2] for w in want], abs=0.11)
    assert all((r[3] is None) == (r[1] == 0) for r in got)


def test_adaptive(spark):
    assert adaptive_bits(None) == adaptive_bits("") == 0
    assert adaptive_bits("a") == pytest.approx(8)
    assert adaptive_bits("abab" * 50) < 0.2 * adaptive_bits("".join(chr(33 + i * 7919 % 90) for i in range(200)))


def test_long_and_empty(spark):
    assert score_documents(documents(spark)).count() == 0
    got = score_documents(documents(spark, [AWKWARD[5], (1, AWKWARD[5][1], None, None, None), (2, AWKWARD[5][1][::-1], None, None, None), (3, "x", None, None, None)])).collect()
    assert max(r["n_bytes"] for r in got) == len(AWKWARD[5][1].encode())


def test_a_missing_trie_raises(tmp_path):
    with pytest.raises(FileNotFoundError):
        _load(f"file:{tmp_path}/none", 0, 0, 4)
