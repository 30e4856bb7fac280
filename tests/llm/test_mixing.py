import hashlib
import re

import pytest

from lodestone.llm.mixing import MixParams, mix_sources, take_mix

from .corpora import AWKWARD, cluttered, documents, prose


def count(text):
    return len(re.findall(r"[^ \t\n\r\f\x0b]+", text or ""))


def brute(rows, params):
    """(doc_id, source, epoch, start, n, take) by walking each source's order until its budget is spent."""
    by = {}
    for r in rows:
        key = hashlib.md5(f"{params.seed}|{'' if r[0] is None else r[0]}".encode()).hexdigest()
        by.setdefault(r[3], []).append((key, -(1 << 63) if r[0] is None else r[0], count(r[1]), r[0]))
    by = {s: sorted(v, key=lambda x: x[:3]) for s, v in by.items() if sum(x[2] for x in v)}
    weight = {s: params.weights.get(s, params.other) for s in by}
    total = params.total if params.total is not None else sum(x[2] for v in by.values() for x in v)
    out = []
    for s, v in by.items():
        all_, whole = sum(x[2] for x in v), sum(weight.values())
        budget = int(total * weight[s] / whole) if whole else 0
        epochs, rest = divmod(budget, all_)
        start = 0
        for _, _, n, i in v:
            for e in range(epochs):
                out.append((i, s, e, start, n, n))
            if rest > 0 and start + n <= rest:
                out.append((i, s, epochs, start, n, n))
            elif start < rest:
                out.append((i, s, epochs, start, n, rest - start))
            start += n
    return sorted(out, key=repr)


def rows():
    return [(i, t, "aa", f"s{i % 3 if i % 5 else 0}", len(t)) for i, t in enumerate(prose("aa", 60, 21))] + AWKWARD


PARAMS = [MixParams(), MixParams(weights={"s0": 5.0, "s1": 1.0, "s2": 0.0}, other=2.0, total=20000), MixParams(total=100, seed="other", digits=1), MixParams(total=0), MixParams(other=0.0), MixParams(weights={"s1": 1.0}, other=0.0, broadcast_sources=0)]


@pytest.mark.parametrize("params", PARAMS)
def test_same_as_brute_force(spark, params):
    got = sorted((tuple(r) for r in mix_sources(documents(spark, rows()), params).collect()), key=repr)
    assert got == brute(rows(), params)


@pytest.mark.parametrize("params", PARAMS)
def test_taken_texts(spark, params):
    df = cluttered(documents(spark, rows()))
    taken = take_mix(df, params)
    assert taken.columns == df.columns
    want = {}
    for i, s, _, _, n, take in brute(rows(), params):
        want.setdefault((i, s), []).append(take)
    got = {}
    for r in taken.select("doc_id", "source", "text", "n_chars").collect():
        got.setdefault((r[0], r[1]), []).append(count(r[2]))
        assert r[2] is None or r[3] == len(r[2]) or r[0] in (905, 907, None) or count(r[2]) == 0
    some = lambda x: {k: sorted(v) for k, v in x.items() if sum(v)}
    assert some(got) == some(want)


def test_rows_without_ids_fill_budgets_exactly(spark):
    rows = [(None, "w " * 5, "aa", "few", 10)] * 10 + [(None, "w " * n, "aa", "many", 2 * n) for n in (15, 15, 15, 15, 15, 15, 15, 15, 14, 16)]
    taken = take_mix(documents(spark, rows).repartition(3)).collect()
    assert {s: sum(count(r["text"]) for r in taken if r["source"] == s) for s in ("few", "many")} == {"few": 100, "many": 100}
    assert sorted(count(r["text"]) for r in taken if r["source"] == "many") == [11, 14, 15, 15, 15, 15, 15]


def test_empty(spark):
    assert mix_sources(documents(spark)).count() == take_mix(documents(spark)).count() == 0
    assert mix_sources(documents(spark, [(1, None, None, None, None), (2, " ", "aa", "s", 1)])).count() == 0
