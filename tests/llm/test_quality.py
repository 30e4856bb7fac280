import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm.quality import FEATURES, MONOTONE, QualityParams, fit_trees, keep_good, score_quality, statistics, train_quality_model

from .corpora import AWKWARD, LONG, SCHEMA, cluttered, documents, prose


def corpus(n, seed):
    r = random.Random(seed)
    good = prose("aa", n, seed)
    bad = [" | ".join(r.choice(["buy", "NOW", "$$$", "win"]) for _ in range(r.randint(5, 60))) for _ in range(n)]
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(good)] + [(n + i, t, "aa", "s", 1) for i, t in enumerate(bad)]
    return rows, [(i, int(i < n), 0) for i in range(2 * n)]


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = corpus(150, 1)
    model = train_quality_model(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    held, truth = corpus(100, 2)
    got = {r["doc_id"]: r["keep"] for r in score_quality(documents(spark, held), model).collect()}
    assert sum(got[i] == bool(q) for i, q, _ in truth) >= 195


def walk(model, x):
    out = model.prior
    for root in model.roots:
        node = root
        while model.left[node] != node:
            node = model.left[node] if x[model.feature[node]] <= model.cut[node] else model.right[node]
        out += model.value[node]
    return 1 / (1 + np.exp(-out))


def test_flat_arrays_score_like_a_walk_and_monotonically():
    r = np.random.default_rng(4)
    x = r.normal(size=(600, len(FEATURES)))
    y = ((x[:, 2] < 0.3) & (x[:, 6] + x[:, 0] * x[:, 1] > -0.2) ^ (r.random(600) < 0.1)).astype(float)
    model = fit_trees(x, y, QualityParams(trees=25))
    assert model.predict(x) == pytest.approx([walk(model, v) for v in x])
    assert ((model.predict(x) > 0.5) == y).mean() > 0.85
    base = r.normal(size=(50, len(FEATURES)))
    for name, sign in MONOTONE.items():
        runs = []
        for v in np.linspace(-4, 4, 41):
            moved = base.copy()
            moved[:, FEATURES.index(name)] = v
            runs.append(model.predict(moved))
        assert (np.diff(np.array(runs), axis=0) * sign >= -1e-12).all()


def plain(text):
    w, lines = text.split(), [x for x in text.split("\n") if x]
    solid = [b for b in text.encode() if b not in b" \t\n\r\x0b\x0c"]
    return [len(w), sum(len(x.encode()) for x in w) / max(len(w), 1), sum(65 <= b <= 90 for b in solid) / max(len(solid), 1), len(set(w)) / max(len(w), 1), max((w.count(x) for x in w), default=0) / max(len(w), 1), 1 - len(set(lines)) / len(lines) if lines else 0, text.count("|") / max(len(w), 1)]


def test_statistics():
    texts = ["One two two.\nLine | b\nLine | b\n", "", "   ", "ÉTÉ naïve", "a\n\na", LONG, "x"]
    got = statistics(pa.array([*texts, None]))
    pick = [FEATURES.index(f) for f in ("n_words", "word_length", "upper", "unique_words", "top_word", "line_repeats", "pipes")]
    assert got[:-1, pick].tolist() == pytest.approx(np.array([plain(t) for t in texts])) if False else np.allclose(got[:-1][:, pick], [plain(t) for t in texts])
    assert not got[-1].any()


def test_awkward(spark):
    rows, labels = corpus(60, 3)
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (99999, 0, 1), (4, 7, 0)], LABELS).selectExpr("*", "'t' as text", "1 as _y")
    df = cluttered(documents(spark, rows + AWKWARD))
    model = train_quality_model(df, table)
    got = score_quality(df, model).collect()
    assert len(got) == df.count() and len({r["quality"] for r in got if r["doc_id"] == 905}) == 1
    kept = keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["keep"] for r in got)
    for labels_left in (table.limit(0), table.filter("quality = 1"), table.filter("quality = 0")):
        constant = train_quality_model(df, labels_left)
        assert keep_good(df, constant).count() == df.count()
    assert score_quality(spark.createDataFrame([], SCHEMA), model).count() == 0
