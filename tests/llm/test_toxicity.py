import random

import numpy as np

from lodestone.llm.toxicity import ToxicityParams, find_toxic, fit_toxicity, train_toxicity_model

from .corpora import AWKWARD, SCHEMA, cluttered, documents, sentence, vocabulary

BAD = ["vilescum", "wretchbag", "fouldreg", "nastrot"]


def corpus(n, seed):
    r = random.Random(seed)
    words = vocabulary("aa")
    rows, labels, where = [], [], {}
    for i in range(n):
        s = [sentence(r, words, r.randint(4, 10)) for _ in range(r.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            k = r.randrange(len(s))
            w = s[k].split()
            w[r.randrange(len(w)) : 0] = [r.choice(BAD), r.choice(BAD)]
            s[k] = " ".join(w)
            where[i] = k
        rows.append((i, " ".join(s), "aa", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels, where


def test_held_out_documents_and_sentences(spark):
    rows, labels, _ = corpus(400, 1)
    model = train_toxicity_model(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held, _, where = corpus(200, 2)
    got = {}
    for r in find_toxic(documents(spark, held), model).collect():
        got.setdefault(r["doc_id"], set()).add(r["sentence_no"])
        assert r["toxicity"] >= 0.5
    assert len(got.keys() & where.keys()) >= 0.95 * len(where)
    assert len(got.keys() - where.keys()) <= 2
    assert sum(where[i] in got.get(i, ()) for i in where) >= 0.95 * len(where)


def test_noisy_or(spark):
    docs = [(np.array([1, 2, 3]), np.array([0, 2])), (np.array([1, 2]), np.array([0]))] * 20
    model = fit_toxicity(docs, np.array([1.0, 0.0] * 20), ToxicityParams(buckets=8))
    assert model.weights[3] > 1 and model.weights[1] == model.weights[2] == 0


def test_evidence_scales_with_the_toxic_rows():
    def weight(toxic, having):
        docs = [(np.array([1, 3] if i < having else [1, 2]), np.array([0])) for i in range(toxic * 10)]
        return fit_toxicity(docs, np.array([1.0] * toxic + [0.0] * toxic * 9), ToxicityParams(buckets=8)).weights[3]

    assert weight(4, 4) > 1 and weight(400, 4) == 0 and weight(400, 80) > 1


def test_rare_words_share_a_beginning(spark):
    rows, labels, _ = corpus(80, 5)
    rows = [r for r in rows if r[0] % 4]
    labels = [x for x in labels if x[0] % 4]
    ends = ["banol", "curem", "dosit", "fanur", "gelor", "hirum"]
    bad = [(1000 + i, f"{rows[i][1]} Vile{e}.", "aa", "s", 1) for i, e in enumerate(ends)]
    model = train_toxicity_model(documents(spark, rows + bad), spark.createDataFrame(labels + [(r[0], 1, 1) for r in bad], "doc_id long, quality int, toxic int"))
    new = documents(spark, [(1, "All is well. So vilekamor it is.", "aa", "s", 1), (2, "All is well. So it is.", "aa", "s", 1)])
    assert [(r["doc_id"], r["sentence_no"]) for r in find_toxic(new, model).collect()] == [(1, 1)]


def test_awkward(spark):
    rows, labels, _ = corpus(200, 3)
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (7, 0, 9), (99999, 0, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'t' as text", "1 as _y")
    df = cluttered(documents(spark, rows + AWKWARD + [(950, "Vilescum fouldreg! " * 3000, None, None, None), (951, "vilescum wretchbag fouldreg", None, None, None), (951, "vilescum wretchbag fouldreg", None, None, None)]))
    model = train_toxicity_model(df, table)
    out = find_toxic(df, model)
    assert out.columns == ["doc_id", "toxicity", "sentence_no", "sentence", "sentence_score"]
    got = [r["doc_id"] for r in out.collect()]
    assert not {900, 901, 902, 903} & set(got) and got.count(950) == 3000 and got.count(951) == 2
    assert find_toxic(spark.createDataFrame([], SCHEMA), model).count() == 0
    none = train_toxicity_model(df, table.filter("toxic = 0"))
    assert find_toxic(df, none).count() == 0
    empty = train_toxicity_model(spark.createDataFrame([], SCHEMA), table.limit(0))
    assert find_toxic(df, empty).count() == 0
