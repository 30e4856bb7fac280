import numpy as np
import pyarrow as pa

from lodestone.llm.language_id import LanguageParams, _grams, identify_language, keep_identified, train_language_model

from .corpora import AWKWARD, LONG, SCHEMA, cluttered, documents, mixed, prose


def test_held_out_accuracy(spark):
    model = train_language_model(mixed(spark))
    held = [(i, t, None, None, None) for i, t in enumerate(prose("aa", 60, 31) + prose("zz", 60, 32))]
    got = {r["doc_id"]: r["language"] for r in identify_language(documents(spark, held), model).collect()}
    assert sum(got[i] == ("aa" if i < 60 else "zz") for i in got) >= 118
    junk = documents(spark, [(1, "1234 5678 --- 99", None, None, None), (2, "qqjjqq jqjqj qjjq jjqqj", None, None, None)])
    assert {r["language"] for r in identify_language(junk, model).collect()} == {"und"}


def test_masks_hold_every_language_of_a_gram(spark):
    rows = [(i, t, "aa" if i % 2 else "bb", "s", 1) for i, t in enumerate(prose("aa", 30))] + [(100 + i, t, "zz", "s", 1) for i, t in enumerate(prose("zz", 30))]
    model = train_language_model(documents(spark, rows))
    assert model.languages == ("aa", "bb", "zz")
    b = np.frombuffer(prose("aa", 1)[0].lower().encode(), np.uint8)
    masks = model.masks(_grams(b, np.array([0, len(b)]))[0])
    assert ((masks & 3) == 3).mean() > 0.5  # both that share their words


def test_false_positives_are_taken_off(spark):
    small = train_language_model(mixed(spark), LanguageParams(slots=1 << 11))
    assert 0.02 < small.rates.max() < 1
    r = np.random.default_rng(1)
    junk = "".join(r.choice(list("qjbdfghp "), 5000))
    raw = small.masks(_grams(np.frombuffer(junk.encode(), np.uint8), np.array([0, len(junk)]))[0])
    hits = max(((raw >> i) & 1).mean() for i in range(2))
    assert small.score(pa.array([junk]))[0].max() < hits / 2
    full = train_language_model(mixed(spark), LanguageParams(slots=1 << 5))  # says nothing at all any more
    assert np.isfinite(full.score(pa.array(["some words", ""]))[0]).all()


def test_awkward(spark):
    df = mixed(spark)
    model = train_language_model(df)
    out = identify_language(cluttered(df), model)
    assert out.columns == ["doc_id", "language", "score", "lead", "ngrams", "keep"]
    got = out.collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["language"] == "und" and not by[i]["keep"] for i in (900, 901, 902, 903))
    assert by[904]["ngrams"] > len(LONG) * 0.9 and by[904]["language"] == "aa"
    assert sum(r["doc_id"] == 905 for r in got) == 2
    kept = keep_identified(cluttered(df), model)
    assert kept.columns == cluttered(df).columns and kept.count() == sum(r["keep"] for r in got)
    none = train_language_model(documents(spark))
    assert {r["language"] for r in identify_language(documents(spark, AWKWARD), none).collect()} == {"und"}
    assert identify_language(spark.createDataFrame([], SCHEMA), model).count() == 0
