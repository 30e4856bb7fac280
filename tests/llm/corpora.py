"""Small tables for the tests: made-up words in two languages, and rows that are awkward on purpose."""

import random

LETTERS = {"aa": "aeioulmnr", "zz": "kztrsxwvy"}


def vocabulary(lang, n=120, seed=1):
    r = random.Random(f"{lang}{seed}")
    return ["".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 7))) for _ in range(n)]


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def prose(lang, n_docs, seed=7, low=20, high=80):
    r = random.Random(seed)
    words = vocabulary(lang)
    return [" ".join(sentence(r, words, r.randint(4, 9)) for _ in range(r.randint(low, high) // 6 + 1)) for _ in range(n_docs)]


LONG = " ".join(prose("aa", 400, seed=99))

#: doc_id, text, lang, source, n_chars
AWKWARD = [
    (None, "Some text without an id.", "aa", "s1", 24),
    (900, None, None, None, None),
    (901, "", "aa", "s1", 0),
    (902, "   \n\t ", "zz", "s2", 6),
    (903, "!!! ??? ###", None, "s2", 11),
    (904, LONG, "aa", None, len(LONG)),
    (905, "same words here today", "aa", "s1", 21),
    (905, "same words here today", "aa", "s1", 21),
    (906, "same words here today", "aa", "s2", 21),
    (907, "été naïve ñandú 東京 😀", "", "s1", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=()):
    return spark.createDataFrame(list(rows), SCHEMA)


def mixed(spark, n=40):
    a, z = prose("aa", n, 3), prose("zz", n, 4)
    own = [(i, t, "aa", f"s{i % 3}", len(t)) for i, t in enumerate(a)] + [(n + i, t, "zz", f"s{i % 4}", len(t)) for i, t in enumerate(z)]
    return documents(spark, own + AWKWARD)


def cluttered(df):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "_s _own _gone _again _copies _cut _epoch _text _n _b _y _h _v row keep score rank fragment signature doc_a node representative window bucket host language mix_key _range".split()
    return df.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(names) if n not in df.columns))
