import random
import re

import pytest

from lodestone.llm.html_extraction import ExtractionParams, extract_main_text

SCHEMA = "page_id long, url string, html string"


def pages(n=30, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    nav = {h: [word() for _ in range(14)] for h in ("a.example.com", "b.example.com")}
    out = []
    for i in range(n):
        h = ("a.example.com", "b.example.com")[i % 2]
        own = " ".join(word() for _ in range(r.randint(5, 40)))
        shared = " ".join(nav[h][: r.choice((7, 8, 14))])
        out.append((i, f"http://{h}/{i}", f"<html><script>var x = '</p>';</script><nav>{shared}</nav><p>{own}</p><!-- c --><p>{' '.join(nav[h])} &amp; more{i}</p></html>"))
    return out


def brute(rows, length):
    words = {i: [w.lower() for w in re.findall(r"[A-Za-z0-9]+", re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", h).replace("&amp;", "&"))] for i, _, h in rows}
    host = {i: u.split("/")[2] for i, u, _ in rows}
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - length + 1):
            gram = w[a : a + length]
            if any(j != i and host[j] == host[i] and any(v[b : b + length] == gram for b in range(len(v) - length + 1)) for j, v in words.items()):
                gone |= set(range(a, a + length))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


@pytest.mark.parametrize("params", [ExtractionParams(), ExtractionParams(shard_chars=1500), ExtractionParams(length=4)])
def test_same_as_brute_force(spark, params):
    rows = pages()
    got = {r["page_id"]: [w.lower() for w in re.findall(r"[A-Za-z0-9]+", r["text"])] for r in extract_main_text(spark.createDataFrame(rows, SCHEMA), params).collect()}
    assert got == brute(rows, params.length)


def test_awkward(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    text = "one two three four five six seven eight nine"
    rows = [(None, "http://h/x", f"<p>{text}</p>"), (1, None, "<p>alone here</p>"), (2, "", None), (3, "http://h/y", ""), (4, "nonsense", f"<p>{long}</p>"), (5, "http://h/z", "no end <b"), (6, "http://k/1", f"<p>{text}</p>"), (6, "http://k/1", f"<p>{text}</p>"), (7, "http://m/1", f"<p>{text}</p>"), (8, "http://m/2", f"<p>{text}</p>")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _h", "2 as shard", "3 as text", "4 as host")
    got = extract_main_text(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[2]["text"] == by[3]["text"] == "" and by[1]["text"] == "alone here"
    assert by[4]["n_words"] == by[4]["n_kept"] == 60000
    assert by[6]["text"] == text  # a page shares nothing with itself
    assert by[7]["text"] == by[8]["text"] == "" and by[7]["n_kept"] == 0
    assert by[None]["text"] == text
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_ids_beside_null(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, 4]
    got = extract_main_text(spark.createDataFrame([(i, "http://h/", f"<p>page {i}</p>") for i in ids], SCHEMA)).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == sorted((str(i), f"page {i}") for i in ids)
