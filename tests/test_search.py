import math
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.config import DEFAULT, EngineConfig
from lodestone.operators import indexing, results, search, snippets, stats
from lodestone.sources.documents import from_plain

TEXTS = ["apple banana apple", "banana", "", "cherry apples 42", None, *[f"filler{'abcdefghijklmnopqrst'[i]} common" + " rare" * (i % 3 == 0) for i in range(20)]]


def build(spark, texts, config=DEFAULT):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return indexing.build(from_plain(rows, "doc_id", "text", config), config, keep_tokens=True)


@pytest.fixture(scope="module")
def index(spark):
    return build(spark, TEXTS)


def hits(index, text, **how):
    return [(r["doc_id"], r["score"]) for r in search.search(index, text, **how).collect()]


def terms_of(text):
    import re

    return [w for w in (re.sub("[^a-z]", "", x.lower()) for x in re.findall("[0-9]+|[A-Za-z]+", text or "")) if w]


def plain_index(texts):
    """term -> {doc: impact}"""
    docs = [terms_of(t) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    tf = {}
    for i, d in enumerate(docs):
        for w in d:
            tf.setdefault(w, {}).setdefault(i, 0)
            tf[w][i] += 1
    s = {(w, i): math.log(n / len(p)) * 1.9 * min(c, 255) / (0.9 * (0.6 + 0.4 * (len(docs[i]) / avg)) + min(c, 255)) for w, p in tf.items() for i, c in p.items()}
    lo, hi = min(s.values()), max(s.values())
    out = {}
    for (w, i), x in s.items():
        out.setdefault(w, {})[i] = 1 if hi == lo else math.floor((x - lo) / (hi - lo) * 254.0) + 1
    return out, n


def plain_search(impacts, n, query, k, exhaustive):
    """By repeatedly taking the best next segment, not by a running sum."""
    counts = {}
    for w in terms_of(query):
        if w in impacts:
            counts[w] = counts.get(w, 0) + 1
    segments = {w: {} for w in counts}
    for w in counts:
        for d, i in impacts[w].items():
            segments[w].setdefault(i * counts[w], []).append(d)
    if not counts:
        return []
    if len(counts) == 1:
        kept = [(w, v, ds) for w, g in segments.items() for v, ds in g.items()]
    else:
        rest, kept, total = [(w, v, ds) for w, g in segments.items() for v, ds in g.items()], [], 0
        while rest and (exhaustive or total < max(1, int(0.1 * n))):
            best = min(rest, key=lambda x: (-x[1], len(x[2]), x[0]))
            rest.remove(best)
            kept.append(best)
            total += len(best[2])
    best = {}
    for w, v, _ in kept:
        best[w] = max(best.get(w, 0), v)
    acc = {}
    for _, v, ds in kept:
        for d in ds:
            acc[d] = acc.get(d, 0) + (v if len(counts) == 1 else math.floor(1.0 + v * (255 - len(best)) / sum(best.values())))
    return sorted(acc.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_against_a_plain_search(spark):
    r = random.Random(5)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(0, 30))) for _ in range(150)]
    index, (impacts, n) = build(spark, texts), plain_index(texts)
    queries = [" ".join(r.choices([*words, "zzz"], k=r.randint(0, 6))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    for exhaustive in (False, True):
        got = {}
        for row in search.search_batch(index, frame, 12, 0, exhaustive).orderBy("qid", "rank").collect():
            got.setdefault(row["qid"], []).append((row["doc_id"], row["score"]))
        assert got == {q: w for q, t in enumerate(queries) if (w := plain_search(impacts, n, t, 12, exhaustive))}
        assert all(1 <= s <= 255 for v, q in ((v, queries[k]) for k, v in got.items()) if len(set(q.split())) > 1 for _, s in v)
    assert hits(index, queries[3]) == plain_search(impacts, n, queries[3], 10, False)  # a batch of one


def test_first_document_and_every_term_are_found(index):
    assert hits(index, "apple")[0][0] == 0
    found = {r["term"] for r in index.vocab.collect()}
    assert found == {w for t in TEXTS for w in terms_of(t)}


def test_empty_and_unknown(index):
    assert hits(index, "") == hits(index, "42 77") == hits(index, "unknown") == []
    assert hits(index, "apple 42 unknown") == hits(index, "apple")


def test_only_real_hits(index):
    assert len(hits(index, "cherry", k=10)) == 1
    assert len(hits(index, "banana", k=1000)) == 2


def test_paging_and_prefix(index):
    every = hits(index, "common", k=100)
    assert len(every) == 20 and hits(index, "common", k=5, offset=5) == every[5:10] and hits(index, "common", k=3) == every[:3]
    assert hits(index, "common", k=5, offset=18) == every[18:]
    both = hits(index, "common rare", k=100, exhaustive=True)
    assert hits(index, "common rare", k=5, offset=7, exhaustive=True) == both[7:12]


def test_repeated_term_has_no_wrap(index):
    one = hits(index, "apple")
    assert hits(index, "apple apple") == [(d, 2 * s) for d, s in one]
    assert hits(index, " ".join(["apple"] * 300)) == [(d, 300 * s) for d, s in one]


def test_k_is_checked(index):
    for k, offset in ((0, 0), (1001, 0), (10, -1), (600, 600)):
        with pytest.raises(ValueError):
            search.search(index, "apple", k, offset)


def test_few_documents(spark):
    index = build(spark, ["apple pear", "pear", "plum apple"])
    assert {d for d, _ in hits(index, "apple pear")} <= {0, 1, 2} and hits(index, "apple pear")
    same = build(spark, ["apple", "pear"])
    assert {r["impact"] for r in same.postings.collect()} == {1}


def test_stemming(spark):
    index = build(spark, ["apples", "apple", "berries es", "berry"], replace(DEFAULT, stemmer="s"))
    assert {d for d, _ in hits(index, "apples")} == {0} and {d for d, _ in hits(index, "berries s es")} == {2, 3}


def test_empty_collection(spark):
    index = build(spark, [])
    assert hits(index, "apple") == [] and index.n_docs == 0
    assert {r["metric"]: r["value"] for r in stats.summary(index).collect()}["documents"] == 0
    assert hits(build(spark, ["", None, "42"]), "apple") == []


def test_many_terms(spark):
    words = ["".join("abcdefghijklmnopqrst"[int(c)] for c in f"{i:03d}") for i in range(300)]
    index = build(spark, [" ".join(words), "other", "aaa"])
    with pytest.raises(Exception, match="accumulator_max"):
        hits(index, " ".join(words), exhaustive=True)
    wide = build(spark, [" ".join(words), "other", "aaa"], replace(DEFAULT, accumulator_max=65535))
    assert hits(wide, " ".join(words), exhaustive=True)[0][0] == 0
    with pytest.raises(ValueError):
        EngineConfig(stemmer="porter")
    with pytest.raises(ValueError):
        EngineConfig(accumulator_max=1000)


def test_saturated_frequency(spark):
    index = build(spark, ["word " * 1000, "word other", "third"])
    assert index.postings.filter("term = 'word' and doc_id = 0").first()["tf"] == 255
    assert index.docs.filter("doc_id = 0").first()["len"] == 1000


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = indexing.load(spark, str(tmp_path))
    assert hits(again, "apple common rare") == hits(index, "apple common rare")
    assert stats.sizes(again, str(tmp_path)).keys() == set(indexing.TABLES)
    again.meta.selectExpr("* except (version)", "7 as version").write.mode("overwrite").parquet(f"{tmp_path}/other")
    (tmp_path / "meta").rename(tmp_path / "old")
    (tmp_path / "other").rename(tmp_path / "meta")
    with pytest.raises(ValueError, match="version"):
        indexing.load(spark, str(tmp_path))


def test_run_file(spark, index, tmp_path):
    frame = spark.createDataFrame([(7, "cherry"), (3, "banana apple")], "qid long, query string")
    found = search.search_batch(index, frame)
    results.write_run(index, found, f"{tmp_path}/run", "tag")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/run").collect()]
    assert sorted(lines) == sorted(r[0] for r in results.run_lines(index, found, "tag").collect())
    assert any(x.startswith("7 Q0 3 1 ") and x.endswith(" tag") for x in lines)


def plain_window(tokens, hit, size=100):
    """Slide word by word; the first best window, then back to its sentence."""
    n = len(tokens)
    if n <= size:
        return 0
    now = best = sum(hit[:size])
    at = 0
    for i in range(size, n):
        now += hit[i] - hit[i - size]
        if now > best:
            best, at = now, i
    i = at
    while i > 1 and not tokens[i - 1].endswith("."):
        i -= 1
    return i


def test_snippets(spark):
    r = random.Random(3)
    docs = [[r.choice(["alpha", "beta", "gamma", "end.", "x-y", "Key", "key."]) if r.random() < 0.5 else "pad" for _ in range(n)] for n in (0, 1, 50, 99, 100, 101, 150, 320, 1000)]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>").selectExpr("doc_id", "cast(doc_id as string) as name", "'' as title", "tokens")
    index = indexing.build(rows, keep_tokens=True)
    asked = spark.createDataFrame([(0, "key", 1), (0, "alpha", 1)], "qid long, term string, cnt int")
    found = spark.createDataFrame([(0, i) for i in range(len(docs))], "qid long, doc_id long")
    got = {r["doc_id"]: r["snippet"] for r in snippets.snippets(index, found, asked, "[", "]").collect()}
    for i, d in enumerate(docs):
        hit = [int("".join(c for c in t.lower() if c.isalpha()) in ("key", "alpha")) for t in d]
        start = plain_window(d, hit)
        assert got[i] == " ".join(f"[{t}]" if h else t for t, h in list(zip(d, hit, strict=True))[start : start + 100])
    bare = indexing.build(rows)
    assert {r["snippet"] for r in snippets.snippets(bare, found, asked).collect()} == {""}


@given(st.lists(st.tuples(st.integers(1, 5), st.integers(1, 9), st.sampled_from("abcd")), min_size=1, max_size=12), st.integers(1, 30))
@settings(max_examples=300, deadline=None)
def test_running_sum_is_greedy(segments, budget):
    """Preceding sums in the order of choice keep what greedy choice keeps."""
    order = sorted(segments, key=lambda s: (-s[0], s[1], s[2]))
    window = [s for i, s in enumerate(order) if sum(x[1] for x in order[:i]) < budget]
    rest, greedy, total = list(segments), [], 0
    while rest and total < budget:
        best = min(rest, key=lambda s: (-s[0], s[1], s[2]))
        rest.remove(best)
        greedy.append(best)
        total += best[1]
    assert window == greedy


@pytest.mark.parametrize("pushed", [0, 256])
def test_terms_are_pushed_to_the_scan(spark, tmp_path, pushed):
    config = replace(DEFAULT, pushed_query_terms=pushed)
    stored = build(spark, TEXTS, config)
    plan = search.search_batch(stored, spark.createDataFrame([(0, "apple banana")], "qid long, query string"))
    text = plan._jdf.queryExecution().toString()
    assert ("In(term, [apple,banana])" in text) == (pushed > 0)
    assert [(r["doc_id"], r["rank"]) for r in plan.orderBy("rank").collect()] == [(r["doc_id"], r["rank"]) for r in search.search_batch(build(spark, TEXTS), spark.createDataFrame([(0, "apple banana")], "qid long, query string")).orderBy("rank").collect()]


@pytest.mark.parametrize("cells", [40, 1 << 21])
@pytest.mark.parametrize("exhaustive", [False, True])
def test_large_batches_by_blocks(spark, cells, exhaustive):
    """Blocks of ids and chunks of queries find what one plan for rows of ids finds, and make no row of each id."""
    r = random.Random(8)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(40)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(40)], k=r.randint(0, 20))) for _ in range(200)]
    index = build(spark, texts, replace(DEFAULT, block_docs=64, pushed_query_terms=0, chunk_cells=cells))
    frame = spark.createDataFrame([(q, " ".join(r.choices([*words, "zzz"], k=r.randint(0, 5)))) for q in range(30)], "qid long, query string")
    for k, offset in ((5, 0), (4, 3), (1000, 0)):
        got = search.search_batch(index, frame, k, offset, exhaustive)
        scored = search.rescale(search.prune(index, search.matched(index, search.parse_queries(frame, index.config)), exhaustive), index.config)
        want = search.ranked(search.accumulate(index, scored), k, offset)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Explode" not in got._jdf.queryExecution().toString()


def test_only_words_of_found_documents_are_read(spark, tmp_path):
    """The ids found go to the scan, below the tokenising; more of them than one query finds are joined."""
    spark.createDataFrame(list(enumerate(["key one", "two", "three key"])), "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    found = spark.createDataFrame([(0, 2), (1, 2), (0, 0)], "qid long, doc_id long")
    for most, named in ((1000, True), (1, False)):
        config = replace(DEFAULT, max_k=most)
        plan = snippets.words_of(indexing.build(from_plain(rows, "doc_id", "text"), config, keep_tokens=True), found)
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert (" IN (" in text and text.index("regexp_extract_all") < text.index(" IN (")) == named
        assert sorted(map(tuple, plan.collect())) == [(0, ["key", "one"]), (2, ["three", "key"])]
