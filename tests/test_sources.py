import base64
import io
import tarfile
import threading

import pytest

from lodestone.operators import expansion, indexing, search
from lodestone.sources import documents, interchange
from lodestone.streaming import service


def test_html_folder(spark, tmp_path):
    (tmp_path / "b" / "c d").mkdir(parents=True)
    (tmp_path / "z.html").write_text("<title>Zed</title>last words")
    (tmp_path / "b" / "a+b.html").write_text("first")
    (tmp_path / "b" / "c d" / "é.html").write_text("second &eacute;")
    (tmp_path / "b" / "skip.txt").write_text("not this")
    corpus = documents.read_html(spark, str(tmp_path), snippets=True)
    got = [(r["doc_id"], r["name"], r["title"], r["tokens"]) for r in corpus.orderBy("doc_id").collect()]
    assert got == [(0, "b/a+b.html", "", ["first"]), (1, "b/c d/é.html", "", ["second"]), (2, "z.html", "Zed", ["last", "words"])]
    one = documents.read_html(spark, f"{tmp_path}/z.html").first()
    assert one["name"] == f"{tmp_path}/z.html" and one["title"] == "Zed"
    assert [r["name"] for r in documents.skipped(spark, str(tmp_path), ".html").collect()] == ["b/skip.txt"]


def test_base64_names(spark, tmp_path):
    for name in ("http://a.b/c?d=é", "plain"):
        (tmp_path / (base64.b64encode(name.encode()).decode() + ".html")).write_text("x")
    assert {r["name"] for r in documents.read_html(spark, str(tmp_path), base64_names=True).collect()} == {"http://a.b/c?d=é", "plain"}


def test_trec(spark, tmp_path):
    (tmp_path / "one.xml").write_text("stray words <DOC><DOCNO> AB-1 </DOCNO><HL>Head</HL>\nbody 42</DOC><DOC>< DOCNO >DOC_2</DOCNO>more</DOC>")
    (tmp_path / "two.xml").write_text("<DOC><DOCNO>C3</DOCNO></DOC>")
    (tmp_path / "three.txt").write_text("<DOC><DOCNO>D4</DOCNO>x</DOC>")
    got = [(r["doc_id"], r["name"], r["tokens"]) for r in documents.read_trec(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(0, "AB-1", ["Head", "body", "42"]), (1, "DOC", ["2", "more"]), (2, "C3", [])]


def test_tar(spark, tmp_path):
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member in ("x/1.html", "x/skip.md"):
                info = tarfile.TarInfo(f"{name}/{member}")
                info.size = 4
                t.addfile(info, io.BytesIO(b"word"))
    assert [r["name"] for r in documents.read_tar(spark, str(tmp_path)).orderBy("doc_id").collect()] == ["a.tar/x/1.html", "b.tar.gz/x/1.html"]


def test_ids_are_dense_and_in_order(spark):
    rows = spark.createDataFrame([(f"n{i * 7919 % 5000:05d}",) for i in range(5000)], "name string")
    got = documents.numbered(rows, "name").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(5000)) and [r["name"] for r in got] == [f"n{i:05d}" for i in range(5000)]


def test_topics(spark, tmp_path):
    (tmp_path / "t").write_text("301 international crime\nspinach recipe\n99999999999999999999 huge\n7\n8 9 x\n")
    assert [tuple(r) for r in documents.read_topics(spark, f"{tmp_path}/t").collect()] == [(301, "international crime"), (0, "spinach recipe"), (0, "99999999999999999999 huge"), (0, "7"), (8, "9 x")]


def test_synonyms(spark):
    rows = spark.createDataFrame([(1, "dal"), (1, "dal"), (2, "soup")], "qid long, term string")
    got = sorted(map(tuple, expansion.expand(rows).collect()))
    assert got == sorted([(1, "dal"), (1, "dal"), (2, "soup"), *((1, t) for t in ("lentil", "dahl", "dhal", "daal"))])


LISTS = [("apple", [(0, 300), (2, 1)]), ("pear", [(1, -1), (2, 7)]), ("plum", [(2, 0)])]


def written(path, records=("d0", "d1", "d2"), order=(0, 1, 2)):
    out = interchange.framed(interchange.encode_header(len(LISTS), len(records), 310, 1.5, "made up"))
    for term, rows in LISTS:
        out += interchange.framed(interchange.encode_postings(term, 9, 11, [d for d, _ in rows], [t for _, t in rows]))
    for i in order:
        out += interchange.framed(interchange.encode_document(i, records[i], 5 * i))
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("span", [1, 1 << 26])
def test_interchange(spark, tmp_path, span):
    path = written(tmp_path / "x.ciff")
    assert interchange.read_part(spark, path, "header").first()["description"] == "made up"
    got = sorted(tuple(r) for r in interchange.read_part(spark, path, "postings", span).collect())
    assert got == [("apple", 9, 11, 0, 300), ("apple", 9, 11, 2, 1), ("pear", 9, 11, 1, -1), ("pear", 9, 11, 2, 7), ("plum", 9, 11, 2, 0)]
    assert sorted(tuple(r) for r in interchange.read_part(spark, path, "documents", span).collect()) == [(0, "d0", 0), (1, "d1", 5), (2, "d2", 10)]


def test_interchange_impacts(spark, tmp_path):
    index = interchange.import_index(spark, written(tmp_path / "x.ciff"))
    assert sorted((r["term"], r["impact"], r["len"]) for r in index.headers.collect()) == [("apple", 1, 1), ("apple", 255, 1), ("pear", 7, 1)]
    assert {r["term"]: r["df"] for r in index.vocab.collect()} == {"apple": 9, "pear": 9, "plum": 9}
    assert [(r["name"], r["score"]) for r in search.search(index, "apple").collect()] == [("d0", 255), ("d2", 1)]


def test_interchange_errors(spark, tmp_path):
    with pytest.raises(Exception, match="document record"):
        interchange.read_part(spark, written(tmp_path / "x.ciff", order=(0, 2, 1)), "documents").collect()
    whole = (tmp_path / "x.ciff").read_bytes()
    (tmp_path / "cut.ciff").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends early|not a message|index out of range"):
        interchange.read_part(spark, f"{tmp_path}/cut.ciff", "documents").collect()


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(0, "b a b"), (1, "a"), (2, None)], "i long, t string")
    index = indexing.build(documents.from_plain(rows, "i", "t"))
    interchange.export_index(index, f"{tmp_path}/out.ciff")
    again = interchange.import_index(spark, f"{tmp_path}/out.ciff", quantised=True)
    key = lambda i: sorted((r["term"], r["doc_id"], r["tf"], r["impact"]) for r in i.postings.collect())
    assert key(again) == key(index) and again.n_docs == 3


def test_many_postings_at_once():
    gaps, tfs = [0, 1, 127, 128, 1 << 40, 5], [255, 0, 1, 128, 7, 300]
    import numpy as np

    data, at = interchange.encode_many(np.array(gaps), np.array(tfs))
    want = [interchange._bytes(4, interchange._number(1, g) + interchange._number(2, t)) for g, t in zip(gaps, tfs, strict=True)]
    assert data.tobytes() == b"".join(want) and at.tolist() == [0, *__import__("itertools").accumulate(map(len, want))]


def test_export_by_parts(spark, tmp_path):
    """The same bytes as list by list, where ranges end inside lists and a list is longer than a range; no list comes to the driver whole."""
    texts = [" ".join(["all"] * (i % 5 + 1) + [f"w{'abcdefg'[i % 7]}"] * (i % 3) + [f"only{'abcdefghij'[i // 40]}{'klmnopqrst'[i // 4 % 10]}"]) for i in range(400)]
    index = indexing.build(documents.from_plain(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t"))
    lists = {}
    for r in sorted(index.postings.collect(), key=lambda r: (r["term"], r["doc_id"])):
        lists.setdefault(r["term"], []).append((r["doc_id"], r["tf"]))
    docs = sorted(index.docs.collect(), key=lambda r: r["doc_id"])
    total = sum(r["len"] for r in docs)
    want = interchange.framed(interchange.encode_header(len(lists), 400, total, total / 400))
    want += b"".join(interchange.framed(interchange.encode_postings(t, len(p), sum(f for _, f in p), [d for d, _ in p], [f for _, f in p])) for t, p in lists.items())
    want += b"".join(interchange.framed(interchange.encode_document(r["doc_id"], r["name"], r["len"])) for r in docs)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for parts, batch in ((1, 10), (5, 10000), (40, 7)):
        try:
            for k, v in zip(before, (parts, "false", batch), strict=True):
                spark.conf.set(k, v)
            interchange.export_index(index, f"{tmp_path}/{parts}.ciff")
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert (tmp_path / f"{parts}.ciff").read_bytes() == want
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.ciff", "40.ciff", "5.ciff"]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame([(i, f"word{'abc'[i % 3]} common text") for i in range(30)], "i long, t string")
    return indexing.build(documents.from_plain(rows, "i", "t"), keep_tokens=True)


def test_service(index, tmp_path):
    path = f"{tmp_path}/s"
    frames = [service.info_request(), service.request("worda", 3, 8), b"\x09\x03", service.request("nothing")]
    server = threading.Thread(target=service.serve, args=(index, path, len(frames)), daemon=True)
    server.start()
    import os
    import time

    while not os.path.exists(path):
        time.sleep(0.05)
    time.sleep(0.2)
    assert service.ask(path, frames[0])["n_docs"] == 30
    page = service.ask(path, frames[1])
    assert page["total"] == 10 and [r[0] for r in page["results"]] == ["24", "27"] and page["results"][0][2].startswith("<b>worda</b> common")
    with pytest.raises(ValueError):
        service.ask(path, frames[2])
    assert service.ask(path, frames[3])["results"] == []
    server.join(30)
    assert service.respond(index, service.request("worda")[:-2]) is None


def test_stream(spark, index, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, ["worda", "wordb common", "none"][i])], "qid long, query string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("qid long, query string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        service.answer_stream(index, stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    got = sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    frame = spark.createDataFrame([(0, "worda"), (1, "wordb common"), (2, "none")], "qid long, query string")
    assert got == sorted(map(tuple, search.search_batch(index, frame).collect()))


def test_import_is_read_by_many_tasks(spark, tmp_path):
    """A file of 32 MB is not one task's work."""
    rows = [(d, 1) for d in range(0, 1 << 20)]
    message = interchange.framed(interchange.encode_postings("a", 1, 1, [d for d, _ in rows], [t for _, t in rows]))
    (tmp_path / "x.ciff").write_bytes(interchange.framed(interchange.encode_header(4, 0, 0, 0.0)) + message * 4)
    assert (tmp_path / "x.ciff").stat().st_size > 1 << 24
    assert len(interchange.InterchangeSource({"path": f"{tmp_path}/x.ciff"}).reader(None).partitions()) == 4
