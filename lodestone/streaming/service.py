"""Search as a service: streams of queries, and a request and response protocol over a local socket."""

from __future__ import annotations

import os
import socket
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.indexing import Index
from lodestone.operators.search import accumulate, matched, parse_queries, prune, ranked, rescale, search_batch, with_names
from lodestone.operators.snippets import snippets

VERSION, INFO, SEARCH = 1, 2, 3
_HEAD, _SEARCH, _COUNTS = struct.Struct("=BB"), struct.Struct("=HHH"), struct.Struct("=HH")


def answer_stream(index: Index, queries: DataFrame, path: str, progress: str, k: int = 10, exhaustive: bool = False) -> StreamingQuery:
    """Answer a stream of qid, query and append qid, rank, doc_id, score as Parquet under ``path``, a folder a batch.

    Ranking needs all postings of a query, so each micro-batch is a batch search; a batch that is run again replaces its own
    folder, and so nothing is answered twice.
    """

    def answer(batch: DataFrame, number: int) -> None:
        search_batch(index, batch, k, 0, exhaustive).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", progress).trigger(availableNow=True).start()


def request(query: str, k: int = 5, offset: int = 0) -> bytes:
    data = query.encode()
    return _HEAD.pack(VERSION, SEARCH) + _SEARCH.pack(k, offset, len(data)) + data


def info_request() -> bytes:
    return _HEAD.pack(VERSION, INFO)


def _text(value: str) -> bytes:
    data = value.encode()[:65535]
    return struct.pack("=H", len(data)) + data


def respond(index: Index, frame: bytes, exhaustive: bool = False) -> bytes | None:
    """The answer to one request: the number of documents, or a page of results with the number of all matches (65535 at
    most), each with its name, title and snippet. Frames of another version or method, or cut short, have no answer."""
    if len(frame) < _HEAD.size:
        return None
    version, method = _HEAD.unpack_from(frame)
    if version != VERSION or method not in (INFO, SEARCH):
        return None
    if method == INFO:
        return _HEAD.pack(VERSION, INFO) + struct.pack("=I", index.n_docs)
    if len(frame) < _HEAD.size + _SEARCH.size:
        return None
    k, offset, size = _SEARCH.unpack_from(frame, _HEAD.size)
    body = frame[_HEAD.size + _SEARCH.size :]
    if len(body) < size:
        return None
    index.config.check_k(k, offset)
    terms = parse_queries(index.docs.sparkSession.createDataFrame([(0, body[:size].decode("utf-8", "replace"))], "qid long, query string"), index.config)
    totals = accumulate(index, rescale(prune(index, matched(index, terms), exhaustive), index.config)).persist()
    hits = ranked(totals, k, offset)
    rows = with_names(index, hits).join(snippets(index, hits, terms), ["qid", "doc_id"], "left").orderBy("rank").select("name", "title", F.coalesce("snippet", F.lit("")).alias("snippet")).collect()
    total = totals.count()
    totals.unpersist()
    return _HEAD.pack(VERSION, SEARCH) + _COUNTS.pack(min(total, 65535), len(rows)) + b"".join(_text(r["name"]) + _text(r["title"]) + _text(r["snippet"]) for r in rows)


def read_response(frame: bytes) -> dict:
    """An answer as method, and n_docs, or total and results (name, title, snippet)."""
    version, method = _HEAD.unpack_from(frame)
    if version != VERSION:
        raise ValueError(f"protocol version {version}")
    if method == INFO:
        return {"method": method, "n_docs": struct.unpack_from("=I", frame, 2)[0]}
    total, count = _COUNTS.unpack_from(frame, 2)
    at, results = 2 + _COUNTS.size, []
    for _ in range(count):
        row = []
        for _ in range(3):
            (n,) = struct.unpack_from("=H", frame, at)
            row.append(frame[at + 2 : at + 2 + n].decode("utf-8", "replace"))
            at += 2 + n
        results.append(tuple(row))
    return {"method": method, "total": total, "results": results}


def _receive(conn: socket.socket) -> bytes:
    """A whole request, as far as its own lengths say."""
    data = b""
    while True:
        want = _HEAD.size
        if len(data) >= _HEAD.size and data[0] == VERSION and data[1] == SEARCH:
            want += _SEARCH.size
            if len(data) >= want:
                want += _SEARCH.unpack_from(data, _HEAD.size)[2]
        if len(data) >= want:
            return data
        more = conn.recv(65536)
        if not more:
            return data
        data += more


def serve(index: Index, path: str, requests: int | None = None, timeout: float = 30.0) -> None:
    """Answer one request a connection at a Unix socket, for ever or for so many. A bad request, or a client that is silent
    for ``timeout`` seconds, ends its connection alone."""
    if os.path.exists(path):
        os.unlink(path)
    with socket.socket(socket.AF_UNIX) as listener:
        listener.bind(path)
        listener.listen()
        while requests is None or requests > 0:
            conn, _ = listener.accept()
            conn.settimeout(timeout)
            with conn:
                try:
                    if out := respond(index, _receive(conn)):
                        conn.sendall(out)
                except (OSError, ValueError, struct.error):
                    pass
            requests = None if requests is None else requests - 1


def ask(path: str, frame: bytes) -> dict:
    """The client: send a request to a socket and read the answer."""
    with socket.socket(socket.AF_UNIX) as conn:
        conn.connect(path)
        conn.sendall(frame)
        conn.shutdown(socket.SHUT_WR)
        data = b""
        while more := conn.recv(65536):
            data += more
    if not data:
        raise ValueError("the service gave no answer")
    return read_response(data)
