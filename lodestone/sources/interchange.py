"""The common index file format: a stream of length-prefixed messages (header, postings lists, document records)."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.operators.indexing import Index, from_interchange

SCHEMAS = {
    "header": "version int, num_postings_lists int, num_docs int, total_postings_lists int, total_docs int, total_terms_in_collection long, average_doclength double, description string",
    "postings": "term string, df long, cf long, doc_id long, tf int",
    "documents": "doc_id long, name string, len int",
}


#: Bytes of a span, which one task reads.
SPAN_BYTES = 1 << 22
#: Rows of an Arrow batch.
BATCH_ROWS = 1 << 16
#: Bytes that are copied at a time.
COPY_BYTES = 1 << 24


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value) if value else b""


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def framed(message: bytes) -> bytes:
    return _varint(len(message)) + message


def encode_header(lists: int, docs: int, terms: int, average: float, description: str = "") -> bytes:
    numbers = b"".join(_number(i + 1, v) for i, v in enumerate((1, lists, docs, lists, docs, terms)))
    return numbers + _varint(7 << 3 | 1) + struct.pack("<d", average) + _bytes(8, description.encode())


def encode_postings(term: str, df: int, cf: int, docs: list[int], tfs: list[int]) -> bytes:
    """Ids are stored as differences from the one before."""
    rows = b"".join(_bytes(4, _number(1, d - p) + _number(2, t)) for d, p, t in zip(docs, [0, *docs], tfs, strict=False))
    return _bytes(1, term.encode()) + _number(2, df) + _number(3, cf) + rows


def encode_document(doc_id: int, name: str, length: int) -> bytes:
    return _number(1, doc_id) + _bytes(2, name.encode()) + _number(3, length)


def varints(data: bytes) -> np.ndarray:
    """All numbers of a run of varints at once, as signed 64-bit."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    if not len(b) or last[-1] != len(b) - 1:
        if len(b):
            raise ValueError("a number is cut off")
        return np.zeros(0, np.int64)
    start = np.concatenate([[0], last[:-1] + 1])
    width = last - start + 1
    out = np.zeros(len(last), np.uint64)
    for j in range(int(width.max())):
        more = width > j
        out[more] |= (b[start[more] + j] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * j)
    return out.view(np.int64)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes, int]]:
    """Field number, value (bytes of whatever isn't a varint) and the offset behind it."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value - (1 << 64) if value >> 63 else value
            shift += 7

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            value: int | bytes = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or (number() if kind == 2 else -1)
            if size < 0 or at + size > len(message):
                raise ValueError("not a message of this format")
            value = message[at : at + size]
            at += size
        yield key >> 3, value, at


def decode_header(message: bytes) -> dict:
    names = [c.split()[0] for c in SCHEMAS["header"].split(", ")]
    out: dict = dict.fromkeys(names[:6], 0) | {"average_doclength": 0.0, "description": ""}
    for field, value, _ in fields(message):
        if 1 <= field <= 8:
            out[names[field - 1]] = struct.unpack("<d", value)[0] if field == 7 else value.decode("utf-8", "replace") if field == 8 else value
    return out


def decode_postings(message: bytes) -> tuple[str, int, int, np.ndarray, np.ndarray]:
    """term, df, cf, ids (differences summed), frequencies. All postings that give both numbers are read at once."""
    term, df, cf = "", 0, 0
    gaps: list[np.ndarray] = []
    tfs: list[np.ndarray] = []
    at = 0
    while at < len(message):
        for field, value, behind in fields(message[at:]):
            if field == 1:
                term = value.decode("utf-8", "replace")
            elif field == 2:
                df = value
            elif field == 3:
                cf = value
            elif field == 4:
                own = {f: v for f, v, _ in fields(value)}
                gaps.append(np.array([own.get(1, 0)], np.int64))
                tfs.append(np.array([own.get(2, 0)], np.int64))
                at += behind
                break
        else:
            break
        flat = varints(message[at:])
        whole = flat.reshape(-1, 6) if len(flat) % 6 == 0 else None
        if whole is not None and len(whole) and ((whole[:, 0] == 34) & (whole[:, 2] == 8) & (whole[:, 4] == 16)).all():
            gaps.append(whole[:, 3])
            tfs.append(whole[:, 5])
            break
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return term, df, cf, np.cumsum(join(gaps)), join(tfs)


def _open(path: str) -> io.BufferedReader:
    fs, where = pafs.FileSystem.from_uri(path)
    return io.BufferedReader(fs.open_input_file(where), 1 << 16)


def _length(f: io.BufferedReader) -> int:
    value = shift = 0
    while True:
        b = f.read(1)
        if not b:
            raise ValueError("the file ends early")
        value |= (b[0] & 127) << shift
        if b[0] < 128:
            return value
        shift += 7


class Span(InputPartition):
    """``count`` messages from byte ``start``, the first of which is number ``first``."""

    def __init__(self, start: int, count: int, first: int):
        self.start, self.count, self.first = start, count, first


class InterchangeReader(DataSourceReader):
    """Reads one kind of message. Planning walks over the length prefixes alone and cuts the file where a span is full."""

    def __init__(self, path: str, part: str, span_bytes: int):
        self.path, self.part, self.span_bytes = path, part, span_bytes

    def partitions(self) -> list[Span]:
        with _open(self.path) as f:
            header = decode_header(f.read(_length(f)))
            if self.part == "header":
                return [Span(0, 1, 0)]
            lists, docs = header["num_postings_lists"], header["num_docs"]
            if lists < 0 or docs < 0:
                raise ValueError("not a message of this format")
            spans: list[Span] = []
            begin, held, first = f.tell(), 0, 0
            for i in range(lists + docs if self.part == "documents" else lists):
                skipped = self.part == "documents" and i < lists
                size = _length(f)
                f.seek(size, io.SEEK_CUR)
                if skipped:
                    begin = f.tell()
                    continue
                held += 1
                if f.tell() - begin >= self.span_bytes:
                    spans.append(Span(begin, held, first))
                    begin, first, held = f.tell(), first + held, 0
            if held:
                spans.append(Span(begin, held, first))
        return spans or [Span(0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        """Batches of many messages; a list longer than a batch is one of its own."""
        held: list = []
        rows = 0
        with _open(self.path) as f:
            f.seek(partition.start)
            for i in range(partition.count):
                message = f.read(_length(f))
                if self.part == "header":
                    held.append(decode_header(message))
                elif self.part == "postings":
                    held.append(decode_postings(message))
                    rows += len(held[-1][3])
                else:
                    own = {k: v for k, v, _ in fields(message)}
                    if own.get(1, 0) != partition.first + i:
                        raise ValueError(f"document record {partition.first + i} has id {own.get(1, 0)}")
                    held.append((own.get(1, 0), own.get(2, b"").decode("utf-8", "replace"), own.get(3, 0)))
                    rows += 1
                if rows >= BATCH_ROWS:
                    yield self._batch(held)
                    held, rows = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, held: list) -> pa.RecordBatch:
        if self.part == "header":
            names = [c.split() for c in SCHEMAS["header"].split(", ")]
            kind = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], kind[t]) for n, t in names], names=[n for n, _ in names])
        if self.part == "documents":
            ids, names, lengths = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(lengths, pa.int32())], names=["doc_id", "name", "len"])
        terms, dfs, cfs, ids, tfs = zip(*held, strict=True)
        of = np.repeat(np.arange(len(held)), [len(x) for x in ids])
        small = np.clip(np.concatenate(tfs), -(1 << 31), (1 << 31) - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()).take(pa.array(of)), *(pa.array(np.array(x, np.int64)[of]) for x in (dfs, cfs)), pa.array(np.concatenate(ids)), pa.array(small)], names=["term", "df", "cf", "doc_id", "tf"])


class InterchangeSource(DataSource):
    """``spark.read.format("interchange").option("part", "header" | "postings" | "documents").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "interchange"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "postings")]

    def reader(self, schema) -> InterchangeReader:
        return InterchangeReader(self.options["path"], self.options.get("part", "postings"), int(self.options.get("spanbytes", SPAN_BYTES)))


def read_part(spark: SparkSession, path: str, part: str, span_bytes: int = SPAN_BYTES) -> DataFrame:
    spark.dataSource.register(InterchangeSource)
    return spark.read.format("interchange").option("part", part).option("spanbytes", str(span_bytes)).load(path)


def import_index(spark: SparkSession, path: str, quantised: bool = False) -> Index:
    """The index in a file: frequencies are impacts as they stand, unless they are to be scored and quantised."""
    return from_interchange(read_part(spark, path, "postings"), read_part(spark, path, "documents"), quantised)


def _varint_columns(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as rows of bytes, and how many of each row count."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for j in range(1, 10):
        width += values >= np.uint64(1) << np.uint64(7 * j)
    most = int(width.max(initial=1))
    out = np.empty((len(values), most), np.uint8)
    for j in range(most):
        out[:, j] = (values >> np.uint64(7 * j)).astype(np.uint8) & 127 | (width > j + 1).astype(np.uint8) << 7
    return out, width


def encode_many(gaps: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all these postings, and where each begins. Numbers are 0 or more; a 0 is left out."""
    (gap, gap_n), (tf, tf_n) = _varint_columns(gaps), _varint_columns(tfs)
    gap_n, tf_n = np.where(gaps > 0, gap_n, -1), np.where(tfs > 0, tf_n, -1)
    size = gap_n + tf_n + 2  # 22 bytes at most, so that a size is one byte
    key = lambda x: np.full((len(gaps), 1), x, np.uint8)
    cells = np.hstack([key(4 << 3 | 2), size.astype(np.uint8)[:, None], key(1 << 3), gap, key(2 << 3), tf])
    used = lambda n, most: np.arange(-1, most) < n[:, None]
    keep = np.hstack([np.ones((len(gaps), 2), bool), used(gap_n, gap.shape[1]), used(tf_n, tf.shape[1])])
    return cells[keep], np.concatenate([[0], np.cumsum(size + 2)])


PIECES = "part int, file string, whole long, heads array<struct<term: string, doc: long, tf: long, last: long, n: long, cf: long, start: long, bytes: long>>"


def _list_writer(folder: str):
    """Writes lists of rows of term, doc_id, tf in this order. One row for each part: the lists that may go on in other parts, by
    where they are in the file, and the bytes of those in between, which are framed.

    The first and the last list of a part may be pieces. A piece's first posting is not in the file, as its gap isn't known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, where = pafs.FileSystem.from_uri(folder)
        file = f"{part}-{uuid.uuid4().hex}"
        place = 0
        first: dict | None = None  # the first list, whose bytes are at the file's begin
        now: dict | None = None  # the list that is being read
        body: list[bytes] = []
        with fs.open_output_stream(f"{where}/{file}") as out:

            def put(pieces: list[bytes]) -> int:
                nonlocal place
                n = 0
                for x in pieces:
                    out.write(x)
                    n += len(x)
                place += n
                return n

            def close() -> None:
                """The list is over: the first one is written as a piece, the others whole, once it is known that more follow."""
                nonlocal first, now, body
                if first is None:
                    first = now | {"start": place, "bytes": put(body)}
                else:
                    head = _bytes(1, now["term"].encode()) + _number(2, now["n"]) + _number(3, now["cf"])
                    posting = _bytes(4, _number(1, now["doc"]) + _number(2, now["tf"]))
                    rest = b"".join(body)
                    put([_varint(len(head) + len(posting) + len(rest)), head, posting, rest])
                now, body = None, []

            for batch in batches:
                if not batch.num_rows:
                    continue
                terms, docs, tfs = batch.column("term"), batch.column("doc_id").to_numpy(), batch.column("tf").to_numpy().astype(np.int64)
                new = np.ones(len(docs), bool)
                new[1:] = pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(new)
                names = terms.take(pa.array(starts)).to_pylist()
                goes_on = now is not None and names[0] == now["term"]
                gaps = np.diff(docs, prepend=now["last"] if goes_on else 0)
                gaps[starts[1:] if goes_on else starts] = 0  # the first postings of lists, written elsewhere
                data, at = encode_many(gaps, tfs)
                data, ends = data.tobytes(), np.append(starts[1:], len(docs))
                sums = np.add.reduceat(tfs, starts)
                lows, cuts, highs = docs[starts].tolist(), at[starts + 1].tolist(), at[ends].tolist()
                begins, lasts, counts, cfs, tf0 = at[starts].tolist(), docs[ends - 1].tolist(), (ends - starts).tolist(), sums.tolist(), tfs[starts].tolist()
                for i, term in enumerate(names):
                    if i == 0 and goes_on:
                        body.append(data[begins[0] : highs[0]])
                        now["last"], now["n"], now["cf"] = lasts[0], now["n"] + counts[0], now["cf"] + cfs[0]
                        continue
                    if now is not None:
                        close()
                    now = {"term": term, "doc": lows[i], "tf": tf0[i], "last": lasts[i], "n": counts[i], "cf": cfs[i]}
                    body = [data[cuts[i] : highs[i]]]
            heads = []
            if now is not None:
                size = place
                ending = now | {"start": place, "bytes": put(body)}
                heads = [ending] if first is None else [first, ending]
                whole_bytes = 0 if first is None else size - first["bytes"]
        if heads:
            yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "whole": whole_bytes, "heads": heads}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("whole", pa.int64()), ("heads", pa.list_(pa.struct([("term", pa.string()), *((c, pa.int64()) for c in ("doc", "tf", "last", "n", "cf", "start", "bytes"))])))]))

    return run


def _record_writer(folder: str):
    """Writes records of rows of doc_id, name, len as they come, a file for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, where = pafs.FileSystem.from_uri(folder)
        file = f"{part}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{where}/{file}") as out:
            for batch in batches:
                out.write(b"".join(framed(encode_document(*row)) for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "name", "len")), strict=True)))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [file]})

    return run


def export_index(index: Index, path: str) -> None:
    """Write an index's frequencies as one file, which the format wants, lists in order of terms.

    Executors encode ranges of postings into files of a folder beside it; the driver joins their bytes, and closes the lists
    that go over the end of a range. Of postings it sees the first of each range.
    """
    spark = index.docs.sparkSession
    fs, where = pafs.FileSystem.from_uri(path)
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    fs.create_dir(inner := f"{where}{folder[len(path) :]}")
    n_terms, total = index.vocab.count(), index.docs.agg(F.sum("len")).first()[0] or 0
    placed = index.postings.select("term", "doc_id", "tf").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    parts = sorted(placed.mapInArrow(_list_writer(folder), PIECES).collect(), key=lambda r: r["part"])
    records = index.docs.select("doc_id", "name", "len").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = sorted(records.mapInArrow(_record_writer(folder), "part int, file string").collect(), key=lambda r: r["part"])

    with fs.open_output_stream(where) as out:

        def copy(file: str, start: int, size: int) -> None:
            with fs.open_input_file(f"{inner}/{file}") as f:
                f.seek(start)
                while size > 0:
                    data = f.read(min(size, COPY_BYTES))
                    if not data:
                        raise ValueError("a part is shorter than it was written")
                    out.write(data)
                    size -= len(data)

        pieces: list[tuple] = []  # of the list that isn't closed: file, piece, its first posting

        def close() -> None:
            if pieces:
                head = _bytes(1, pieces[0][1]["term"].encode()) + _number(2, sum(h["n"] for _, h, _ in pieces)) + _number(3, sum(h["cf"] for _, h, _ in pieces))
                out.write(_varint(len(head) + sum(len(p) + h["bytes"] for _, h, p in pieces)) + head)
                for file, h, posting in pieces:
                    out.write(posting)
                    copy(file, h["start"], h["bytes"])
                pieces.clear()

        out.write(framed(encode_header(n_terms, index.n_docs, total, total / index.n_docs if index.n_docs else 0.0)))
        for r in parts:
            for i, h in enumerate(r["heads"]):
                if pieces and pieces[-1][1]["term"] != h["term"]:
                    close()
                if i:
                    copy(r["file"], r["heads"][0]["bytes"], r["whole"])
                before = pieces[-1][1]["last"] if pieces else 0
                pieces.append((r["file"], h, _bytes(4, _number(1, h["doc"] - before) + _number(2, h["tf"]))))
        close()
        for r in files:
            with fs.open_input_file(f"{inner}/{r['file']}") as f:
                size = f.size()
            copy(r["file"], 0, size)
    fs.delete_dir(inner)
