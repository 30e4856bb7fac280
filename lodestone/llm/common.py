"""Byte-level helpers shared by the operators: vectorised tokenising and hashing over Arrow batches, and the shared folder."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
U = np.uint64

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor can reach: under ``spark.checkpoint.dir``, or a temporary one for a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)  # a path without scheme is the default file system's
    return f"{whole.toString().rstrip('/')}/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python ``rows`` at a time at most: a batch of the default size holds many MB, both in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Give back to the system what a finished task of a Python worker held, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """All columns as one, ``row``, so that columns that operators add clash with none of them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in like.columns))


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect what nothing refers to, so that shuffle files behind written tables go before more are made.

    What Python lets go of reaches the JVM with the call after, so it takes two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def local_path(path: str) -> str | None:
    """The plain path of a qualified folder that is mounted, None for a remote file system."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays as one file of the shared folder. A task that runs again writes the same file again."""
    head, at, parts = {}, 0, []
    for key, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[key] = (a.dtype.str, len(a), at)
        parts.append(a.tobytes() + bytes(-a.nbytes % 64))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    place = local_path(folder)
    fs, base = (pafs.LocalFileSystem(), place) if place else pafs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    own = f"{base}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        for x in (len(text).to_bytes(8, "little"), text, *parts):
            f.write(x)
    fs.move(own, f"{base}/{name}")


def read_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """What ``write_arrays`` wrote: memory-mapped where the folder is mounted, else read. A missing file raises."""
    place = local_path(folder)
    if place:
        data = np.memmap(f"{place}/{name}", np.uint8, "r")
    else:
        fs, base = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{base}/{name}") as f:
            data = np.frombuffer(f.read(), np.uint8)
    n = 8 + int.from_bytes(data[:8].tobytes(), "little")
    return {k: data[n + at : n + at + m * np.dtype(kind).itemsize].view(kind) for k, (kind, m, at) in json.loads(data[8:n].tobytes()).items()}


class SharedArrays:
    """Named numpy arrays for all executors, as a file of the shared folder that each worker maps or reads once."""

    _read: dict[str, dict[str, np.ndarray]] = {}

    def __init__(self, spark: SparkSession, arrays: dict[str, np.ndarray]):
        self._dir = shared_dir(spark)
        write_arrays(self._dir, "arrays", arrays)

    def load(self) -> dict[str, np.ndarray]:
        if self._dir not in self._read:
            self._read.clear()
            self._read[self._dir] = read_arrays(self._dir, "arrays")
        return self._read[self._dir]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def lower_bytes(b: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters of UTF-8 text, keeping every byte offset."""
    out = _LOWER[b]
    if len(b) > 1:
        up = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        out[1:][up] += 32
    return out


def text_array(column) -> pa.Array:
    """A batch's text column as an Arrow string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("")


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets.

    A row longer than ``limit`` is a run of its own; no text is ever cut.
    """
    a = text_array(column)
    n = len(a)
    if n == 0:
        return
    wide = pa.types.is_large_string(a.type)
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64 if wide else np.int32)[a.offset : a.offset + n + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    base = U(0x9E3779B97F4A7C15)
    up = down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            inverse = U(pow(int(cls.base), -1, 1 << 64))
            cls.up, cls.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (cls.base, inverse))
        return cls.up[:n], cls.down[:n]


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, for each row, the index of its first word (one more entry than rows).

    A word is a run of ASCII letters, digits and non-ASCII bytes inside one row.
    """
    w = _WORD[b]
    first = w.copy()
    if len(b):
        inner = offsets[1:-1][offsets[1:-1] < len(b)]
        first[1:] &= ~w[:-1]
        first[inner] = w[inner]
        last = w.copy()
        last[:-1] &= ~w[1:]
        before = offsets[1:-1]
        before = before[before > 0] - 1
        last[before] = w[before]
    else:
        last = first
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (polynomial modulo 2**64, then mixed)."""
    up, down = _Powers.get(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + U(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word grams of each row and the rows' offsets into them; a row of fewer words has one gram of all of them."""
    count = np.diff(word_offsets)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(grams)])
    row = np.repeat(np.arange(len(count)), grams)
    at = word_offsets[:-1][row] + np.arange(offsets[-1]) - offsets[:-1][row]
    out = np.zeros(len(at), dtype=np.uint64)
    left = word_offsets[1:][row] - at
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    for j in range(n):
        out = out * U(0x9FB21C651E98DF25) + np.where(left > j, padded[at + j], U(j + 1))
    return mix(out), offsets


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets, 0 for empty rows."""
    run = np.cumsum(values)
    total = np.zeros(len(run) + 1, dtype=run.dtype)
    total[1:] = run
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted without repeats, and the new offsets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(values)
    order = order[np.argsort(row[order], kind="stable")]
    v, r = values[order], row[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(offsets)))
