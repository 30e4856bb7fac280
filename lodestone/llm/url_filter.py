"""URL filter: a sorted array of 64-bit digests, probed by binary search and confirmed against the stored strings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import U, read_arrays, shared_dir, write_arrays


def listed(text: str) -> tuple[str, ...]:
    """The entries of a list file: one a line, without empty lines and those that begin with #."""
    return tuple(e for e in map(str.strip, text.splitlines()) if e and not e.startswith("#"))


#: Hosts, which stand for their subdomains too, and host/path prefixes.
BLOCKLIST = listed(resources.files("lodestone.llm").joinpath("blocklist.txt").read_text("utf-8"))


@dataclass(frozen=True)
class UrlParams:
    """A table's entries are sorted in shards of about ``shard_entries``, each a range of digests and a file that workers map."""

    shard_entries: int = 1 << 22


_ADDRESS = re.compile(r"[0-9.]+")


def normal(entry: str) -> str:
    """A list entry or URL as host/path: lower-case host, no scheme, user, port, query, fragment, or slash at the end."""
    text = entry.strip()
    try:
        parts = urlsplit(text if "://" in text else "//" + text)
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return ""
    return (host + parts.path).rstrip("/") if host else ""


def probes(url: str | None) -> list[str]:
    """What can block a URL, most specific first: its path and the path's prefixes, its host and the host's parents."""
    full = normal(url) if url and "://" in url else ""
    if not full:
        return []
    host, _, path = full.partition("/")
    parts = path.split("/") if path else []
    labels = host.split(".")
    hosts = [host] if ":" in host or _ADDRESS.fullmatch(host) else [".".join(labels[i:]) for i in range(len(labels))]
    return ["/".join([host, *parts[:i]]) for i in range(len(parts), 0, -1)] + hosts


class DigestArray:
    """Sorted digests and, in their order, the entries' bytes and offsets."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.digests, self.offsets, self.data = arrays["digests"], arrays["offsets"], arrays["data"]

    @staticmethod
    def arrays(entries: list[str]) -> dict[str, np.ndarray]:
        own = sorted({(xxhash.xxh64_intdigest(e), e) for e in map(normal, entries) if e})
        data = [e.encode() for _, e in own]
        return {"digests": np.array([d for d, _ in own], dtype=np.uint64), "offsets": np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]).astype(np.int64), "data": np.frombuffer(b"".join(data) or b"\0", dtype=np.uint8)}

    def holds(self, keys: list[str], digests: np.ndarray | None = None) -> np.ndarray:
        """Which keys are entries: one binary search for all, then a comparison of strings wherever digests meet."""
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64) if digests is None else digests
        at = np.searchsorted(self.digests, digests)
        out = np.zeros(len(keys), bool)
        near = np.flatnonzero(at < len(self.digests))
        for i in near[self.digests[at[near]] == digests[near]]:
            j, key = int(at[i]), keys[i].encode()
            while j < len(self.digests) and self.digests[j] == digests[i] and not out[i]:
                out[i] = self.data[self.offsets[j] : self.offsets[j + 1]].tobytes() == key
                j += 1
        return out


_MAPPED: dict[tuple[str, int], DigestArray] = {}


def _shard(folder: str, k: int) -> DigestArray:
    if (folder, k) not in _MAPPED:
        if any(f != folder for f, _ in _MAPPED):
            _MAPPED.clear()
        _MAPPED[folder, k] = DigestArray(read_arrays(folder, f"shard-{k}"))
    return _MAPPED[folder, k]


def _of(digests: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each digest: equal ranges of the top 32 bits."""
    return ((digests >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _write(entries: DataFrame | tuple[str, ...], folder: str, params: UrlParams, spark: SparkSession) -> int:
    """Write the sorted shards and return how many; a table's are sorted and written by executors."""
    if not isinstance(entries, DataFrame):
        write_arrays(folder, "shard-0", DigestArray.arrays([e for e in entries if e]))
        return 1
    listed = entries.select(F.col(f"`{entries.columns[0]}`").cast("string").alias("entry")).filter("entry is not null")
    shards = max(1, -(-listed.count() // params.shard_entries))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [x for x in map(normal, batch.column("entry").to_pylist()) if x]
            digests = np.array([xxhash.xxh64_intdigest(x) for x in known], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_of(digests, shards).astype(np.int32)), pa.array(known, pa.string())], names=["shard", "entry"])

    def write(table: pa.Table) -> pa.Table:
        k = table["shard"][0].as_py()
        write_arrays(folder, f"shard-{k}", DigestArray.arrays(table["entry"].to_pylist()))
        return pa.table({"shard": pa.array([k], pa.int32())})

    full = {r[0] for r in listed.mapInArrow(clean, "shard int, entry string").distinct().repartition(shards, "shard").groupBy("shard").applyInArrow(write, "shard int").collect()}
    for k in set(range(shards)) - full:
        write_arrays(folder, f"shard-{k}", DigestArray.arrays([]))
    return shards


def filter_urls(pages: DataFrame, entries: DataFrame | tuple[str, ...] = BLOCKLIST, params: UrlParams = UrlParams()) -> DataFrame:
    """One row for each input row: page_id, url, blocked, entry (the most specific one that blocks it, else null).

    An entry without a path blocks a host and its subdomains (an address only itself), one with a path that path and all below
    it, by whole segments. Null, empty and unparsable URLs, and those without a scheme, are not blocked. Null and empty entries
    are ignored, repeated ones count once. Repeated rows give repeated results; other columns are ignored; an empty table gives
    no rows.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    folder = shared_dir(spark)
    shards = _write(entries, folder, params, spark)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, row = [], []
            for i, url in enumerate(batch.column("url").to_pylist()):
                own = probes(url)
                keys += own
                row += [i] * len(own)
            digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
            of, hit = _of(digests, shards), np.zeros(len(keys), bool)
            for k in np.unique(of):
                at = np.flatnonzero(of == k)
                hit[at] = _shard(folder, int(k)).holds([keys[i] for i in at], digests[at])
            found: list[str | None] = [None] * batch.num_rows
            for k in np.flatnonzero(hit)[::-1]:
                found[row[k]] = keys[k]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([x is not None for x in found], pa.bool_()), pa.array(found, pa.string())], names=["page_id", "url", "blocked", "entry"])

    return source.mapInArrow(probe, "page_id long, url string, blocked boolean, entry string")
