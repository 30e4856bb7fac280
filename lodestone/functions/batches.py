"""The best documents of many queries in a block of ids, in Python workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs

BEST = "qid long, doc_id long, score int"

_READ: dict[str, tuple] = {}


def _cells(path: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's cells, kept by the worker: its terms, and by term and impact the keys, queries and scores of the cells."""
    if path not in _READ:
        _READ.clear()
        fs, where = pafs.FileSystem.from_uri(path)
        table = ds.dataset(where, filesystem=fs, format="parquet").to_table(columns=["qid", "term", "impact", "score"])
        coded = table.column("term").combine_chunks().dictionary_encode()
        key = coded.indices.to_numpy().astype(np.int64) << 32 | table.column("impact").to_numpy()
        order = np.argsort(key, kind="stable")
        _READ[path] = coded.dictionary, key[order], table.column("qid").to_numpy()[order], table.column("score").to_numpy()[order]
    return _READ[path]


def best_in_block(folder: str, most: int, block_docs: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Of the rows of a block (chunk, block, term, impact, docs) makes each query's ``most`` best documents there."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, keys, qids, scores = _cells(f"{folder}/chunk={key[0].as_py()}")
        base = key[1].as_py() * block_docs
        code = pc.index_in(table.column("term").combine_chunks(), names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = np.where(code < 0, -1, code << 32 | table.column("impact").to_numpy())
        lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        docs = table.column("docs").combine_chunks()
        ids, at = docs.flatten().to_numpy() - base, np.concatenate([[0], np.cumsum(pc.list_value_length(docs).to_numpy())])
        n = hi - lo
        row = np.repeat(np.arange(len(n)), n)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        order = np.argsort(qids[cell], kind="stable")
        row, cell = row[order], cell[order]
        asked, starts = np.unique(qids[cell], return_index=True)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for qid, a, b in zip(asked, starts, np.append(starts, len(row))[1:], strict=True):
            rows, own = row[a:b], scores[cell[a:b]]
            hit = np.concatenate([ids[i:j] for i, j in zip(at[rows].tolist(), at[rows + 1].tolist(), strict=True)])
            total = np.bincount(hit, np.repeat(own, at[rows + 1] - at[rows]), block_docs).astype(np.int64)
            found = np.flatnonzero(total)
            if len(found) > most:
                found = found[np.argpartition(found - total[found] * block_docs, most - 1)[:most]]
            out.append((np.full(len(found), qid), found + base, total[found].astype(np.int32)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        return pa.table(columns, names=["qid", "doc_id", "score"])

    return run
