"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """All tunables. The defaults give 8-bit impacts, scores up to 255 and a budget of a tenth of the documents a query.

    ``accumulator_max`` bounds a document's score (255 or 65535). ``block_docs`` bounds the doc ids of one stored array.
    ``broadcast_query_terms`` is the number of query terms up to which a batch is sent to all tasks, ``pushed_query_terms`` up
    to which their names are pushed down to the scans. ``chunk_cells`` bounds the cells (query, term, impact) of a batch that
    a worker holds at once.
    """

    search_proportion: float = 0.1
    accumulator_max: int = 255
    tf_max: int = 255
    quantise_bits: int = 8
    bm25_k1: float = 0.9
    bm25_b: float = 0.4
    max_k: int = 1000
    max_query_terms: int = 6000
    max_term_length: int = 100
    snippet_window: int = 100
    stemmer: str = "none"
    case_insensitive_html: bool = False
    docno_pattern: str = "[A-Za-z0-9-]{0,100}"
    synonyms: bool = False
    block_docs: int = 1 << 16
    broadcast_query_terms: int = 100_000
    pushed_query_terms: int = 256
    chunk_cells: int = 1 << 21

    def __post_init__(self) -> None:
        if self.stemmer not in ("none", "s"):
            raise ValueError(f"no such stemmer: {self.stemmer}")
        if self.accumulator_max not in (255, 65535):
            raise ValueError("accumulator_max is 255 or 65535")
        if not 1 <= self.quantise_bits <= 16:
            raise ValueError("quantise_bits is between 1 and 16")

    def check_k(self, k: int, offset: int = 0) -> None:
        if k < 1 or offset < 0 or k + offset > self.max_k:
            raise ValueError(f"results must lie between 1 and {self.max_k}")


DEFAULT = EngineConfig()
