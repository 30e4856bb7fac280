"""Results as text: run files for evaluation, and lists for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.indexing import Index
from lodestone.operators.search import with_names


def run_lines(index: Index, hits: DataFrame, tag: str = "lodestone") -> DataFrame:
    """line: qid, Q0, the document's name, rank, score and tag."""
    return with_names(index, hits).select(F.format_string("%d Q0 %s %d %d %s", "qid", "name", "rank", "score", F.lit(tag)).alias("line"))


def write_run(index: Index, hits: DataFrame, path: str, tag: str = "lodestone") -> None:
    with_names(index, hits).orderBy("qid", "rank").select(F.format_string("%d Q0 %s %d %d %s", "qid", "name", "rank", "score", F.lit(tag))).write.text(path)


def listing(index: Index, hits: DataFrame, snippets: DataFrame) -> DataFrame:
    """qid, rank, text: score and name, then the title and the snippet if there are any, a line each."""
    rows = with_names(index, hits).join(snippets, ["qid", "doc_id"])
    head = F.concat_ws(" ", F.col("score").cast("string"), "name")
    return rows.select("qid", "rank", F.concat_ws("\n", head, F.when(F.col("title") != "", F.col("title")), F.when(F.col("snippet") != "", F.col("snippet"))).alias("text"))
