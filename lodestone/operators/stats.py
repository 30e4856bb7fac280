"""What an index holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.indexing import Index


def summary(index: Index) -> DataFrame:
    """metric, value: documents, terms, postings, segments, the longest document."""
    docs = index.docs.agg(F.count("*").alias("documents"), F.coalesce(F.max("len"), F.lit(0)).alias("longest_document"))
    terms = index.vocab.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    segments = index.headers.agg(F.count("*").alias("segments"))
    one = docs.crossJoin(F.broadcast(terms)).crossJoin(F.broadcast(segments))
    names = ("documents", "longest_document", "terms", "postings", "segments")
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names))).alias("x")).select("x.metric", "x.value")


def names(index: Index) -> DataFrame:
    """doc_id, name, title in order of documents."""
    return index.docs.select("doc_id", "name", "title").orderBy("doc_id")


def terms(index: Index) -> DataFrame:
    return index.vocab.select("term", "df")


def segment_histogram(index: Index) -> DataFrame:
    """impact, most: over all terms the length of the longest segment of each impact."""
    return index.headers.groupBy("impact").agg(F.max("len").alias("most"))


def sizes(index: Index, path: str) -> dict[str, int]:
    """Bytes of each table of a saved index."""
    spark = index.docs.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(where)}
