"""Readers. Each gives a corpus: doc_id, name, title, tokens (raw words in order), and the text or body that these are cut out of."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig
from lodestone.functions.entities import decode_entities
from lodestone.functions.text import BLANK, decode_markup, html_body, html_index_body, html_index_tokens, html_titles, plain_tokens, trec_body, trec_docno
from lodestone.plans.session import stored


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Dense ids from 0 in the order of these columns, by sizes of range partitions, not by one global window."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stored(placed, "numbered")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    out = placed.join(F.broadcast(before), "_part").withColumn("doc_id", (F.col("_before") + F.col("_at")).cast("long"))
    return out.drop("_part", "_at", "_before")


def from_plain(rows: DataFrame, id_column: str, text_column: str, config: EngineConfig = DEFAULT, name_column: str | None = None) -> DataFrame:
    """A corpus from a table of plain texts whose ids are dense."""
    name = F.col(name_column) if name_column else F.col(id_column)
    tokens = F.coalesce(plain_tokens(F.col(text_column), config), F.array().cast("array<string>"))
    return rows.select(F.col(id_column).cast("long").alias("doc_id"), name.cast("string").alias("name"), F.lit("").alias("title"), tokens.alias("tokens"), F.col(text_column).cast("string").alias("text"))


def from_html(rows: DataFrame, id_column: str, html_column: str, name_column: str, config: EngineConfig = DEFAULT, snippets: bool = False, markup_only: bool = False) -> DataFrame:
    """A corpus from a table of HTML. With ``snippets`` the words are kept as they read, entities decoded, beside those indexed.

    Titles have all known references decoded, with ``markup_only`` only &lt; &gt; &amp;, others staying as they are.
    """
    html = F.coalesce(F.col(html_column), F.lit(""))
    tokens, body = html_index_tokens(html, config), html_index_body(html, config)
    title = (decode_markup if markup_only else decode_entities)(html_titles(html, config))
    columns = [F.col(id_column).cast("long").alias("doc_id"), F.col(name_column).cast("string").alias("name"), F.substring(title, 1, config.max_term_length).alias("title"), tokens.alias("tokens"), body.alias("body")]
    if snippets:
        shown = F.regexp_extract_all(decode_entities(html_body(html, config)), F.lit(f"[^{BLANK}<]{{1,{config.max_term_length}}}"), F.lit(0))
        columns.append(shown.alias("shown"))
    return rows.select(*columns)


def _relative(path: str) -> Column:
    """The part of a file's URI below a folder, as it is written on disk."""
    root = path.rstrip("/").split("://")[-1].removeprefix("file:")
    whole = F.expr("url_decode(replace(path, '+', '%2B'))")
    return F.substring(whole, F.locate(root + "/", whole) + len(root) + 1, F.lit(1 << 20))


def read_html(spark: SparkSession, path: str, config: EngineConfig = DEFAULT, base64_names: bool = False, snippets: bool = False) -> DataFrame:
    """Every *.html file under a folder, or one file. Ids follow the order of names; other files are skipped.

    A name is the path below the folder (or the file as given); with ``base64_names`` it is its decoded stem.
    """
    if path.endswith(".html"):
        rows = spark.read.format("binaryFile").load(path).select(F.lit(path).alias("name"), F.col("content").cast("string").alias("html"))
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
        rows = found.select(_relative(path).alias("name"), F.col("content").cast("string").alias("html"))
    if base64_names:
        rows = rows.withColumn("name", decode_name(F.col("name")))
    return from_html(numbered(rows, "name"), "doc_id", "html", "name", config, snippets)


def skipped(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """name of every file under a folder that a reader of ``suffix`` passes over. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(_relative(path).alias("name")).filter(~F.col("name").endswith(suffix))


def decode_name(name):
    """The document name behind a file name whose stem is base64; folders are not part of it."""
    return F.unbase64(F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "\\.html$", "")).cast("string")


def read_trec(spark: SparkSession, path: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """SGML files (*.xml) of many documents each, which begin at their DOCNO; what stands before the first is dropped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    docs = files.select("file", F.posexplode(F.split("value", rf"(?=<[{BLANK}]*DOCNO)")).alias("place", "doc")).filter(F.col("doc").rlike(rf"^<[{BLANK}]*DOCNO"))
    docs = docs.select("file", "place", trec_docno(F.col("doc"), config).alias("name"), trec_body(F.col("doc"), config).alias("text"))
    return from_plain(numbered(docs, "file", "place"), "doc_id", "text", config, "name")


def read_tar(spark: SparkSession, path: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """HTML files in tar archives, compressed or not; other members are skipped."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".html"):
                            yield pd.DataFrame({"name": [m.name], "html": [tar.extractfile(m).read().decode("utf-8", "replace")]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "name string, html string")
    return from_html(numbered(rows, "name"), "doc_id", "html", "name", config)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """qid, query: a line is a number, a blank and the query; without a number it is the query and qid is 0."""
    return parse_topics(spark.read.text(path).select(F.col("value").alias("line")))


def parse_topics(lines: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(line, '^([0-9]+) ', 1) AS bigint)")
    return lines.select(F.coalesce(number, F.lit(0)).cast("long").alias("qid"), F.when(number.isNotNull(), F.regexp_replace("line", "^[0-9]+ ", "")).otherwise(F.col("line")).alias("query"))
