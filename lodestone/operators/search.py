"""Ranked disjunctive search: one plan for a batch of queries, of which a single query is the smallest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import batches
from lodestone.functions.text import query_tokens, stem
from lodestone.operators.expansion import expand
from lodestone.operators.indexing import Index
from lodestone.plans.session import stored, workspace


def parse_queries(queries: DataFrame, config: EngineConfig) -> DataFrame:
    """qid, term, cnt from qid, query: lower case, stemmed, repeated terms counted. Terms that stem to '' go."""
    raw = queries.select("qid", F.explode(query_tokens(F.col("query"))).alias("raw")).select("qid", F.lower("raw").alias("term"))
    if config.synonyms:
        raw = expand(raw)
    return raw.select("qid", stem(F.col("term"), config.stemmer).alias("term")).filter("term <> ''").groupBy("qid", "term").agg(F.count("*").cast("int").alias("cnt"))


def _named(terms: DataFrame, config: EngineConfig) -> tuple[DataFrame, list[str] | None]:
    """The terms, and their names if they are few: the tables are sorted by term, so that a scan for names reads few row groups."""
    rows = terms.limit(config.pushed_query_terms + 1).collect()
    if len(rows) > config.pushed_query_terms:
        return terms, None
    return terms.sparkSession.createDataFrame(rows, terms.schema), sorted({r["term"] for r in rows})


def _of_terms(table: DataFrame, names: list[str] | None) -> DataFrame:
    return table if names is None else table.filter(F.col("term").isin(names))


def matched(index: Index, terms: DataFrame, names: list[str] | None = None) -> DataFrame:
    """qid, term, impact, len, cnt, weight: the headers of the queries' segments, weighted by the terms' counts."""
    hit = _of_terms(index.headers, names).join(_small(terms, index.config) if names is None else F.broadcast(terms), "term")
    return hit.select("qid", "term", "impact", "len", "cnt", (F.col("impact") * F.col("cnt")).alias("weight"))


def _small(terms: DataFrame, config: EngineConfig) -> DataFrame:
    """Sent to all tasks while a count says it is small, otherwise joined as the optimiser sees fit."""
    few = terms.limit(config.broadcast_query_terms + 1).count() <= config.broadcast_query_terms
    return F.broadcast(terms) if few else terms


def prune(index: Index, found: DataFrame, exhaustive: bool = False) -> DataFrame:
    """Adds n_terms, matched before pruning, and drops segments beyond the budget.

    Whole segments are taken by weight, then the shorter, then the earlier term, until they hold a tenth of the documents;
    the one that crosses the budget is taken. Queries with one matched term are not pruned. Only headers are looked at.
    """
    by = Window.partitionBy("qid")
    counted = found.withColumn("n_terms", F.size(F.collect_set("term").over(by)))
    if exhaustive:
        return counted
    order = by.orderBy(F.desc("weight"), "len", "term").rowsBetween(Window.unboundedPreceding, -1)
    budget = max(1, int(index.config.search_proportion * index.n_docs))
    before = F.coalesce(F.sum("len").over(order), F.lit(0))
    return counted.withColumn("_before", before).filter((F.col("n_terms") == 1) | (F.col("_before") < budget)).drop("_before")


def rescale(kept: DataFrame, config: EngineConfig) -> DataFrame:
    """Adds score: what each document of a segment gets, such that no document exceeds ``accumulator_max``.

    With one matched term it is the weight as it stands; otherwise floor(1 + weight * (max - terms) / sum of the terms' best
    weights), over the terms that pruning left.
    """
    best = Window.partitionBy("qid", "term").orderBy(F.desc("weight"), "impact")
    by = Window.partitionBy("qid")
    first = kept.withColumn("_first", F.row_number().over(best) == 1)
    summed = first.withColumn("_terms", F.sum(F.col("_first").cast("int")).over(by)).withColumn("_best", F.sum(F.when(F.col("_first"), F.col("weight"))).over(by))
    limit = F.lit(config.accumulator_max)
    fits = F.assert_true((F.col("n_terms") == 1) | (F.col("_terms") < limit), F.lit(f"more than {config.accumulator_max - 1} matched terms; set accumulator_max to 65535"))
    many = F.floor(F.lit(1.0) + F.col("weight") * (limit - F.col("_terms")) / F.col("_best"))
    score = F.when(F.col("n_terms") == 1, F.col("weight")).otherwise(many).cast("int")
    return summed.withColumn("score", F.when(fits.isNull(), score)).drop("_first", "_terms", "_best")


def accumulate(index: Index, scored: DataFrame, names: list[str] | None = None) -> DataFrame:
    """qid, doc_id, score: only now the segments' ids are read. Few named terms have a row for each impact at most, so
    their segments are sent to all tasks uncounted. A row is made of each id that a query meets; large batches go by ``best``."""
    cells = scored.select("qid", "term", "impact", "score")
    cells = _small(stored(cells, "cells"), index.config) if names is None else F.broadcast(cells)
    rows = _of_terms(index.segments, names).select("term", "impact", "docs").join(cells, ["term", "impact"]).select("qid", "score", F.explode("docs").alias("doc_id"))
    return rows.groupBy("qid", "doc_id").agg(F.sum("score").cast("int").alias("score"))


def best(index: Index, scored: DataFrame, most: int) -> DataFrame:
    """qid, doc_id, score: of each query and block of ids the ``most`` best documents, with all that they score.

    Blocks are summed up in arrays, query by query, and a block's segments are sent once for all queries, or for each chunk of
    them where the cells are many or the blocks fewer than the tasks that could run.
    """
    spark, config = index.docs.sparkSession, index.config
    cells = stored(scored.select(F.col("qid").cast("long").alias("qid"), "term", "impact", "score"), "cells")
    if not (n := cells.count()):
        return spark.createDataFrame([], batches.BEST)
    blocks = index.n_docs // config.block_docs + 1
    chunks = max(1, -(-n // config.chunk_cells), min(16, spark.sparkContext.defaultParallelism // blocks))
    folder = f"{workspace(spark)}/chunks-{uuid.uuid4().hex}"
    cells.withColumn("chunk", F.pmod(F.hash("qid"), F.lit(chunks))).repartition(chunks, "chunk").write.partitionBy("chunk").parquet(folder)
    pairs = cells.select("term", "impact").distinct()
    few = pairs.limit(config.broadcast_query_terms + 1).count() <= config.broadcast_query_terms
    wanted = F.broadcast(pairs) if few else _small(cells.select("term").distinct(), config)
    found = index.segments.select("term", "impact", "block", "docs").join(wanted, ["term", "impact"] if few else "term", "left_semi")
    used = spark.read.parquet(folder).select("chunk").distinct()
    each = found.crossJoin(F.broadcast(used))
    return each.select("chunk", "block", "term", "impact", "docs").groupBy("chunk", "block").applyInArrow(batches.best_in_block(folder, most, config.block_docs), batches.BEST)


def ranked(totals: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """qid, rank (from 1), doc_id, score: by score, then doc_id, the k after ``offset``."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    top = totals.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= offset + k)
    return top.filter(F.col("rank") > offset).select("qid", "rank", "doc_id", "score")


def search_terms(index: Index, terms: DataFrame, k: int = 10, offset: int = 0, exhaustive: bool = False) -> DataFrame:
    index.config.check_k(k, offset)
    terms, names = _named(terms, index.config)
    index = index if names is None else index.narrowed(names)
    scored = rescale(prune(index, matched(index, terms, names), exhaustive), index.config)
    return ranked(best(index, scored, offset + k) if names is None else accumulate(index, scored, names), k, offset)


def search_batch(index: Index, queries: DataFrame, k: int = 10, offset: int = 0, exhaustive: bool = False) -> DataFrame:
    """The best documents of each query (qid, query): qid, rank, doc_id, score. Queries without a match have no row."""
    return search_terms(index, parse_queries(queries, index.config), k, offset, exhaustive)


def search(index: Index, query: str, k: int = 10, offset: int = 0, exhaustive: bool = False) -> DataFrame:
    """One query's best documents with their names and titles: rank, doc_id, score, name, title."""
    spark = index.docs.sparkSession
    hits = search_batch(index, spark.createDataFrame([(0, query)], "qid long, query string"), k, offset, exhaustive)
    return with_names(index, hits).drop("qid").orderBy("rank")


def with_names(index: Index, hits: DataFrame) -> DataFrame:
    """Hits with name and title; the hits of a batch are at most ``max_k`` a query."""
    return hits.join(index.docs.select("doc_id", "name", "title"), "doc_id").select("qid", "rank", "doc_id", "score", "name", "title")
