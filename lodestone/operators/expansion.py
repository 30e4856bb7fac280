"""Query expansion by groups of synonyms, off unless the configuration says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = (("lentil", "lentil dal dahl dhal daal"), ("chickpea", "chickpea garbanzo chana chole"), ("spinach", "spinach saag palak"))


def synonyms(spark) -> DataFrame:
    return spark.createDataFrame([(g, t) for g, terms in GROUPS for t in terms.split()], "grp string, member string")


def expand(terms: DataFrame) -> DataFrame:
    """All rows of qid, term, and for each group that one of a query's terms is in, the members that the query lacks."""
    table = synonyms(terms.sparkSession)
    groups = terms.join(F.broadcast(table), F.col("term") == F.col("member")).select("qid", "grp").distinct()
    members = groups.join(F.broadcast(table), "grp").select("qid", F.col("member").alias("term"))
    missing = members.join(terms.select("qid", "term").distinct(), ["qid", "term"], "left_anti")
    return terms.select("qid", "term").unionByName(missing)
