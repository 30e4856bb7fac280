"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source and lists to the Python workers once an application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix="lodestone-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted([*root.rglob("*.py"), *root.rglob("*.txt")]):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def workspace(spark: SparkSession) -> str:
    """A folder for stored tables: under ``spark.checkpoint.dir``, or a temporary one for a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="workspace-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder of the workspace and read it back, which cuts its lineage."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary#held", "false").option("parquet.enable.dictionary#ends", "false").parquet(path)  # lists of postings hardly repeat
    return df.sparkSession.read.schema(df.schema).parquet(path)
