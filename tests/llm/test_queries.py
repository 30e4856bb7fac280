import math

import duckdb
import pytest

pytest.importorskip("lodestone.llm.queries")
from lodestone.llm import queries  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(clean(v) for _, v in sorted(zip([c[0] for c in found.description], r, strict=True))) for r in found.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == columns
    assert sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0
