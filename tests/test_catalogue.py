import math

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def clean(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, con, name):
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(clean(v) for _, v in sorted(zip(names, r, strict=True), key=lambda x: x[0])) for r in found.fetchall()), key=repr)
    df = catalogue.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(clean(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["html_title", "stats_docids"])
def test_titles_with_other_references(spark, tmp_path, name):
    titles = ["a &quot;b&quot;", "&amp;lt; &lt;i&gt; &amp;amp;", "&nbsp;&#65;&eacute;", "&quot;" * 30, "", None]
    rows = [(i, f"http://x/{i}", t and f"<title>{t}</title>word") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(catalogue.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())
