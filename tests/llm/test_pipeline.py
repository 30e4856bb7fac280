import corpus_pipeline
import pytest

from .corpora import SCHEMA, cluttered, mixed

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    cluttered(mixed(spark, 60)).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(0, 120, 2)], LABELS).write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_each_stage_works_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard", "source_mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
        if k < 3:
            assert docs.count() <= before.count() and docs.exceptAll(before).count() == 0
    tokens = docs.agg({"n_tokens": "sum"}).first()[0]
    from lodestone.llm.mixing import count_tokens
    from pyspark.sql import functions as F

    assert tokens == before.agg(F.sum(count_tokens("text"))).first()[0]
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
