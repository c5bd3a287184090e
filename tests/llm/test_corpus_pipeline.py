"""The pipeline's stages against what they must keep, and the queries' SQL."""

import numbers

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import jaccard_join, mixing, pii, queries, sentencepieces


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "encoding"]


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, total = docs.columns, docs.count()
    docs = docs.unionByName(spark.createDataFrame([(10**6, "12345 !!", "en", "src0", 8), (10**6 + 1, None, None, None, None)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        if name == "language":
            assert docs.count() == total  # only the texts without letters go
        elif name == "near_duplicates":
            keep = {r.component_id for r in jaccard_join.jaccard_components(before).collect()}
            assert {r.doc_id for r in docs.collect()} == keep and docs.count() == len(keep)
        elif name == "personal_data":
            assert docs.count() == before.count() and all(not pii.base_spans(r.text) for r in docs.select("text").collect())
        else:
            assert sorted(map(str, docs.collect())) == sorted(map(str, before.collect()))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    back = {r.doc_id: r.text for r in sentencepieces.decoded(out).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_columns_of_the_table_survive_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["score", "lang_pred", "position", "slot", "block", "_n", "_rank", "_kept", "place", "kept", "bucket", "n", "s", "ids"]
    docs = docs.selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in names]).cache()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        kept = {n: n for n in names} | ({"ids": "ids_input", "position": "position_input"} if name == "encoding" else {})
        assert docs.where(" or ".join(f"{kept[n]} is distinct from concat('{n}', doc_id)" for n in names)).count() == 0
        assert name == "encoding" or docs.columns == before.columns
        assert docs.count() > 20


def test_last_stage_returns_the_mixture_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6)).cache()
    stages = dict(corpus_pipeline.STAGES)
    path = str(tmp_path / "mixture")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several files
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 20)
    try:
        stages["mixture"](spark, docs, sf_dir).write.parquet(path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    back = spark.read.parquet(path)
    want = [r.doc_id for r in mixing.mixed(docs).orderBy("position").select("doc_id").collect()]
    assert len(back.inputFiles()) > 8 and [r.doc_id for r in back.collect()] != want
    got = stages["encoding"](spark, back, sf_dir).orderBy("position").select("doc_id", "position").collect()
    assert [r.doc_id for r in got] == want and [r.position for r in got] == list(range(len(want)))


def test_run_returns_all_kept_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert "ids" in out.columns and 0 < out.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the cat and the hat in the house", "en", "a", 32), (4, "the cat and the hat in the house", "en", "a", 32), (4, "the cat and the hat in the house", "en", "a", 32)]
ODD += [(None, "write to me at anna.long@example.com or not at all", "en", None, 50), (5, "le chat et la maison avec une porte", "fr", "b", 35), (6, None, "fr", "b", None), (7, " \n ", None, "b", 3)]


def test_each_stage_on_null_and_empty_texts(spark, sf_dir):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    every = sorted(str(r.doc_id) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        ids = sorted(str(r.doc_id) for r in out.collect())
        if name == "language":
            assert ids == sorted(i for i in every if i not in ("1", "2", "6", "7"))  # those without letters go
        elif name == "near_duplicates":
            assert set(ids) == set(every) - {"4"} and len(ids) == len(set(ids))  # texts without words are near nothing
        else:
            assert ids == every
        if name == "personal_data":
            assert [r.text for r in out.where("doc_id in (1, 6)").collect()] == [None, None]
            assert "example.com" not in out.where("doc_id is null").first().text
        assert name == "encoding" or out.columns == docs.columns


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_nothing(spark, sf_dir, name):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert out.count() == 0 and (name == "encoding" or out.columns == docs.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    number = lambda x: None if pd.isna(x) else float(x) if isinstance(x, numbers.Number) and not isinstance(x, bool) else x  # noqa: E731  # longs with nulls come as floats on one side
    rows = lambda frame: sorted(str(tuple(map(number, r))) for r in frame[columns].itertuples(index=False))
    assert rows(mine) == rows(theirs)
