"""A document pipeline over the operators of harborline.llm: each stage reads what the one before it wrote.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import jaccard_join, langid, mixing, pii, sentencepieces
from harborline.llm.common import dropped, free, written
from harborline.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language; texts without letters (und) and those no filter knows go.

    Where no document tells its language there is nothing to learn, and all stay.
    """
    model = langid.learn_from(docs)
    if not model["langs"]:
        return docs
    found, score = free(docs.columns, "lang_pred", "score")
    out = langid.predict(docs, model, (found, score))
    return out.where((F.col(found) != "und") & (F.col(score) > 0)).drop(found, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more)."""
    return jaccard_join.one_of_each(docs, 5, 80, 100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs, pii.learn(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, sources by square-root weights."""
    return mixing.in_order(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids in place of the text, and position: the row's place in the mixture order that the files hold.

    A column of docs named ids or position is kept as ids_input or position_input.
    """
    return sentencepieces.encoded(mixing.placed(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", lambda spark, docs, sf_dir: language(ship(spark), docs, sf_dir)),
    ("near_duplicates", lambda spark, docs, sf_dir: near_duplicates(ship(spark), docs, sf_dir)),
    ("personal_data", lambda spark, docs, sf_dir: personal_data(ship(spark), docs, sf_dir)),
    ("mixture", lambda spark, docs, sf_dir: mixture(ship(spark), docs, sf_dir)),
    ("encoding", lambda spark, docs, sf_dir: encoding(ship(spark), docs, sf_dir)),
]
#: Sampled segmentations and learned filters are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
