"""A corpus from documents: quality, near duplicates, leaks, personal data, mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard import ngram_jaccard_join
from tessera.llm.mixing import mix_sources
from tessera.llm.pii import pii_surrogates
from tessera.llm.quality_model import quality_filter
from tessera.llm.store import Scratch

#: Stages learn, search and count over whole tables, so SQL cannot express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; rejected ones go."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=0.7)


def _with_row(docs: DataFrame) -> DataFrame:
    """Rows told by id and text: ids may be null, or of several rows."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies
    (five-word shingles, similarity 0.8 or more).  Rows without an id, and rows
    that share one, are documents like any other; of equal rows one stays."""
    rows = _with_row(docs)
    groups = ngram_jaccard_join(rows, n=5, threshold=(80, 100), id_col="_row").select("doc_id", "component_id").distinct().withColumnRenamed("doc_id", "_row")
    ids = rows.select("_row", "doc_id").join(groups, "_row")
    first = ids.groupBy("component_id").agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_row")).select("_row")
    return rows.join(first, "_row", "left_semi").dropDuplicates(["_row", "doc_id"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    rows = _with_row(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row").where("contaminated").select(F.col("doc_id").alias("_row"))
    return rows.join(found, "_row", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data."""
    out = pii_surrogates(docs).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document."""
    return mix_sources(docs, weights=(5, 2, 1), cap=3)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")  # which ships the package to executors
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
