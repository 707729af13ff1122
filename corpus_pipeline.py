"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all its predecessor kept; its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents, whatever their names.

Defined cases of all stages: an empty table gives no rows; null and empty texts are kept by those stages that they are not rejected by (the quality classifier
scores them as any other), have no near duplicates, lose nothing and are packed as one end mark; texts may be of any length. Rows with a null
doc_id are kept by the second stage, since they have no id to be known by, and count as the last documents in the third. Of repeated rows
(one doc_id and one text) the second stage keeps one; other rows of one doc_id stand or fall together there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm import decontaminate, neardup, packing, quality, repeats
from meterflow.llm.shared import materialize


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with names for all columns but doc_id and text that no operator uses."""
    return docs.select([F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"`{c}`").alias(f"_column{i}") for i, c in enumerate(docs.columns)])


def _named(plain: DataFrame, docs: DataFrame, fit: bool = False) -> DataFrame:
    """The columns of ``docs`` again; n_chars made to fit the text where it was changed, if ``fit``."""
    out = plain.select([F.col(c if c in ("doc_id", "text") else f"_column{i}").alias(c) for i, c in enumerate(docs.columns)])
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if fit and "n_chars" in docs.columns else out


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = quality.with_quality(_plain(docs), quality.query_trees(spark, docs, sf_dir))
    return _named(scored.where(F.col("quality_score") >= quality.LEAST_SCORE), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; of its repeated rows one."""
    plain = _plain(docs)
    kept = neardup.near_duplicates(plain).where("kept OR doc_id IS NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = plain.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    # only rows of ids that occur again are compared with each other
    again = materialize(plain.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    single = rows.join(again, "doc_id", "left_anti")
    several = rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _named(single.unionByName(several), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a document of smaller doc_id has."""
    plain = _plain(docs)
    others = tuple(c for c in plain.columns if c not in ("doc_id", "text"))
    return _named(repeats.remove_repeats(plain, carry=others), docs, fit=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a benchmark item has."""
    found = decontaminate.find_hits(_plain(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _named(decontaminate.remove_spans(found), docs, fit=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in windows."""
    return packing.pack(materialize(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("repeats", without_repeats), ("benchmark", without_benchmark), ("packing", packed)]
#: Learned trees, suffix arrays and a tokenizer can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
