"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` applies them to the table of ``sf_dir``, each written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import lines, near_text, packing, pii, quality
from strandloom.llm.common import perhaps, written


def sized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the text now has them."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, taught by all labels, rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and with them documents of which nothing is left."""
    out = lines.cleaned(docs).where("__n_removed = 0 OR __n_removed < __n_lines")
    return sized(out.drop("__n_lines", "__n_removed"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the smallest id. Of rows of one id one stays: that whose
    text, without case and blanks, hashes least, as in the comparison."""
    gone = near_text.mark(docs).where("NOT kept").select("doc_id")
    # texts that are surely none of these stay where they are read
    source = perhaps(docs.withColumn("__id", F.col("doc_id").cast("bigint")), gone.withColumnRenamed("doc_id", "__id"), "__id")
    left = source.where("__maybe").join(gone, "doc_id", "left_anti").select(docs.columns).union(source.where("NOT __maybe").select(docs.columns))
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    first = F.struct(F.col("text").isNull(), norm == "", F.xxhash64(norm), F.xxhash64(F.lit(3), norm), F.xxhash64(F.to_json(F.struct("*"))))
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), first).alias("__row"))
    return left.join(again, "doc_id", "left_anti").select(docs.columns).union(one.select("__row.*").select(docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose them are generalised or removed."""
    return sized(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.tokenize_and_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the signatures, the disclosure statistics nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
