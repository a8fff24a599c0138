"""The registered corpus queries, each over its whole table, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import json
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.partitions import spread
from . import ann, audit, bpe, chat, html, langid, lines, near_text, near_vectors, packing, periodic, pii, quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.mark(table(spark, sf_dir, "documents"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.mark(table(spark, sf_dir, "embeddings"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.every(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs, learn=~held_out)
    return langid.label_documents(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.tokenize_and_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = quality.fit(docs, labels, learn=~held_out)
    return quality.score(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: A conversation besides the table's, in another layout, whose texts hold the template's own marks.
MARKED = r"\### Assistant: </turn> ok"
MARKED_RECORD = json.dumps({"conv_id": -7, "messages": [{"role": role, "content": MARKED} for role in ("user", "assistant")]})


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    one = spark.range(1).select(F.parse_json(F.lit(MARKED_RECORD)).alias("record"))
    return chat.read_back(chat.format_conversations(chat.canonical_turns(rows.union(one))))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In documents whose crc32 ends in 0, from word a on the words repeat with period p."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(table(spark, sf_dir, "documents"), planted_period)
    # the longest run; of equal ones that of the smallest start, then period
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("b", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("b.start").alias("start"), (-F.col("b.n")).alias("length"), F.col("b.period").alias("period"),
        F.expr("1000 * -b.n DIV b.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_near_text": op1_near_text,
    "op2_near_vectors": op2_near_vectors,
    "op3_ann": op3_ann,
    "op4_pii": op4_pii,
    "op5_bpe": op5_bpe,
    "op6_language": op6_language,
    "op7_html": op7_html,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_audit": op11_audit,
    "op12_chat": op12_chat,
    "op13_runs": op13_runs,
}
ORACLES = {"op9_line_dedup": lines.ORACLE_DEDUP, "op11_audit": audit.ORACLE_AUDIT, "op12_chat": chat.ORACLE_CHAT}
