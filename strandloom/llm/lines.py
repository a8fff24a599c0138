"""Line dedup over overlapping three-line windows, with DataFrame functions only.

Every run of three consecutive lines is hashed. A window whose three lines occurred before (in order of document id,
then of the text's hash, then of position) is a repeat, and all lines it covers go; overlapping covered spans merge.
The first occurrence anywhere stays.

Defined results: a text under three lines has no window and stays as it is, as do null and empty texts; a run of equal
lines keeps its first line; rows that repeat a document (same id, same text) count as that one document and all get its
result; documents of one id but other text are told apart by their text's hash; a null id sorts first; extra columns of
the input are carried by ``cleaned`` (names that begin with two underscores are its own) and not by ``dedup_lines``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import perhaps, written

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """One row for each window: key (two 64-bit hashes of its lines), the document's id and text hash, first line."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    shifted = F.arrays_zip(*(F.slice(lines, i + 1, F.greatest(n - WINDOW + 1, F.lit(0))).alias(f"l{i}") for i in range(WINDOW)))
    exploded = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(shifted).alias("pos", "w"))
    names = [f"w.{k}" for k in exploded.schema["w"].dataType.names]
    # the second hash starts from another seed and reads the lines in another order: 128 bits together
    return exploded.select(
        F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit(7), *reversed(names)).alias("h2"), "doc_id", "th", "pos"
    )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Windows that are not the first of their key: (doc_id, th, pos).

    The first occurrence comes from an aggregate with map-side minima, so a window that a third of all documents share
    costs one row a task; the join back splits a hot key by rows.
    """
    found = windows(docs)
    first = (
        found.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    at = F.struct("doc_id", "th", "pos")
    return found.join(first, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first"))).select("doc_id", "th", "pos")


def cleaned(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with repeats taken out of ``text``, and __n_lines and __n_removed.

    Only texts that may hold a repeat move to meet the places of theirs, and their lines are cut after that; the others
    stay where they are read.
    """
    starts = repeated_windows(docs).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("__starts"))
    starts = written(starts.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__starts"), "starts")
    source = perhaps(docs.withColumn("__id", F.col("doc_id")).withColumn("__th", F.xxhash64("text")), starts, "__id", "__th")
    some, names = source.where("__maybe").drop("__id", "__th"), docs.columns
    joined = some.join(starts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    joined = joined.withColumn("__lines", F.split("text", "\n"))
    n, k = F.size("__lines"), F.size("__starts")
    # what stays lies between the end of one covered span and the start of the next
    gaps = F.filter(
        F.transform(
            F.sequence(F.lit(0), k),
            lambda i: F.struct(
                F.when(i == 0, F.lit(0)).otherwise(F.get("__starts", i - 1) + WINDOW).alias("a"),
                F.when(i == k, n).otherwise(F.get("__starts", i)).alias("b"),
            ),
        ),
        lambda g: g["a"] < g["b"],
    )
    kept = F.when(F.col("__starts").isNotNull(), F.flatten(F.transform(gaps, lambda g: F.slice("__lines", g["a"] + 1, g["b"] - g["a"]))))
    out = joined.withColumn("__kept", kept)
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    changed = out.select(
        *(text.alias(c) if c == "text" else F.col(c) for c in names),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("__n_lines"),
        F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept")).cast("bigint").alias("__n_removed"),
    )
    whole = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint")
    return source.where("NOT __maybe").select(*names, whole.alias("__n_lines"), F.lit(0).cast("bigint").alias("__n_removed")).union(changed)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed), one row for each row of ``docs`` (doc_id, text)."""
    out = cleaned(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


ORACLE_DEDUP = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
w AS (SELECT doc_id, i, line, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) AS k FROM w WHERE l3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
kept AS (SELECT p.doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id)
SELECT l.doc_id, coalesce(kept.text, CASE WHEN l.text IS NOT NULL THEN '' END) AS text,
       coalesce(len(l.ls), 0)::BIGINT AS n_lines, (coalesce(len(l.ls), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed
FROM l LEFT JOIN kept USING (doc_id)
"""
