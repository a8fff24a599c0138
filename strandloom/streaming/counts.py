"""Running counts of reads as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reads


def dyads(stream: DataFrame, **options) -> DataFrame:
    """(id, pos, value) over a stream of classified reads; write in update or complete mode. State: one number a cell."""
    return reads.dyad_histogram(reads.cuts(stream, **options))


def windowed_types(stream: DataFrame, time: str, width: str, late: str, column: str = "type") -> DataFrame:
    """(start, type, n) in tumbling windows; rows later than ``late`` behind the newest are left out, and state is dropped then."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width), column).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), column, "n")


def probed(stream: DataFrame, refs: DataFrame, time: str, late: str) -> DataFrame:
    """(read_id, call, ref_len, edit) of a stream of reads (read_id, calls, time): each call met with the references.

    A call of a read that comes again within ``late`` is left out; later than that behind the newest its state is gone and
    late rows are left out. The references are a static table, broadcast or shuffled by their size.
    """
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    calls = timed.select("read_id", "__t", F.explode("calls").alias("call")).dropDuplicatesWithinWatermark(["read_id", "call"])
    return reads.met_calls(calls, refs).select("read_id", "call", "ref_len", "edit")


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): runs of rows of one key without a pause of ``gap``."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(key, F.session_window("__t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
