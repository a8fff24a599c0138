"""Shared pieces of the corpus operators: scratch tables, samples and connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_BASE: str | None = None
_BLOCK: ContextVar[list[str] | None] = ContextVar("block", default=None)


def scratch_base(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a temporary one in local mode, as in
    tests; elsewhere executors couldn't see each other's files, so that is an error."""
    global _LOCAL_BASE
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_BASE is None:
        _LOCAL_BASE = tempfile.mkdtemp(prefix="strandloom-")
    return _LOCAL_BASE


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor. The folder goes at the end of the ``settled`` block that
    it was written in, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files(spark, path, lambda system, at: system.deleteOnExit(at))
    if (block := _BLOCK.get()) is not None:
        block.append(path)
    return spark.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str, act) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``build`` returns and read it back; the tables that were written on the way go."""
    mark = _BLOCK.set([])
    try:
        out, on_the_way = build(), _BLOCK.get()
        _BLOCK.reset(mark)
        mark = None
        out = written(out, name)
    finally:
        if mark is not None:
            on_the_way = _BLOCK.get()
            _BLOCK.reset(mark)
        for path in on_the_way:
            files(spark, path, lambda system, at: system.delete(at, True))
    return out


#: Parts of the filter of ``perhaps``, each of 32,768 bits: 4 MB in all, whatever the keys.
FILTER_PARTS = 1024


def perhaps(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with __maybe: false only where no row of ``keys`` has the same ``columns`` (nulls are equal).

    A bit stands for each of 2^25 hashes, so the table of bits has one size however many keys there are, and it alone is
    broadcast. Wide rows that it rules out need not move to meet the keys; what it lets through still has to meet them.
    With more keys than it can tell apart it lets all through.
    """
    h = F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(FILTER_PARTS * 32768)) + 1
    part, at = F.bitmap_bucket_number(h), F.bitmap_bit_position(h)
    bits = keys.select(part.alias("__part"), at.alias("__at")).groupBy("__part").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(bits), part == F.col("__part"), "left").select(*rows.columns, maybe.alias("__maybe"))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Views of at most so many rows of each batch: what a worker makes of the texts is that of a slice, while a batch has
    10,000 texts of any length. What Arrow and the C library keep of earlier batches and tasks goes before each batch, as
    workers stay."""
    give_back()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        give_back()


def give_back() -> None:
    """Memory that was freed but not returned goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def lowest_by_hash(rows: DataFrame, key: str, limit: int, total: int | None = None) -> DataFrame:
    """A repeatable sample of at most ``limit`` rows: those whose key hashes lowest (ties by key).

    Where the number of rows is known, hashes beyond twice the share that is needed go first, so that each task sends a
    share of the sample, and not a whole one.
    """
    h = F.xxhash64(F.col(key), F.lit(20))
    if total and total > 4 * limit >= 400:
        rows = rows.where(h < int(-(2**63) + 2**64 * 2 * limit / total))
    return rows.orderBy(h, F.col(key)).limit(limit)


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root) for every node with an edge, root the smallest node.

    Alternates large-star and small-star steps, which needs a number of rounds logarithmic in the longest path; each
    round groups by node with map-side minima and is written, so a lost executor repeats one round at most.
    """
    def canon(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def settle() -> DataFrame:
        now = written(canon(edges), name)
        before = state(now)
        for _ in range(rounds):
            # large star: each larger neighbour of a node goes to the node's least neighbour or itself; a hub's edges are
            # minimised before they move, and their join splits by rows
            both = now.union(now.select("b", "a"))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a")
            # small star: a node and its smaller neighbours go to the least of those
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
            after = state(now)
            if after == before:
                return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
            before = after
        raise RuntimeError("components did not settle")

    return settled(edges.sparkSession, name, settle)
