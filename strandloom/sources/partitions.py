"""Input partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan, dealt over the cores where it has fewer splits than cores, as small files of one row group have.

    A large table has more splits than cores and is left alone: this never shuffles one. Results are the same either way.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
