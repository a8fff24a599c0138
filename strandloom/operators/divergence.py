"""Divergences between probability masses, and what builds on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import all_pairs, in_blocks, similarity

#: Rows of a block of silhouette, and those of one that are compared with the other block at once.
SUM_ROWS, AT_ONCE = 8192, 256


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mass(values: Column) -> Column:
    """An array divided by its sum; unchanged where that is not positive."""
    t = _total(values)
    return F.when(t > 0, F.transform(values, lambda x: x / t)).otherwise(values)


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in bits; cells where either is 0 are left out."""
    return _total(F.zip_with(p, q, lambda a, b: F.when((a > 0) & (b > 0), a * F.log2(a / b)).otherwise(0.0)))


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    return _total(F.zip_with(p, q, lambda a, b: 0.5 * half(a, (a + b) * 0.5) + 0.5 * half(b, (a + b) * 0.5)))


def js_distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(js(p, q), F.lit(0.0)))


def bhattacharyya(p: Column, q: Column) -> Column:
    """Minus the logarithm of the sum of root products; null for disjoint masses."""
    c = _total(F.zip_with(p, q, lambda a, b: F.sqrt(a * b)))
    return F.when(c > 0, -F.log(c))


def pair_divergences(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(id1, id2, kl, js) of all pairs id1 < id2 of masses."""
    both = all_pairs(rows.select(key, mass(F.col(values)).alias("__m")), key, "__m", F.struct(kl(F.col("x"), F.col("y")).alias("kl"), js(F.col("x"), F.col("y")).alias("js")))
    return both.select("id1", "id2", "score.kl", "score.js")


class Side:
    """A block's rows in the order of their clusters: keys, vectors by length, and where each cluster begins."""

    def __init__(self, table: pa.Table) -> None:
        codes = pa.concat_arrays(table["c"].chunks).dictionary_encode("encode")
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.clusters, self.codes, self.size = codes.dictionary, codes.indices.to_numpy()[order], len(order)
        self.keys, lists = pa.concat_arrays(table["k"].chunks), pa.concat_arrays(table["v"].chunks)
        self.same = self.keys.dictionary_encode().indices.to_numpy()
        self.lengths = lists.value_lengths().fill_null(-1).to_numpy()
        self.at = {int(n): np.flatnonzero(self.lengths == n) for n in np.unique(self.lengths) if n >= 0}
        self.vectors = {n: lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n) for n, at in self.at.items()}
        self.starts = np.flatnonzero(np.diff(self.codes, prepend=-1))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` and ``y``; where the products can't tell them, from the differences."""
    with np.errstate(invalid="ignore", over="ignore"):
        both = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
        squared = both - 2 * (x @ y.T)
        i, j = np.nonzero(~(squared > 1e-6 * both))
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            squared[a, b] = ((x[a] - y[b]) ** 2).sum(axis=1)
        return np.sqrt(squared)


def _sums_table(side: Side, rows: np.ndarray, own: np.ndarray, clusters: pa.Array, into: np.ndarray, sums: np.ndarray, counts: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    there = np.flatnonzero(met > 0)
    take = lambda a, at: a.take(pa.array(at[there]))
    return pa.RecordBatch.from_arrays([take(side.keys, rows), take(side.clusters, own), take(clusters, into), pa.array(sums[there]), pa.array(counts[there].astype(np.int64))], names=["k", "own", "other", "s", "n"])


def block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, own, other, s, n): for the rows of two blocks the sum and number of their distances to each cluster of the other.

    Rows of one key are not compared; they stand in one block. A pair without a distance counts as met, but adds nothing.
    """
    table = pa.Table.from_batches(list(batches))
    block, p, q = table["__i"].to_numpy(), table["__p"][0].as_py(), table["__q"][0].as_py()
    if not (block == p).any() or not (block == q).any():
        return
    left = Side(table.filter(pa.array(block == p)))
    right = left if p == q else Side(table.filter(pa.array(block == q)))
    del table
    even = len(left.at) == 1 and left.at.keys() == right.at.keys() and left.lengths.min() >= 0 and right.lengths.min() >= 0
    held, sums, counts, met = -1, None, None, None

    def back() -> pa.RecordBatch:
        every = np.arange(right.size)
        return _sums_table(right, every, right.codes, left.clusters, np.full(right.size, held), sums, counts, met)

    for at in range(0, left.size, AT_ONCE):
        rows = np.arange(at, min(at + AT_ONCE, left.size))
        gap, told = np.zeros((len(rows), right.size)), np.full((len(rows), right.size), even)
        for n, places in left.at.items():
            mine = places[(places >= at) & (places < at + AT_ONCE)]
            if len(mine) and n in right.at:
                found = _gaps(left.vectors[n][np.searchsorted(places, mine)], right.vectors[n])
                if even:
                    gap = found
                else:
                    gap[np.ix_(mine - at, right.at[n])], told[np.ix_(mine - at, right.at[n])] = found, True
        apart = np.ones_like(told) if p != q else left.same[rows][:, None] != right.same[None]
        if p == q:
            gap[~apart] = 0.0
            told &= apart
        by = lambda x, starts, axis: np.add.reduceat(x, starts, axis=axis, dtype=float)
        wide = len(right.starts)
        yield _sums_table(left, np.repeat(rows, wide), np.repeat(left.codes[rows], wide), right.clusters, np.tile(right.codes[right.starts], len(rows)), *(by(x, right.starts, 1).ravel() for x in (gap, told, apart)))
        if p != q:
            # the left block's clusters follow one another, so one at a time is open
            starts = np.flatnonzero(np.diff(left.codes[rows], prepend=-1))
            for code, *more in zip(left.codes[rows][starts].tolist(), *(by(x, starts, 0) for x in (gap, told, apart))):
                if code == held:
                    sums, counts, met = sums + more[0], counts + more[1], met + more[2]
                else:
                    if held >= 0:
                        yield back()
                    held, (sums, counts, met) = code, more
    if held >= 0:
        yield back()


def silhouette(rows: DataFrame, key: str, values: str, cluster: str) -> DataFrame:
    """(key, cluster, silhouette) with squared-free Euclidean distances between all rows: exact, in block pairs.

    A task holds two blocks and adds up its distances by row and cluster, both ways, as matrices; a row's mean distance to
    each cluster comes from these sums, so no pair leaves its task. A cluster of one row has silhouette 0.
    """
    whole = F.when(~F.coalesce(F.exists(values, F.isnull), F.lit(False)), F.col(values))
    labelled = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.transform(whole, lambda x: x.cast("double")).alias("v"), F.col(cluster).alias("c"))
    sent = in_blocks(labelled, "k", size=SUM_ROWS).withColumn("__j", F.explode("__all"))
    pairs = sent.select("k", "v", "c", "__i", F.least("__i", "__j").alias("__p"), F.greatest("__i", "__j").alias("__q")).groupBy("__p", "__q")
    shape = labelled.select("k", F.col("c").alias("own"), F.col("c").alias("other"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n")).schema
    sums = pairs.applyInArrow(block_sums, shape).withColumnRenamed("k", key)
    means = sums.groupBy(key, "own", "other").agg(F.when(F.sum("n") > 0, F.sum("s") / F.sum("n")).alias("m"))
    sides = means.groupBy(key, "own").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("m"))).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return sides.select(key, F.col("own").alias(cluster), score.alias("silhouette"))


def reproducibility(rows: DataFrame, dataset: str, key: str, values: str, scale: float = 10.0) -> DataFrame:
    """(set1, set2, similarity): mean exp(-scale * JS) over all pairs of ids of two data sets (set1 <= set2)."""
    masses = in_blocks(rows.select(dataset, key, mass(F.col(values)).alias("m")), key)
    sets = masses.select(F.col(dataset).alias("set1")).distinct()
    # the pairs of data sets are an equality key, with the pair of blocks: every pair of ids of two sets is asked for
    grid = sets.crossJoin(F.broadcast(sets.withColumnRenamed("set1", "set2"))).where("set1 <= set2")
    left = masses.select(F.col(dataset).alias("set1"), F.col("m").alias("x"), F.col("__i").alias("i"), F.explode("__all").alias("j"))
    right = masses.select(F.col(dataset).alias("set2"), F.col("m").alias("y"), F.explode("__all").alias("i"), F.col("__i").alias("j"))
    both = left.join(grid, "set1").join(right, ["set2", "i", "j"])
    return both.groupBy("set1", "set2").agg(F.avg(similarity(js(F.col("x"), F.col("y")), scale)).alias("similarity"))
