"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are assigned to the list of their nearest centre (k-means on a bounded sample). Largest inner product becomes
smallest distance by one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm, so one index serves both. A query
probes its nearest lists. All vectors are rotated by one random orthogonal matrix; a list is scanned column block by
column block, and after each block the candidates whose partial distance already shows, by a hypothesis test at
EPSILON, that their whole distance exceeds the query's current k-th best are abandoned. What survives all columns is
scored exactly, in double precision, on the original vectors.

The number of probed lists is set by measuring recall against brute force on a bounded sample of queries: it doubles
until TARGET is reached. Should all lists with the test miss it, they are scanned without the test, which is exact. Lists
are cut into blocks of bounded size, and so are the queries that probe a list, so that one vector that a third of all rows
hold, or one large list, is scanned by many tasks; each block gives its k best, and the query's k best come from those,
with the window's partial limit before the shuffle.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of each
length are searched among themselves; a query never finds its own id; ties go to smaller ids; fewer candidates than k give
that many rows; of rows of one id the smallest vector counts; an empty table gives an empty result; other columns are not
carried.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lowest_by_hash, written

#: The documented bounds of the samples: vectors that fit the centres, and queries whose recall is measured.
FIT_ROWS = 16_384
AUDIT_QUERIES = 64
TARGET = 0.97
#: Rows of a list's block; columns of a column block; strictness of the abandoning test.
BLOCK = 4096
#: Queries of a list's block.
ASKED = 1024
COLUMNS = 16
EPSILON = 2.1
MAX_LISTS = 4096


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, v, norm) with v as doubles, and the columns to ``carry``, of the vectors that can be compared."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v"), *carry).where("id IS NOT NULL AND size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0 AND norm < double('infinity')")


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = []
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(x), 4096):
        gap = half - x[i : i + 4096] @ centres.T
        part = np.argpartition(gap, min(k, gap.shape[1]) - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(gap, part, 1), axis=1, kind="stable"), 1))
    return np.vstack(out) if out else np.zeros((0, k), np.int64)


def augmented(v: np.ndarray, norms: np.ndarray, top: float, query: bool) -> np.ndarray:
    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(top * top - norms * norms, 0.0))
    return np.hstack([v, last[:, None]])


class Index:
    """Centres and rotation: what every task needs, of a size bounded by MAX_LISTS and the dimension."""

    def __init__(self, sample: np.ndarray, top: float, lists: int):
        rng = np.random.default_rng(9)
        self.dim, self.top = sample.shape[1], top
        x = augmented(sample, np.linalg.norm(sample, axis=1), top, False)
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim + 1, self.dim + 1)))[0]
        self.centres = kmeans(x, min(lists, len(x)))

    def lists(self, v: np.ndarray, k: int, query: bool) -> np.ndarray:
        return nearest(augmented(v, np.linalg.norm(v, axis=1), self.top, query), self.centres, min(k, len(self.centres)))

    def rotated(self, v: np.ndarray, query: bool) -> np.ndarray:
        return augmented(v, np.linalg.norm(v, axis=1), self.top, query) @ self.rotation


def scan(index: Index, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, epsilon: float = EPSILON):
    """(query, row, score) positions of the k best rows of a block for each query, by adaptive dimension scan."""
    q, x = index.rotated(queries, True), index.rotated(rows, False)
    dims = x.shape[1]
    edges = [*range(0, dims, COLUMNS), dims]
    out_q, out_r, out_s = [], [], []
    for i in range(len(q)):
        alive = np.flatnonzero(ids != query_ids[i])
        if not len(alive):
            continue
        # the whole distances of a first few rows give a bound for the tests
        first = alive[:: max(1, len(alive) // (4 * k))]
        bound = np.inf
        if len(first) >= k:
            bound = np.partition(((x[first] - q[i]) ** 2).sum(1), k - 1)[k - 1]
        part = np.zeros(len(alive))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            gap = x[alive, a:b] - q[i, a:b]
            part = part + np.einsum("ij,ij->i", gap, gap)
            if b < dims and np.isfinite(bound):
                # a partial distance over b of dims columns estimates the whole as dims / b times itself
                keep = part * (dims / b) <= bound * (1 + epsilon / math.sqrt(b)) ** 2
                alive, part = alive[keep], part[keep]
        score = rows[alive] @ queries[i]
        if len(alive) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= cut
            alive, score = alive[keep], score[keep]
        order = np.lexsort((ids[alive], -score))[:k]
        out_q.append(np.full(len(order), i))
        out_r.append(alive[order])
        out_s.append(score[order])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of largest inner product; both tables as ``usable`` gives them."""
    spark = rows.sparkSession
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # one index for each length of vectors: one, in a sound table
    facts = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy("dim").collect()
    for f in facts:
        here = F.size("v") == f["dim"]
        out = out.union(search_length(rows.where(here), queries.where(here), f["n"], f["top"], k, target))
    return out


def search_length(rows: DataFrame, queries: DataFrame, n: int, top: float, k: int, target: float) -> DataFrame:
    """``search`` among n vectors of one length, the longest of norm ``top``."""
    spark = rows.sparkSession
    lists = int(min(MAX_LISTS, max(1, round(0.5 * math.sqrt(n)))))
    sample = np.array([r["v"] for r in lowest_by_hash(rows.select("id", "v"), "id", FIT_ROWS, n).collect()])
    index = Index(sample, top, lists)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            yield batch.assign(list=shared.value.lists(matrix(batch["v"]), 1, False)[:, 0])

    listed = written(rows.select("id", "v").mapInPandas(assign, "id bigint, v array<double>, list int"), "lists")

    def parts(frame: DataFrame, size: int, name: str) -> DataFrame:
        return frame.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))  # at most MAX_LISTS rows

    blocks = parts(listed, BLOCK, "blocks")

    def found(asked: DataFrame, probes: int, epsilon: float) -> DataFrame:
        def probe(batches):
            for batch in batches:
                yield batch.assign(lists=list(shared.value.lists(matrix(batch["qv"]), probes, True)))

        probed = asked.select(F.col("id").alias("q_id"), F.col("v").alias("qv")).mapInPandas(probe, "q_id bigint, qv array<double>, lists array<int>")
        probed = written(probed.select("q_id", "qv", F.explode("lists").alias("list")), "probed")
        both = blocks.join(parts(probed, ASKED, "groups"), "list")
        # rows and queries of a list are dealt to blocks and groups by a hash of the id, and each of one meets each of the other
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
        sized = F.broadcast(both)
        asking = probed.join(sized, "list").select("list", every("blocks").alias("block"), deal("q_id", "groups").alias("group"), "q_id", "qv")
        giving = listed.join(sized, "list").select(F.col("list").alias("l2"), deal("id", "blocks").alias("b2"), every("groups").alias("g2"), "id", "v")

        def local(group: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if not len(group) or not len(block):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            q_ids, ids = group["q_id"].to_numpy(), block["id"].to_numpy()
            a, b, score = scan(shared.value, matrix(group["qv"]), q_ids, matrix(block["v"]), ids, k, epsilon)
            return pd.DataFrame({"query_id": q_ids[a], "vec_id": ids[b], "score": score})

        best = asking.groupBy("list", "block", "group").cogroup(giving.groupBy("l2", "b2", "g2")).applyInPandas(local, "query_id bigint, vec_id bigint, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    return found(queries, *audited(listed, queries, index, found, k, target))


def audited(listed: DataFrame, queries: DataFrame, index: Index, found, k: int, target: float) -> tuple[int, float]:
    """Lists to probe, doubled until a bounded sample of queries, held against brute force, reaches the target recall, and
    the strictness of the abandoning test: without bound if all lists with the test do not reach it."""
    spark = listed.sparkSession
    asked = lowest_by_hash(queries.select("id", "v"), "id", AUDIT_QUERIES)
    some = asked.collect()
    if not some:
        return 1, EPSILON
    q_ids, q = np.array([r["id"] for r in some]), np.array([r["v"] for r in some])
    shared = spark.sparkContext.broadcast((q_ids, q))

    def exact(batches):
        ids, v = shared.value
        best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
        for batch in batches:
            rows, names = matrix(batch["v"]), batch["id"].to_numpy()
            score = v @ rows.T
            score[ids[:, None] == names[None]] = -np.inf
            both, who = np.hstack([best_s, score]), np.hstack([best_i, np.broadcast_to(names, score.shape)])
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(both, top, 1), np.take_along_axis(who, top, 1)
        yield pd.DataFrame({"query_id": np.repeat(ids, k), "vec_id": best_i.ravel(), "score": best_s.ravel()})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = listed.select("id", "v").mapInPandas(exact, "query_id bigint, vec_id bigint, score double").where("vec_id >= 0")
    truth = truth.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    least = {r["query_id"]: (r["least"], r["n"]) for r in truth}
    sample = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(q_ids, q, strict=True)], "id bigint, v array<double>")
    probes, lists = min(8, len(index.centres)), len(index.centres)
    while True:
        got = found(sample, probes, EPSILON).collect()  # at most AUDIT_QUERIES x k rows
        # a result as near as the k-th true one counts, whichever of equals it is
        hits = sum(r["score"] >= least[r["query_id"]][0] - 1e-12 for r in got if r["query_id"] in least)
        if hits >= target * sum(n for _, n in least.values()):
            return probes, EPSILON
        if probes == lists:
            return lists, math.inf
        probes = min(2 * probes, lists)


def every(vectors: DataFrame, condition: Column, k: int = 20) -> DataFrame:
    """Nearest neighbours among ``vectors`` (vec_id, embedding) of those whose id meets ``condition``."""
    rows = usable(vectors).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("x")).select("id", "x.v", "x.norm")
    rows = written(rows, "vectors")
    return search(rows, rows.where(condition), k)
