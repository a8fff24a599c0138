"""Matrix models: components, factorisations, clusterings and embeddings of signals.

PCA and k-means are Spark ML over distributed rows. NMF keeps its row factors distributed: every round is one pass of
small aggregated matrices. Spectral methods, linkage and t-SNE work on a pair matrix by definition; they take a table of
pairs whose number of ids is checked against a documented bound before it reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.memo import Settled, passing_folder

#: Ids of a pair matrix that may be brought to the driver (n^2 doubles: 128 MB).
MATRIX_IDS = 4000
#: Bytes of a matrix that a task of a round of NMF takes.
PART_BYTES = 1 << 21
#: Products of one Krylov subspace.
POWER = 5


def pca(rows: DataFrame, key: str, values: str, k: int | None = None, share: float = 0.9, standardise: bool = False) -> tuple[DataFrame, list[float]]:
    """(key, pcs) and the explained shares; without ``k``, as many of ten components as pass ``share``."""
    data = rows.select(key, F.col(values).alias("__v"))
    if standardise:
        n = data.select(F.size("__v")).first()[0]
        facts = data.agg(*(F.avg(F.get("__v", F.lit(i))).alias(f"m{i}") for i in range(n)), *(F.stddev_pop(F.get("__v", F.lit(i))).alias(f"s{i}") for i in range(n))).first()
        data = data.select(key, F.array(*(((F.get("__v", F.lit(i)) - facts[f"m{i}"]) / facts[f"s{i}"]) if facts[f"s{i}"] else F.lit(0.0) for i in range(n))).alias("__v"))
    vectors = data.select(key, array_to_vector("__v").alias("__x"))
    width = data.select(F.size("__v")).first()[0]
    model = PCA(k=min(k or 10, width), inputCol="__x", outputCol="__p").fit(vectors)
    shares = [float(x) for x in model.explainedVariance]
    keep = k or next((i + 1 for i in range(len(shares)) if sum(shares[: i + 1]) > share), len(shares))
    return model.transform(vectors).select(key, F.slice(vector_to_array("__p"), 1, keep).alias("pcs")), shares[:keep]


def outliers(components: DataFrame, key: str, pcs: str = "pcs", share: float = 0.1) -> DataFrame:
    """(key, distance, outlier): Mahalanobis distance on the components; the farthest ``share`` are outliers."""
    k = components.select(F.size(pcs)).first()[0]
    x = [F.get(pcs, F.lit(i)) for i in range(k)]
    facts = components.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k))).first()
    inverse = np.linalg.pinv(np.array([[facts[f"c{i}_{j}"] for j in range(k)] for i in range(k)]))
    d = [c - facts[f"m{i}"] for i, c in enumerate(x)]
    total = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    scored = components.select(key, F.sqrt(F.greatest(total, F.lit(0.0))).alias("distance"))
    cut = scored.agg(F.percentile_approx("distance", 1 - share, F.lit(100000)).alias("__c"))
    return scored.crossJoin(F.broadcast(cut)).select(key, "distance", (F.col("distance") > F.col("__c")).alias("outlier"))


def robust_envelope(components: DataFrame, key: str, pcs: str = "pcs", share: float = 0.01, core: float = 0.5, rounds: int = 10) -> DataFrame:
    """(key, distance, outlier): distances from a centre and covariance that outliers don't move; the farthest ``share`` are
    outliers.

    Minimum covariance determinant by concentration steps: from medians and absolute deviations, each step takes the mean
    and covariance of the ``core`` of rows that are nearest now. A step is two aggregates; it ends when the determinant no
    longer falls. Distances are scaled so that their median is a normal sample's.
    """
    k = components.select(F.size(pcs)).first()[0]
    x = [F.get(pcs, F.lit(i)) for i in range(k)]
    near = lambda c, q: F.percentile_approx(c, q, F.lit(100000))
    centre = list(components.agg(*(near(c, 0.5).alias(f"m{i}") for i, c in enumerate(x))).first())
    wide = components.agg(*(near(F.abs(c - centre[i]), 0.5).alias(f"s{i}") for i, c in enumerate(x))).first()
    inverse = np.diag([1.0 / max(s, 1e-9) ** 2 for s in wide])

    def squared(centre: list, inverse: np.ndarray) -> Column:
        d = [c - F.lit(float(m)) for c, m in zip(x, centre)]
        return F.greatest(sum((d[i] * d[j] * float(inverse[i, j]) for i in range(k) for j in range(k)), F.lit(0.0)), F.lit(0.0))

    least = np.inf
    for _ in range(rounds):
        cut = components.agg(near(squared(centre, inverse), core)).first()[0]
        inner = components.where(squared(centre, inverse) <= F.lit(cut))
        facts = inner.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k))).first()
        cov = np.array([[facts[f"c{i}_{j}"] for j in range(k)] for i in range(k)])
        size = float(np.linalg.det(cov))
        if size >= least * (1 - 1e-12):
            break
        least, centre, inverse = size, [facts[f"m{i}"] for i in range(k)], np.linalg.pinv(cov)
    normal = k * (1 - 2 / (9 * k)) ** 3  # the median of a chi-squared variable of k degrees, near enough
    scale = components.agg(near(squared(centre, inverse), 0.5)).first()[0] / normal or 1.0
    scored = components.select(key, F.sqrt(squared(centre, inverse) / F.lit(float(scale))).alias("distance"))
    cut = scored.agg(near(F.col("distance"), 1 - share).alias("__c"))
    return scored.crossJoin(F.broadcast(cut)).select(key, "distance", (F.col("distance") > F.col("__c")).alias("outlier"))


def kmeans(rows: DataFrame, key: str, values: str, k: int, seed: int = 0, bisecting: bool = False) -> DataFrame:
    """(key, cluster)."""
    vectors = rows.select(key, array_to_vector(F.transform(values, lambda x: x.cast("double"))).alias("features"))
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed).fit(vectors)
    return model.transform(vectors).select(key, F.col("prediction").alias("cluster"))


def relabel(clusters: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """Clusters numbered from 0 by the rising mean of their members' values."""
    met = clusters.join(values.select(key, value), key)
    means = met.groupBy("cluster").agg(F.avg(value).alias("__m"))
    order = means.select("cluster", (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("__m")) - 1).alias("__n"))
    return clusters.join(F.broadcast(order), "cluster").select(key, F.col("__n").alias("cluster"))


def nmf(rows: DataFrame, key: str, values: str, rank: int, rounds: int = 100, seed: int = 0) -> tuple[DataFrame, np.ndarray, float]:
    """(key, weights), the basis (rank x positions) and the Frobenius error of a non-negative factorisation.

    Given the basis, each row's weights are its own problem, solved where the row is; the basis then follows from two
    small sums over all rows, W'X and W'W. So no matrix of all rows exists anywhere.
    """
    data = rows.select(key, F.transform(values, lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("v")).cache()
    facts = data.agg(F.max(F.size("v")).alias("m"), F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    m = facts["m"] or 0
    # as many tasks a round as the matrix has parts of some size, however many partitions the rows it was made from had
    held = data.coalesce(max(1, -(-facts["n"] * m * 8 // PART_BYTES)))
    rng = np.random.default_rng(seed)
    basis = rng.random((rank, m)) * np.sqrt(max((facts["t"] or 1.0) / max(m, 1) / rank, 1e-12)) + 1e-9

    def weights(x: np.ndarray, h: np.ndarray, steps: int = 60) -> np.ndarray:
        w = np.full((len(x), rank), 1.0)
        top, gram = x @ h.T, h @ h.T
        for _ in range(steps):
            w *= top / np.maximum(w @ gram, 1e-12)
        return w

    for _ in range(rounds):
        h = basis

        def sums(batches, h=h):
            a, b = np.zeros((rank, m)), np.zeros((rank, rank))
            for batch in batches:
                if len(batch):
                    x = np.vstack(batch["v"])
                    w = weights(x, h)
                    a, b = a + w.T @ x, b + w.T @ w
            yield pd.DataFrame({"i": np.arange(rank), "a": list(a), "b": list(b)})

        parts = held.select("v").mapInPandas(sums, "i int, a array<double>, b array<double>")
        # element-wise sums over the partitions' matrices, so the driver gets one
        cells = parts.select("i", F.posexplode(F.concat("a", "b")).alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
        both = np.zeros((rank, m + rank))
        both[cells["i"], cells["j"]] = cells["x"]
        a, b = both[:, :m], both[:, m:]
        new = basis.copy()
        for _ in range(20):
            new *= a / np.maximum(b @ new, 1e-12)
        done = np.abs(new - basis).max() < 1e-6 * max(np.abs(basis).max(), 1e-12)
        basis = new
        if done:
            break
    final = basis

    def solve(batches):
        for batch in batches:
            if len(batch):
                x = np.vstack(batch["v"])
                w = weights(x, final, 300)
                yield pd.DataFrame({key: batch[key], "weights": list(w), "__e": ((x - w @ final) ** 2).sum(1)})

    shape = data.select(key, F.col("v").alias("weights"), F.lit(0.0).alias("__e")).schema
    solved = data.mapInPandas(solve, shape)
    error = float(np.sqrt(solved.agg(F.sum("__e")).first()[0] or 0.0))
    data.unpersist()
    return solved.select(key, "weights"), basis, error


def nmf_errors(rows: DataFrame, key: str, values: str, ranks: list[int], rounds: int = 100, seed: int = 0) -> pd.DataFrame:
    """rank, error: the Frobenius error of a factorisation of each rank, to choose one by."""
    return pd.DataFrame([(r, nmf(rows, key, values, r, rounds, seed)[2]) for r in ranks], columns=["rank", "error"])


def power_clusters(similarities: DataFrame, k: int, seed_rounds: int = 20) -> DataFrame:
    """(id, cluster) by power iteration on a table of similarities (id1, id2, score), distributed."""
    model = PowerIterationClustering(k=k, maxIter=seed_rounds, srcCol="id1", dstCol="id2", weightCol="score")
    return model.assignClusters(similarities)


def pair_matrix(pairs: DataFrame, value: str, diagonal: float) -> tuple[list, np.ndarray]:
    """Ids and the full symmetric matrix of a half table (id1, id2, value), of at most MATRIX_IDS ids."""
    ids = [r[0] for r in pairs.select("id1").union(pairs.select("id2")).distinct().orderBy("id1").limit(MATRIX_IDS + 1).collect()]
    if len(ids) > MATRIX_IDS:
        raise ValueError(f"a pair matrix of over {MATRIX_IDS} ids; use power_clusters or kmeans")
    at = {x: i for i, x in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    rows = pairs.select("id1", "id2", value).toPandas()
    i, j = rows["id1"].map(at).to_numpy(int), rows["id2"].map(at).to_numpy(int)
    out[i, j] = out[j, i] = rows[value].to_numpy(float)
    np.fill_diagonal(out, diagonal)
    return ids, out


def _lloyd(x: np.ndarray, k: int, seed: int = 0, restarts: int = 10) -> np.ndarray:
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    for _ in range(restarts):
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            gap = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
            centres.append(x[rng.choice(len(x), p=gap / gap.sum())] if gap.sum() > 0 else x[rng.integers(len(x))])
        centres = np.array(centres)
        for _ in range(100):
            gap = ((x[:, None] - centres[None]) ** 2).sum(2)
            own = gap.argmin(1)
            new = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        cost = gap.min(1).sum()
        best = min(best, (cost, own), key=lambda b: b[0])
    return best[1]


def spectral(similarities: DataFrame, k: int, value: str = "score", seed: int = 0) -> pd.DataFrame:
    """id, cluster: leading eigenvectors of the normalised similarity matrix, scaled, then k-means; exact, bounded."""
    ids, s = pair_matrix(similarities, value, 1.0)
    d = 1 / np.sqrt(np.maximum(s.sum(1), 1e-12))
    _, vectors = np.linalg.eigh(d[:, None] * s * d[None])
    x = vectors[:, -k:] * d[:, None]
    return pd.DataFrame({"id": ids, "cluster": _lloyd(x / np.abs(x).max(), k, seed)})


def bisections(similarities: DataFrame, value: str = "score", least: int = 2, depth: int = 8) -> pd.DataFrame:
    """id, path: each id's way ("L" or "R" a level) through recursive spectral bisections, exact, bounded.

    A part of more than ``least`` ids is cut by the sign of its second eigenvector; the side of its first id is "L". A part
    that the sign leaves whole is not cut.
    """
    ids, s = pair_matrix(similarities, value, 1.0)
    path, open_ = [""] * len(ids), [np.arange(len(ids))]
    while open_:
        part = open_.pop()
        if len(part) <= max(least, 1) or len(path[part[0]]) >= depth:
            continue
        own = s[np.ix_(part, part)]
        d = 1 / np.sqrt(np.maximum(own.sum(1), 1e-12))
        second = np.linalg.eigh(d[:, None] * own * d[None])[1][:, -2]
        right = (second >= 0) != (second[0] >= 0)
        if right.any():
            for side, mark in ((part[~right], "L"), (part[right], "R")):
                open_.append(side)
                for i in side:
                    path[i] += mark
    return pd.DataFrame({"id": ids, "path": path})


def leading_vectors(pairs: DataFrame, value: str, k: int, diagonal: float = 1.0, restarts: int = 8, tolerance: float = 1e-9, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(id, root, vector) and the ``k`` largest eigenvalues of the normalised matrix of a half table (id1, id2, value).

    The matrix is divided by the roots of its row sums on both sides, so its eigenvalues are at most 1. Block Krylov
    subspaces: the table of pairs meets a table of a few vectors by a join on the id, and sums by row make the next block;
    after ``POWER`` products the best vectors of all blocks together come from their Gram matrix, which alone is brought to
    the driver, and begin the next subspace. So the number of ids is free. Each product is written. Signs are such that each
    vector's entry of largest size is positive.
    """
    spark = pairs.sparkSession
    state, kept = Settled(spark, "krylov"), Settled(spark, "pairs")
    half = kept.keep(pairs.select("id1", "id2", F.col(value).alias("s")))
    both = half.union(half.select("id2", "id1", "s"))
    roots = kept.keep(both.groupBy(F.col("id1").alias("id")).agg(F.sqrt(F.sum("s") + F.lit(diagonal)).alias("root")))
    weighed = both.join(roots.withColumnRenamed("id", "id1").withColumnRenamed("root", "r1"), "id1").join(roots.withColumnRenamed("id", "id2").withColumnRenamed("root", "r2"), "id2")
    matrix = weighed.select("id1", "id2", (F.col("s") / F.col("r1") / F.col("r2")).alias("s"))
    matrix = kept.keep(matrix.union(roots.select("id", "id", F.lit(diagonal) / F.col("root") ** 2)))
    width = k + 2

    def extended(basis: DataFrame) -> DataFrame:
        """The basis (id, v) with the product of its last block after it."""
        last = basis.select(F.col("id").alias("id2"), F.slice("v", F.size("v") - width + 1, F.lit(width)).alias("x"))
        image = matrix.join(last, "id2").groupBy(F.col("id1").alias("id")).agg(F.array(*(F.sum(F.col("s") * F.col("x")[i]) for i in range(width))).alias("w"))
        return basis.join(image, "id").select("id", F.concat("v", "w").alias("v"))

    def gram(basis: DataFrame, n: int) -> np.ndarray:
        outer = F.flatten(F.transform("v", lambda x: F.transform("v", lambda y: x * y)))
        return np.array(basis.agg(vector_to_array(Summarizer.sum(array_to_vector(outer))).alias("g")).first()["g"]).reshape(n, n)

    def turned(by: np.ndarray) -> Column:
        row = lambda column: F.aggregate(F.zip_with(F.slice("v", 1, len(column)), F.array(*(F.lit(float(x)) for x in column)), lambda a, c: a * c), F.lit(0.0), lambda total, x: total + x)
        return F.array(*(row(by[:, j]) for j in range(by.shape[1])))

    def wave(i: int) -> Column:
        return F.xxhash64("id", F.lit(seed * 1000 + i)) / F.lit(float(1 << 63))

    # the first vector is known: the roots
    block = roots.select("id", F.array(F.col("root"), *(wave(i) for i in range(1, width))).alias("v"))
    before = np.zeros(k)
    for _ in range(restarts):
        basis = state.put(block)
        for _ in range(POWER):
            basis = state.put(extended(basis))
        size = width * POWER
        whole = gram(basis, size + width)
        inner, image = whole[:size, :size], whole[:size, width:]
        scale = 1 / np.sqrt(np.maximum(np.diag(inner), 1e-300))
        spread, axes = np.linalg.eigh(inner * scale[:, None] * scale)
        good = spread > spread[-1] * 1e-12
        by = scale[:, None] * axes[:, good] / np.sqrt(spread[good])
        small = by.T @ ((image + image.T) / 2) @ by
        values, vectors = np.linalg.eigh(small)
        order = np.argsort(-values)[:width]
        block = basis.select("id", F.concat(turned(by @ vectors[:, order]), F.array(*(wave(100 + i) for i in range(width - len(order)))) if len(order) < width else F.array().cast("array<double>")).alias("v"))
        now = values[order][:k]
        if len(now) == k and np.abs(now - before[: len(now)]).max() < tolerance:
            break
        before = np.r_[now, np.zeros(k - len(now))]
    found = state.put(block)
    largest = found.agg(*(F.max_by(F.col("v")[i], F.abs(F.col("v")[i])).alias(f"x{i}") for i in range(k))).first()
    vector = F.array(*(F.col("v")[i] * F.lit(1.0 if (largest[i] or 0) >= 0 else -1.0) for i in range(k)))
    return state.close(found).join(roots, "id").select("id", "root", vector.alias("vector")), [float(x) for x in now]


def spectral_clusters(similarities: DataFrame, k: int, value: str = "score", seed: int = 0) -> DataFrame:
    """(id, cluster): k-means of the leading eigenvectors, scaled by the roots; distributed, for any number of ids."""
    vectors, _ = leading_vectors(similarities, value, k)
    rows = vectors.select("id", F.transform("vector", lambda x: x / F.col("root")).alias("x"))
    return kmeans(rows, "id", "x", k, seed)


def diffusion_coordinates(distances: DataFrame, value: str, epsilon: float, dims: int = 2, steps: float = 1.0) -> DataFrame:
    """(id, coordinates): as ``diffusion_map``, distributed, for any number of ids; signs as ``leading_vectors`` gives them."""
    kernel = distances.select("id1", "id2", F.exp(-F.col(value) * F.col(value) / (2 * epsilon)).alias("s"))
    vectors, values = leading_vectors(kernel, "s", dims)
    scale = F.array(*(F.lit(max(v, 0.0) ** (epsilon * steps)) for v in values))
    return vectors.select("id", F.zip_with("vector", scale, lambda x, y: x / F.col("root") * y).alias("coordinates"))


def diffusion_map(distances: DataFrame, value: str, epsilon: float, dims: int = 2, steps: float = 1.0) -> pd.DataFrame:
    """id, coordinates: leading eigenvectors of the random walk on exp(-d^2 / (2 epsilon)), the constant one first."""
    ids, d = pair_matrix(distances, value, 0.0)
    kernel = np.exp(-(d**2) / (2 * epsilon))
    root = np.sqrt(kernel.sum(1))
    values, vectors = np.linalg.eigh(kernel / root[:, None] / root[None])
    order = np.argsort(-values)[:dims]
    return pd.DataFrame({"id": ids, "coordinates": list(vectors[:, order] / root[:, None] * np.maximum(values[order], 0.0) ** (epsilon * steps))})


def average_linkage(distances: DataFrame, value: str, threshold: float | None = None) -> tuple[pd.DataFrame, list[tuple]]:
    """id, cluster at a distance threshold, and the merges (a, b, height, size) of average linkage, in order."""
    ids, d = pair_matrix(distances, value, np.inf)
    n = len(ids)
    size, name, d = np.ones(n), list(range(n)), d.copy()
    owner, merges, alive = np.arange(n), [], np.ones(n, bool)
    groups = {i: [i] for i in range(n)}
    for step in range(n - 1):
        flat = np.where(alive[:, None] & alive[None], d, np.inf)
        i, j = np.unravel_index(flat.argmin(), flat.shape)
        i, j = min(i, j), max(i, j)
        height = flat[i, j]
        merges.append((name[i], name[j], float(height), int(size[i] + size[j])))
        if threshold is None or height <= threshold:
            groups[i] += groups.pop(j, [])
            owner[groups[i]] = i
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i], alive[j], size[i], name[i] = np.inf, False, size[i] + size[j], n + step
    return pd.DataFrame({"id": ids, "cluster": np.unique(owner, return_inverse=True)[1]}), merges


def descendants(tree: DataFrame, root: str | int, hops: int = 3) -> DataFrame:
    """(node): every node below a node of a table (parent, child), once each, whatever the depth.

    A round goes ``hops`` levels down from the nodes that the round before met first, and leaves out those met before, so
    cycles end (a node on a cycle is below itself) and a round costs what it meets. Each round's nodes are written.
    """
    spark = tree.sparkSession
    edges = tree.select(F.col("parent").alias("__p"), F.col("child").alias("node")).where("__p IS NOT NULL AND node IS NOT NULL")
    folder, number = passing_folder(spark, "below"), 0
    schema = edges.select("node").schema
    front = edges.where(F.col("__p") == F.lit(root)).select("node").distinct()
    while True:
        path = f"{folder}/{number}"
        front.write.parquet(path)
        front = spark.read.schema(schema).parquet(path)
        number += 1
        met = spark.read.schema(schema).parquet(*(f"{folder}/{i}" for i in range(number)))
        if front.isEmpty():
            return met
        reached, level = None, front
        for _ in range(hops):
            level = edges.join(level.withColumnRenamed("node", "__p"), "__p").select("node").distinct()
            reached = level if reached is None else reached.union(level)
        front = reached.distinct().join(met, "node", "left_anti")


def tsne(distances: DataFrame, value: str, perplexity: float = 30.0, rounds: int = 500, seed: int = 0) -> pd.DataFrame:
    """id, x, y: t-distributed embedding of a distance table."""
    ids, d = pair_matrix(distances, value, 0.0)
    n = len(ids)
    target, p = np.log(min(perplexity, max(1.0, (n - 1) / 3))), np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            w = np.exp(-(d[i] ** 2) * beta)
            w[i] = 0
            s = max(w.sum(), 1e-300)
            h = np.log(s) + beta * (w * d[i] ** 2).sum() / s
            if abs(h - target) < 1e-5:
                break
            lo, hi = (beta, hi) if h > target else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i] = w / s
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(size=(n, 2)) * 1e-4
    speed = np.zeros_like(y)
    for step in range(rounds):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(q, 0)
        grad = 4 * (((p * (12 if step < 100 else 1) - np.maximum(q / q.sum(), 1e-12)) * q)[:, :, None] * (y[:, None] - y[None])).sum(1)
        speed = (0.5 if step < 100 else 0.8) * speed - max(n / 12, 50.0) * grad
        y = y + speed
    return pd.DataFrame({"id": ids, "x": y[:, 0], "y": y[:, 1]})


def natural_breaks(values: np.ndarray, classes: int, counts: np.ndarray | None = None) -> list[float]:
    """Upper ends of the ``classes`` runs of sorted values with the least sum of squares within runs.

    ``counts`` says how often each value stands there; equal values are one. The best cut of a longer prefix never lies
    before that of a shorter one, so each layer of the recurrence is solved by halves, in O(n log n).
    """
    x, back = np.unique(np.asarray(values, float), return_inverse=True)
    c = np.bincount(back, weights=None if counts is None else np.asarray(counts, float), minlength=len(x)).astype(float)
    n = len(x)
    classes = min(classes, n)
    shifted = x - (c * x).sum() / c.sum() if n else x
    s0, s1, s2 = (np.r_[0, np.cumsum(v)] for v in (c, c * shifted, c * shifted * shifted))
    best, cuts = np.r_[0.0, np.full(n, np.inf)], []
    for k in range(1, classes + 1):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        open_ = [(k, n, k - 1, n - 1)]
        while open_:
            low, high, first, last = open_.pop()
            if low > high:
                continue
            end = (low + high) // 2
            start = np.arange(first, min(last, end - 1) + 1)
            total = best[start] + s2[end] - s2[start] - (s1[end] - s1[start]) ** 2 / (s0[end] - s0[start])
            i = int(total.argmin())
            now[end], cut[end] = total[i], start[i]
            open_ += [(low, end - 1, first, int(start[i])), (end + 1, high, int(start[i]), last)]
        best = now
        cuts.append(cut)
    ends, at = [], n
    for cut in reversed(cuts):
        ends.append(float(x[at - 1]))
        at = cut[at]
    return ends[::-1]


def breaks_by(rows: DataFrame, group: list[str], value: str, classes: int) -> DataFrame:
    """(group, breaks, within): the natural breaks of each group's values and the sum of squares within the classes.

    What meets in a task is the different values of one group, with how often each stands there.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    shape = counts.select(*group, F.array("v").alias("breaks"), F.col("v").alias("within")).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v, n = part["v"].to_numpy(float), part["n"].to_numpy(float)
        ends = natural_breaks(v, classes, n)
        own = np.searchsorted(ends, v)
        within = sum((n[own == i] * (v[own == i] - np.average(v[own == i], weights=n[own == i])) ** 2).sum() for i in set(own))
        return part[group].head(1).assign(breaks=[ends], within=float(within))

    return counts.groupBy(*group).applyInPandas(run, shape)
