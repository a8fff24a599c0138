"""Simulations and iterative estimates: every group or replica is a task's row range with a seed of its own."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import pieces, reverse_complement, words

def deconvolve(rows: DataFrame, key: str, kernel: dict[str, dict[int, float]], ratio: float = 1.0, noise: float = 1e-6, rounds: int = 200, tolerance: float = 1e-3) -> DataFrame:
    """(key, dyad): centres under Poisson cuts, by the multiplicative expectation-maximisation update.

    ``rows`` has (key, top, bottom); ``kernel`` gives, for "R" and "L", the share of cuts at each offset from a centre.
    Terms beyond the ends are 0. A key is one template, so its iteration is local.
    """
    shape = rows.select(key, F.col("top").alias("dyad")).schema

    def run(batches):
        for batch in batches:
            out = []
            for top, bottom in zip(batch["top"], batch["bottom"], strict=True):
                cut = {"R": np.asarray(top, float), "L": np.asarray(bottom, float)}
                n = len(cut["R"])
                mats = {s: sum((w * np.eye(n, k=-o) for o, w in kernel[s].items()), np.zeros((n, n))) for s in "RL"}
                now = {"R": np.ones(n), "L": np.ones(n)}
                for _ in range(rounds):
                    factor = sum(a * (mats[s].T @ (cut[s] / (mats[s] @ now[s] + noise))) for s, a in (("R", 1.0), ("L", ratio))) / (1 + ratio)
                    right = now["R"] * factor
                    new = {"R": right, "L": right * ratio}
                    a, b = (x / max(x.sum(), 1e-300) for x in (now["R"] + now["L"], new["R"] + new["L"]))
                    now = new
                    if math.sqrt(((a - b) ** 2).sum()) < tolerance:
                        break
                out.append(((now["R"] + now["L"]) / 2).tolist())
            yield pd.DataFrame({key: batch[key], "dyad": out})

    return rows.mapInPandas(run, shape)


def steady_path(p: np.ndarray, edges: np.ndarray, cost: np.ndarray, gamma: float, tolerance: float = 1e-9, rounds: int = 2_000) -> tuple[np.ndarray, float]:
    """Joint transition probabilities of maximum path entropy with stationary distribution ``p``, and their mean cost.

    Sinkhorn scaling of edges * exp(-gamma * cost) to row and column sums ``p``.
    """
    w = edges * np.exp(-gamma * cost)
    right = np.ones(len(p))
    for _ in range(rounds):
        left = p / (w @ right)
        new = p / (w.T @ left)
        done = np.sqrt((((right - new) / right) ** 2).sum()) < tolerance
        right = new
        if done:
            break
    joint = left[:, None] * w * right[None]
    return joint, float((joint * cost).sum())


def equilibrium_path(p: np.ndarray, edges: np.ndarray, cost: np.ndarray, gamma: float) -> tuple[np.ndarray, float]:
    """As steady_path, with detailed balance: the cost and the scaling are symmetric."""
    return steady_path(p, (edges + edges.T) / 2, (cost + cost.T) / 2, gamma)


def driven_path(p: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The transition matrix nearest in path entropy to ``transitions`` with the stationary distribution ``p``.

    Carries an equilibrium walk to a steady state of another distribution, in or out of equilibrium.
    """
    joint, _ = steady_path(p, transitions, np.zeros_like(transitions), 0.0, 1e-12)
    return joint / p[:, None]


def maximum_caliber(rows: DataFrame, key: str, values: str, target: float | None = None, reach: int = 1, equilibrium: bool = True, gammas: np.ndarray | None = None) -> DataFrame:
    """(key, gamma, mean_cost, error, transitions): each id's signal as the stationary distribution of a walk of steps up to
    ``reach``; ``error`` is the largest gap between the walk's distribution and the signal's, small where scaling converged.

    With ``target``, the gamma of the grid whose mean squared step is nearest to it; else gamma is 0.
    """
    grid = np.linspace(0, 100, 1000) if gammas is None else gammas
    shape = rows.select(key, F.lit(0.0).alias("gamma"), F.lit(0.0).alias("mean_cost"), F.lit(0.0).alias("error"), F.array(F.array(F.lit(0.0))).alias("transitions")).schema

    def run(batches):
        for batch in batches:
            out = []
            for k, v in zip(batch[key], batch[values], strict=True):
                p = np.asarray(v, float) + 1e-12
                p = p / p.sum()
                gap = np.abs(np.arange(len(p))[:, None] - np.arange(len(p))[None])
                edges, cost = (gap <= reach).astype(float), gap.astype(float) ** 2
                solve = equilibrium_path if equilibrium else steady_path
                gamma = 0.0
                if target is not None:
                    lo, hi = 0, len(grid) - 1
                    while lo < hi:  # the mean cost falls as gamma grows
                        mid = (lo + hi) // 2
                        lo, hi = (lo, mid) if solve(p, edges, cost, grid[mid])[1] <= target else (mid + 1, hi)
                    near = [grid[i] for i in (max(lo - 1, 0), lo)]
                    gamma = float(min(near, key=lambda g: abs(solve(p, edges, cost, g)[1] - target)))
                joint, mean = solve(p, edges, cost, gamma)
                error = float(max(np.abs(joint.sum(0) - p).max(), np.abs(joint.sum(1) - p).max()))
                out.append((k, gamma, mean, error, (joint / p[:, None]).tolist()))
            yield pd.DataFrame(out, columns=[key, "gamma", "mean_cost", "error", "transitions"])

    return rows.mapInPandas(run, shape)


def driven(rows: DataFrame, key: str, values: str, reach: int = 1) -> DataFrame:
    """(key, transitions): each id's walk of even steps up to ``reach``, carried to its signal as the stationary distribution."""
    shape = rows.select(key, F.array(F.array(F.lit(0.0))).alias("transitions")).schema

    def run(batches):
        for batch in batches:
            out = []
            for v in batch[values]:
                p = np.asarray(v, float) + 1e-12
                gap = np.abs(np.arange(len(p))[:, None] - np.arange(len(p))[None])
                near = (gap <= reach).astype(float)
                out.append(driven_path(p / p.sum(), near / near.sum(1, keepdims=True)).tolist())
            yield pd.DataFrame({key: batch[key], "transitions": out})

    return rows.mapInPandas(run, shape)


def uniform_rates(states: int, rate: float, periodic: bool = False) -> np.ndarray:
    """Rates to the two neighbours; at the ends to one, or round."""
    out = rate * (np.eye(states, k=1) + np.eye(states, k=-1))
    if periodic and states > 1:
        out[0, -1] = out[-1, 0] = rate
    return out


def energy_rates(energy: np.ndarray, diffusion: float) -> np.ndarray:
    """Neighbour rates diffusion * exp((E(from) - E(to)) / 2)."""
    e = np.asarray(energy, float)
    near = np.eye(len(e), k=1) + np.eye(len(e), k=-1)
    return diffusion * near * np.exp(0.5 * (e[:, None] - e[None]))


def perturbed_rates(rates: np.ndarray, sites: list[int], offsets: tuple[int, ...] = (19, 20, 21), scale: float = 0.1) -> np.ndarray:
    """Steps towards a site slowed at some offsets on either side of it."""
    out, n = rates.copy(), len(rates)
    for s in sites:
        for o in offsets:
            if 0 < s + o < n:
                out[s + o, s + o - 1] *= scale
            if 0 <= s - o < n - 1:
                out[s - o, s - o + 1] *= scale
    return out


def kinetic_traces(spark: SparkSession, rates: np.ndarray, replicas: int, until: float, start: int = 0, seed: int = 0) -> DataFrame:
    """(replica, step, time, state): Gillespie walks, each replica seeded by its number."""
    table = rates.tolist()

    def run(batches):
        r = np.array(table)
        total = r.sum(1)
        cumulative = np.cumsum(r, 1)
        for batch in batches:
            for replica in batch["replica"]:
                rng = np.random.default_rng([seed, int(replica)])
                rows, state, time, step = [(replica, 0, 0.0, start)], start, 0.0, 0
                while total[state] > 0:
                    time += rng.exponential(1 / total[state])
                    if time >= until:
                        break
                    state = int(np.searchsorted(cumulative[state], rng.random() * total[state], side="right"))
                    step += 1
                    rows.append((replica, step, time, state))
                yield pd.DataFrame(rows, columns=["replica", "step", "time", "state"])

    return spark.range(replicas).select(F.col("id").alias("replica")).mapInPandas(run, "replica bigint, step bigint, time double, state int")


def energy_walks(rows: DataFrame, key: str, energy: str, replicas: int, until: float, diffusion: float = 1.0, seed: int = 0) -> DataFrame:
    """(key, replica, step, time, state): walks of several replicas on each id's energy profile, from its lowest place.

    A replica is a row of its own, seeded by the id and its number, so the replicas of one id spread over tasks.
    """
    shape = rows.select(key, F.lit(0).cast("int").alias("replica"), F.lit(0).cast("bigint").alias("step"), F.lit(0.0).alias("time"), F.lit(0).alias("state")).schema
    spread = rows.select(key, energy).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))

    def run(batches):
        for batch in batches:
            for k, e, replica in zip(batch[key], batch[energy], batch["replica"], strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode()), int(replica)])
                path = walk(energy_rates(np.asarray(e, float), diffusion), until, int(np.argmin(e)), rng)
                yield pd.DataFrame({key: k, "replica": replica, "step": np.arange(len(path)), "time": [t for t, _ in path], "state": [s for _, s in path]})

    return spread.mapInPandas(run, shape)


def walk(rates: np.ndarray, until: float, start: int, rng: np.random.Generator) -> list[tuple[float, int]]:
    """(time, state) of each step of one Gillespie walk."""
    total, cumulative = rates.sum(1), np.cumsum(rates, 1)
    path, state, time = [(0.0, start)], start, 0.0
    while total[state] > 0:
        time += rng.exponential(1 / total[state])
        if time >= until:
            break
        state = int(np.searchsorted(cumulative[state], rng.random() * total[state], side="right"))
        path.append((time, state))
    return path


def drawn_cuts(rows: DataFrame, key: str, means: str, offset: int, top_share: float = 0.5, seed: int = 0) -> DataFrame:
    """(key, top, bottom, dyad): Poisson centres of each id's expected signal, and the cuts they make on either strand."""
    numbers = F.array(F.lit(0.0))
    shape = rows.select(key, numbers.alias("top"), numbers.alias("bottom"), numbers.alias("dyad")).schema

    def run(batches):
        for batch in batches:
            out = []
            for k, mean in zip(batch[key], batch[means], strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
                dyad = rng.poisson(np.asarray(mean, float))
                right, n = rng.binomial(dyad, top_share), len(dyad)
                top, bottom = np.zeros(n), np.zeros(n)
                top[: max(n - offset, 0)] = right[offset:]
                bottom[offset:] = (dyad - right)[: max(n - offset, 0)]
                out.append((k, top.tolist(), bottom.tolist(), dyad.astype(float).tolist()))
            yield pd.DataFrame(out, columns=[key, "top", "bottom", "dyad"])

    return rows.mapInPandas(run, shape)


def markov_traces(spark: SparkSession, transitions: np.ndarray, replicas: int, steps: int, start: int = 0, seed: int = 0) -> DataFrame:
    """(replica, step, state): a discrete chain."""
    table = np.cumsum(transitions, 1).tolist()

    def run(batches):
        c = np.array(table)
        for batch in batches:
            for replica in batch["replica"]:
                rng, path = np.random.default_rng([seed, int(replica)]), [start]
                for _ in range(steps):
                    path.append(int(min(np.searchsorted(c[path[-1]], rng.random(), side="right"), len(c) - 1)))
                yield pd.DataFrame({"replica": replica, "step": np.arange(steps + 1), "state": path})

    return spark.range(replicas).select(F.col("id").alias("replica")).mapInPandas(run, "replica bigint, step bigint, state int")


def ratio_prior(x: float, a: float, b: int, terms: int = 2000) -> float:
    """Density of the ratio of two independent Kumaraswamy(a, b) variables, by quadrature of its defining integral."""
    u = (np.arange(terms) + 0.5) / terms
    top = min(1.0, 1.0 / x)
    y = u * top
    f = lambda t: a * b * t ** (a - 1) * (1 - t**a) ** (b - 1)
    return float((y * f(y) * f(np.clip(x * y, 0, 1))).mean() * top)


SHAPES = {
    "rect": lambda x, c, w: (np.abs(x - c) <= w / 2).astype(float),
    "tri": lambda x, c, w: np.maximum(1 - np.abs(x - c) / (w / 2), 0.0),
    "gauss": lambda x, c, w: np.exp(-0.5 * ((x - c) / (w / 4)) ** 2),
}


def simulated_counts(spark: SparkSession, ids: int, length: int = 225, offset: int = 53, shape: str = "gauss", centres: tuple[int, ...] = (112,), width: int = 20, depth: float = 100.0, top_share: float = 0.5, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, top, bottom, dyad): Poisson cuts of known centres, each id seeded by its number."""
    x = np.arange(length)

    def run(batches):
        for batch in batches:
            rows = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                mean = rng.random(length) if shape == "random" else sum(SHAPES[shape](x, c, width) for c in centres)
                dyad = rng.poisson(depth * mean)
                top, bottom = rng.poisson(noise, length).astype(float), rng.poisson(noise, length).astype(float)
                right = rng.binomial(dyad, top_share)
                for p in np.flatnonzero(dyad):
                    if p - offset >= 0:
                        top[p - offset] += right[p]
                    if p + offset < length:
                        bottom[p + offset] += dyad[p] - right[p]
                rows.append((i, top.tolist(), bottom.tolist(), dyad.astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["id", "top", "bottom", "dyad"])

    return spark.range(ids).mapInPandas(run, "id bigint, top array<double>, bottom array<double>, dyad array<double>")


def simulated_reads(refs: DataFrame, per_ref: int, offset: int = 53, left: float = 0.8, right: float = 0.8, mismatch: float = 0.0, indel: float = 0.0, seed: int = 0) -> DataFrame:
    """(read_id, seq, qual) of cut templates, with letters changed, and dropped or doubled, at two rates; the name ends in /<ref_id>/<cut>, the truth. Seeded by id and number."""
    def run(batches):
        for batch in batches:
            rows = []
            for ref, seq in zip(batch["ref_id"], batch["seq"], strict=True):
                rng = np.random.default_rng([seed, *str(ref).encode()])
                for k in range(per_ref):
                    dyad = int(rng.integers(offset, max(len(seq) - offset, offset + 1)))
                    cut_left, cut_right = rng.random() < left, rng.random() < right
                    if cut_left:
                        piece, cut = seq[: min(dyad + offset, len(seq))], f"L:{dyad + offset}"
                    elif cut_right:
                        piece, cut = seq[max(dyad - offset + 1, 0) :], f"R:{dyad - offset}"
                    else:
                        piece, cut = seq, "NA"
                    letters = list(piece)
                    for i in np.flatnonzero(rng.random(len(letters)) < mismatch):
                        letters[i] = rng.choice([c for c in "ACGT" if c != letters[i]])
                    for i in np.flatnonzero(rng.random(len(letters)) < indel) if indel else ():
                        letters[i] = "" if rng.random() < 0.5 else letters[i] + rng.choice(list("ACGT"))
                    made = "".join(letters)
                    rows.append((f"sim:{k}/{ref}/{cut}", made, "G" * len(made)))
            yield pd.DataFrame(rows, columns=["read_id", "seq", "qual"])

    return refs.select("ref_id", "seq").mapInPandas(run, "read_id string, seq string, qual string")


def scanning_library(refs: DataFrame, sizes: list[int], kind: str = "M", letter: str | None = None) -> DataFrame:
    """(ref_id, seq): every window of each size replaced (M: complement, or a letter), deleted (D) or doubled (I); no doubles."""
    n = F.length("seq")
    rows = refs.select("seq", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(n > F.col("size"))
    rows = rows.withColumn("loc", F.explode(F.sequence(F.lit(0), n - F.col("size"))))
    head, span, tail = F.substring("seq", F.lit(1), F.col("loc")), F.substring("seq", F.col("loc") + 1, F.col("size")), F.substring("seq", F.col("loc") + F.col("size") + 1, n)
    new = F.repeat(F.lit(letter), F.col("size")) if letter else F.translate(F.upper(span), "ACGT", "TGCA")
    nts = {"M": new, "D": span, "I": new}[kind]
    seq = {"M": F.concat(head, new, tail), "D": F.concat(head, tail), "I": F.concat(head, span, new, tail)}[kind]
    made = rows.select(F.concat_ws("-", F.col("loc").cast("string"), F.lit(kind), nts).alias("ref_id"), seq.alias("seq"), "loc")
    return made.groupBy("seq").agg(F.min_by("ref_id", F.struct("loc", "ref_id")).alias("ref_id")).select("ref_id", "seq")


def insert_words(spark: SparkSession, k: int, letters: str = "ATCG") -> DataFrame:
    """(word) the first word, in the order of ``letters``, of each class of words with the same steps on either strand."""
    every = words(spark, k, letters).withColumn("__o", F.translate("kmer", letters, "0123456789"[: len(letters)]))
    kind = F.array_join(F.transform(pieces(F.col("kmer"), 2), lambda x: F.least(x, reverse_complement(x))), " ")
    return every.groupBy(kind.alias("__k")).agg(F.min_by("kmer", "__o").alias("word"), F.min("__o").alias("__o")).select("word", "__o")


def kmer_library(refs: DataFrame, k: int, step: int = 5, left: str = "", right: str = "") -> DataFrame:
    """(ref_id, seq): each insert word of length k in place of the reference's letters at every ``step``-th place, no doubles."""
    spots = refs.where(F.length("seq") >= k).select("seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(step))).alias("loc"))
    made = spots.crossJoin(F.broadcast(insert_words(refs.sparkSession, k)))  # 4^k words at most
    seq = F.concat(F.lit(left), F.substring("seq", F.lit(1), F.col("loc")), "word", F.substring("seq", F.col("loc") + k + 1, F.length("seq")), F.lit(right))
    rows = made.select(F.concat_ws("-", "word", (F.col("loc") + len(left)).cast("string")).alias("ref_id"), seq.alias("seq"), "__o", "loc")
    return rows.groupBy("seq").agg(F.min_by("ref_id", F.struct("__o", "loc")).alias("ref_id")).select("ref_id", "seq")


def reduced_library(library: DataFrame) -> DataFrame:
    """One of each pair of reverse complements, the smaller sequence."""
    back = F.reverse(F.translate("seq", "ACGT", "TGCA"))
    return library.withColumn("__c", F.least("seq", back)).groupBy("__c").agg(F.min_by("ref_id", "seq").alias("ref_id"), F.min("seq").alias("seq")).drop("__c")


def chosen_library(sites: DataFrame, allowed: DataFrame, first: int = 600, keep: int = 500, left: str = "", right: str = "") -> DataFrame:
    """The ``keep`` best of the ``first`` best sites (score, snr) whose sequence is allowed, with adapters."""
    best = sites.orderBy(F.desc("score"), F.desc("snr"), "seq").limit(first).join(allowed.select("seq").distinct(), "seq", "left_semi")
    return best.orderBy(F.desc("score"), F.desc("snr"), "seq").limit(keep).withColumn("seq", F.concat(F.lit(left), "seq", F.lit(right)))
