"""Bayesian imputation: a Gibbs sampler whose rows are distributed and whose group parameters are small sums.

Model, for a centre i of an id j in a group: the top strand's cuts are Poisson with mean D[j,i] r[i] + l[i], the bottom
strand's with mean D[j,i] (1 - r[i]) - l[i]; D is gamma with the mean of a first imputation (lines, or naive) and its
variance along the id; r is beta, l is normal around 0 with a deviation from the group's lowest natural class of counts.

An id's centres and missing cuts depend on no other id once r and l are given, and r and l depend on the ids through their
log likelihood alone. So a round is: each task takes its rows through some sweeps of Metropolis-Hastings steps for D and
Poisson draws for the missing cuts, then sums the log likelihood of its rows over a grid of (r, l) for each centre; the
sums of a group, added up by Spark, are all that the Metropolis-Hastings steps for r and l need (they walk the
interpolated grid). A row's draws are seeded by its key and the round, so they don't depend on where it lies.

Medians over the sweeps are kept as five markers a cell (the P-square estimate), so neither a row nor a task grows with the
number of sweeps, and no task holds a group. Each round is written in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.matrices import natural_breaks
from ..sources.memo import Settled
from .impute import linear, naive

RATIOS, NOISES = 17, 9
#: Least mean of a centre and least rate of a strand, which keep logarithms finite.
LEAST_DYAD, LEAST_RATE = 0.5, 1e-3
MARKS = np.array([0.0, 0.25, 0.5, 0.75, 1.0])
#: Groups whose sums a task adds up before it passes them on.
HELD_GROUPS = 64
#: Rows that make a task of their own worth while, and the number of tasks from which they get more rows instead.
ROWS_A_TASK, MOST_TASKS = 128, 512


def median_marks(heights: np.ndarray, places: np.ndarray, n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five markers of each cell after its ``n``-th value ``x`` (n from 1): heights and places, shape (5, cells)."""
    if n <= 5:
        heights[n - 1] = x
        if n == 5:
            heights.sort(axis=0)
            places[:] = np.arange(1.0, 6.0).reshape(5, *[1] * (places.ndim - 1))
        return heights, places
    heights[0], heights[4] = np.minimum(heights[0], x), np.maximum(heights[4], x)
    places[1:4] += x < heights[1:4]
    places[4] += 1
    for i in (1, 2, 3):
        d = 1 + (n - 1) * MARKS[i] - places[i]
        up, down = places[i + 1] - places[i], places[i - 1] - places[i]
        step = np.where((d >= 1) & (up > 1), 1.0, np.where((d <= -1) & (down < -1), -1.0, 0.0))
        rise, fall = (heights[i + 1] - heights[i]) / up, (heights[i - 1] - heights[i]) / down
        curve = heights[i] + step / (up - down) * ((step - down) * rise + (up - step) * fall)
        good = (heights[i - 1] < curve) & (curve < heights[i + 1])
        straight = heights[i] + step * np.where(step > 0, rise, fall)
        heights[i] = np.where(step == 0, heights[i], np.where(good, curve, straight))
        places[i] += step
    return heights, places


def median_of(heights: np.ndarray, n: int) -> np.ndarray:
    return heights[2] if n >= 5 else np.median(heights[: max(n, 1)], axis=0)


def _rates(d: np.ndarray, r: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(d * r + noise, LEAST_RATE), np.maximum(d * (1 - r) - noise, LEAST_RATE)


def _log_likelihood(t: np.ndarray, b: np.ndarray, d: np.ndarray, r: np.ndarray, noise: np.ndarray) -> np.ndarray:
    top, bottom = _rates(d, r, noise)
    return t * np.log(top) + b * np.log(bottom) - top - bottom


def grid(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    return (np.arange(RATIOS) + 0.5) / RATIOS, np.linspace(-3 * sigma, 3 * sigma, NOISES)


def profile(t: np.ndarray, b: np.ndarray, d: np.ndarray, sigma: float) -> np.ndarray:
    """Sums over the rows of the log likelihood, at each centre and point of the grid: (centres, ratios x noises).

    A logarithm counts only where its strand has cuts, so it is taken there alone.
    """
    ratios, noises = grid(sigma)
    out = np.empty((t.shape[1], len(ratios) * len(noises)))
    rate = np.empty(d.shape)
    strands = [(x[where], d[where], where[1]) for x in (t, b) for where in [np.nonzero(x)]]
    for i, r in enumerate(ratios):
        means = [d * q for q in (r, 1 - r)]
        seen = [own * q for (_, own, _), q in zip(strands, (r, 1 - r), strict=True)]
        for j, noise in enumerate(noises):
            sums = np.zeros(t.shape[1])
            for mean, own, sign, (n, _, centre) in zip(means, seen, (1, -1), strands, strict=True):
                np.add(mean, sign * noise, out=rate)
                sums -= np.maximum(rate, LEAST_RATE, out=rate).sum(axis=0)
                sums += np.bincount(centre, n * np.log(np.maximum(own + sign * noise, LEAST_RATE)), len(sums))
            out[:, i * len(noises) + j] = sums
    return out


def walk_parameters(sums: np.ndarray, ratio: np.ndarray, noise: np.ndarray, sigma: float, rng: np.random.Generator, steps: int, prior: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Metropolis-Hastings steps for the ratio and noise of each centre, on the interpolated sums."""
    table = sums.reshape(len(ratio), RATIOS, NOISES)
    at = np.arange(len(ratio))

    def density(r: np.ndarray, noise: np.ndarray) -> np.ndarray:
        u = np.clip(r * RATIOS - 0.5, 0, RATIOS - 1.000001)
        v = np.clip((noise / (6 * sigma) + 0.5) * (NOISES - 1), 0, NOISES - 1.000001)
        i, j = u.astype(int), v.astype(int)
        p, q = u - i, v - j
        value = (1 - p) * ((1 - q) * table[at, i, j] + q * table[at, i, j + 1]) + p * ((1 - q) * table[at, i + 1, j] + q * table[at, i + 1, j + 1])
        return value + (prior - 1) * (np.log(r) + np.log1p(-r)) - 0.5 * (noise / sigma) ** 2

    wide = np.sqrt(prior * prior / ((2 * prior) ** 2 * (2 * prior + 1)))
    now = density(ratio, noise)
    for step in range(steps):
        # wide and narrow proposals in turn: the likelihood of many ids is far narrower than the prior
        size = (1.0, 0.2, 0.04)[step % 3]
        r, l = ratio + rng.normal(0, wide * size, len(ratio)), noise + rng.normal(0, sigma * size, len(noise))
        inside = (r > 0) & (r < 1) & (np.abs(l) < 3 * sigma)
        new = density(np.where(inside, r, 0.5), np.where(inside, l, 0.0))
        taken = inside & (np.log(rng.uniform(size=len(ratio))) < new - now)
        ratio, noise, now = np.where(taken, r, ratio), np.where(taken, l, noise), np.where(taken, new, now)
    return ratio, noise


def sweep(d: np.ndarray, t: np.ndarray, b: np.ndarray, mean: np.ndarray, var: np.ndarray, ratio: np.ndarray, noise: np.ndarray, draws: list[np.random.Generator], steps: int) -> np.ndarray:
    """Metropolis-Hastings steps for the centres of some rows; each row has a generator of its own."""
    more, beta, size, rest = mean**2 / var - 1, mean / var, np.sqrt(var) * np.ones_like(d), 1 - ratio

    # a logarithm of a rate counts only where its strand has cuts
    strands = [(where, x.ravel()[where]) for x in (t, b) for where in [np.flatnonzero(x)]]

    def density(x: np.ndarray, log_x: np.ndarray) -> np.ndarray:
        out = more * log_x
        out -= beta * x
        for (where, n), share, sign in zip(strands, (ratio, rest), (1, -1), strict=True):
            rate = x * share
            rate += sign * noise
            np.maximum(rate, LEAST_RATE, out=rate)
            out -= rate
            out.ravel()[where] += n * np.log(rate.ravel()[where])
        return out

    log_d = np.log(d)
    now = density(d, log_d)
    moves, tests = np.empty((2, len(d), steps, d.shape[1]))
    for i, g in enumerate(draws):
        g.standard_normal(out=moves[i])
        g.random(out=tests[i])
    np.log(tests, out=tests)
    for step in range(steps):
        # wide and narrow proposals in turn
        x = d + moves[:, step] * (np.sqrt(d) if step % 2 else size)
        inside = x > 1e-6
        x[~inside] = 1.0
        log_x = np.log(x)
        new = density(x, log_x)
        gain = new - now
        if step % 2:
            # the narrow proposal's width depends on the place it starts from
            gain += 0.5 * (log_d - log_x) - (d - x) ** 2 / 2 * (1 / x - 1 / d)
        taken = inside & (tests[:, step] < gain)
        for old, found in ((d, x), (log_d, log_x), (now, new)):
            np.copyto(old, found, where=taken)
    return d


def tasks_of(rows: int) -> int:
    """Tasks of a round: one for each ROWS_A_TASK rows, and MOST_TASKS of more rows where those are many."""
    return max(1, min(MOST_TASKS, -(-rows // ROWS_A_TASK)))


def _chunks(parts: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Parts of at most so many rows: what a step holds besides its batch doesn't grow with the batch."""
    for part in parts:
        for i in range(0, len(part), rows):
            yield part.iloc[i : i + rows]


def _stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def bayesian(
    rows: DataFrame, group: list[str], offset: int = 53, key: str = "id", rounds: int = 8, inner: int = 6, burn: int = 2, steps: int = 12, seed: int = 1, initial: str = "linear",
) -> DataFrame:
    """``rows`` with unobservable cuts as posterior medians, and ``dyad``: all signals of one length, more than 2 ``offset``.

    ``rounds`` updates of the group's parameters, each after ``inner`` sweeps over the rows; those of the first ``burn``
    rounds are not kept. A group of null keys is a group.
    """
    spark = rows.sparkSession
    if rows.limit(1).count() == 0:
        return rows.withColumn("dyad", F.col("top"))
    length = rows.select(F.size("top")).first()[0]
    centres = np.arange(offset, length - offset)
    state = Settled(spark, "gibbs")
    first = (linear if initial == "linear" else lambda r, g, o: naive(r, o))(rows, group, offset)
    at = lambda c, shift: F.slice(F.transform(c, lambda x: x.cast("double")), offset + shift + 1, length - 2 * offset)
    none = F.array().cast("array<double>")
    start = first.select(*(F.col(c) for c in rows.columns if c not in ("top", "bottom")), "top", "bottom", at("dyad", 0).alias("__d"), at("top", -offset).alias("__t"), at("bottom", offset).alias("__b"), at("dyad", 0).alias("__mean"), none.alias("__marks"))
    # by their number, not their bytes: a row is some kilobytes, and thousands of draws
    now = state.put(start)
    now = state.put(now.repartition(tasks_of(now.count()), key))
    sigmas = state.keep(_noise(now, group))
    columns = now.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema.fields)
    group_fields = ", ".join(f"`{g}` {now.schema[g].dataType.simpleString()}" for g in group)
    parameters = sigmas.withColumn("__r", F.array_repeat(F.lit(0.5), len(centres))).withColumn("__l", F.array_repeat(F.lit(0.0), len(centres)))

    def advance(number: int):
        keep = number >= burn
        kept = max(number - burn, 0) * inner

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _chunks(parts):
                no_top = (centres[None] - offset) >= part["wst"].to_numpy()[:, None]
                no_bottom = (centres[None] + offset) <= part["wed"].to_numpy()[:, None]
                d, t, b, mean = (_stack(part[c]) for c in ("__d", "__t", "__b", "__mean"))
                ratio, noise = _stack(part["__r"]), _stack(part["__l"])
                var = np.maximum(mean.var(axis=1, keepdims=True), 1.0)
                mean, d = np.maximum(mean, LEAST_DYAD), np.maximum(d, LEAST_DYAD)
                draws = [np.random.default_rng([seed, number, zlib.crc32(str(k).encode())]) for k in part[key]]
                n, width = d.shape
                heights, places = np.zeros((2, 5, n, width)), np.zeros((2, 5, n, width))
                if kept:
                    heights, places = (np.moveaxis(x, 0, 2) for x in np.moveaxis(_stack(part["__marks"]).reshape(n, 2, 2, 5, width), 1, 0))
                for i in range(inner):
                    d = sweep(d, t, b, mean, var, ratio, noise, draws, steps)
                    top, bottom = _rates(d, ratio, noise)
                    t = np.where(no_top, np.stack([g.poisson(m) for g, m in zip(draws, top)]), t)
                    b = np.where(no_bottom, np.stack([g.poisson(m) for g, m in zip(draws, bottom)]), b)
                    if keep:
                        for s, x in enumerate((t, b)):
                            heights[s], places[s] = median_marks(heights[s], places[s], kept + i + 1, x)
                marks = [[]] * n if not keep else list(np.stack([np.moveaxis(x, 2, 0) for x in (heights, places)], axis=1).reshape(n, -1))
                yield part[columns].assign(__d=list(d), __t=list(t), __b=list(b), __marks=marks)

        return run

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[list, np.ndarray]] = {}

        def passed() -> Iterator[pd.DataFrame]:
            for names, values in held.values():
                yield pd.DataFrame([names] * len(centres), columns=group).assign(centre=np.arange(len(centres)), sums=list(values))
            held.clear()

        for part in _chunks(parts, 1024):
            for _, one in part.groupby(group, dropna=False):
                values = profile(_stack(one["__t"]), _stack(one["__b"]), np.maximum(_stack(one["__d"]), LEAST_DYAD), float(one["__sigma"].iloc[0]))
                names = [one[g].iloc[0] for g in group]
                own = held.setdefault(tuple(None if pd.isna(v) else v for v in names), (names, np.zeros_like(values)))
                own[1][:] += values
            if len(held) > HELD_GROUPS:
                yield from passed()
        yield from passed()

    def walked(number: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("centre")
            name = "|".join(str(part[g].iloc[0]) for g in group)
            rng = np.random.default_rng([seed, number, zlib.crc32(name.encode()), 7])
            r, l = walk_parameters(_stack(part["sums"]), np.array(part["__r"].iloc[0]), np.array(part["__l"].iloc[0]), float(part["__sigma"].iloc[0]), rng, 100)
            return part[[*group, "__sigma"]].head(1).assign(__r=[r], __l=[l])

        return run

    def of_group(frame: DataFrame, other: DataFrame) -> DataFrame:
        named = other.select(*(F.col(c).alias(f"__g{group.index(c)}" if c in group else c) for c in other.columns))
        same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
        return frame.join(named, same).drop(*(f"__g{i}" for i in range(len(group))))

    shape = parameters.select(*group, "__sigma", "__r", "__l").schema
    for number in range(rounds):
        now = state.put(of_group(now, parameters).mapInPandas(advance(number), fields))
        if number + 1 < rounds:
            parts = of_group(now.select(*group, "__t", "__b", "__d"), parameters.select(*group, "__sigma")).mapInPandas(summed, f"{group_fields}, centre int, sums array<double>")
            total = parts.groupBy(*group, "centre").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
            parameters = state.keep(of_group(total, parameters).groupBy(*group).applyInPandas(walked(number), shape))
    return _filled(state.close(now), rows, centres, offset, (rounds - burn) * inner)


def _noise(state: DataFrame, group: list[str]) -> DataFrame:
    """(group, __sigma): a quarter of both strands' mean counts in the lowest of three natural classes."""
    cells = state.select(*group, F.explode(F.array(F.struct(F.lit("t").alias("s"), F.col("__t").alias("v")), F.struct(F.lit("b").alias("s"), F.col("__b").alias("v")))).alias("x"))
    counts = cells.select(*group, "x.s", F.explode("x.v").alias("v")).groupBy(*group, "s", F.round("v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    shape = counts.select(*group, "s", F.lit(0.0).alias("low")).schema

    def lowest(part: pd.DataFrame) -> pd.DataFrame:
        v, n = part["v"].to_numpy(float), part["n"].to_numpy(float)
        under = v <= natural_breaks(v, min(3, len(v)), n)[0]
        return part[[*group, "s"]].head(1).assign(low=float((v[under] * n[under]).sum() / n[under].sum()))

    low = counts.groupBy(*group, "s").applyInPandas(lowest, shape)
    return low.groupBy(*group).agg(F.greatest(F.sum("low") / 4, F.lit(0.05)).alias("__sigma"))


def _filled(state: DataFrame, rows: DataFrame, centres: np.ndarray, offset: int, n: int) -> DataFrame:
    """``rows`` with the medians of what they can't observe, and their centres."""
    names = [*rows.columns, "dyad"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name not in ('top', 'bottom') else 'array<double>'}" for f in rows.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(parts):
            top, bottom = _stack(part["top"]), _stack(part["bottom"])
            heights = _stack(part["__marks"]).reshape(len(part), 2, 2, 5, len(centres))[:, 0]
            t, b = (median_of(np.moveaxis(heights[:, s], 1, 0), n) for s in (0, 1))
            no_top = (centres[None] - offset) >= part["wst"].to_numpy()[:, None]
            no_bottom = (centres[None] + offset) <= part["wed"].to_numpy()[:, None]
            top[:, centres - offset] = np.where(no_top, t, top[:, centres - offset])
            bottom[:, centres + offset] = np.where(no_bottom, b, bottom[:, centres + offset])
            dyad = np.zeros_like(top)
            dyad[:, centres] = top[:, centres - offset] + bottom[:, centres + offset]
            yield part.assign(top=list(top), bottom=list(bottom), dyad=list(dyad))[names]

    return state.mapInPandas(run, f"{fields}, dyad array<double>")
