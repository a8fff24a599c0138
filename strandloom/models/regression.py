"""Linear sequence models: features of windows, ridge regression with cross-validation, robust and non-linear fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import explode_pieces, gc_percent, pieces, runs


def windows(seqs: DataFrame, key: str, seq: str, size: int = 147) -> DataFrame:
    """(key, center, window): every window of ``size`` letters, named by its middle position."""
    return explode_pieces(seqs, [key], seq, size).select(key, (F.col("pos") + size // 2).alias("center"), F.col("kmer").alias("window"))


def kmer_columns(seq: Column, words: list[str], bins: int = 1, size: int = 147, symmetric: bool = False) -> dict[str, Column]:
    """Counts of each word in each of ``bins`` equal parts of a window; with ``symmetric`` the reverse complement's added."""
    k = len(words[0])
    width = (size - k + 1) / bins
    both = [pieces(seq, k)] + ([pieces(F.reverse(F.translate(seq, "ACGT", "TGCA")), k)] if symmetric else [])

    def count(word: str, b: int) -> Column:
        lo, hi = round(b * width), round((b + 1) * width)
        return sum((F.size(F.filter(F.slice(p, F.lit(lo + 1), F.lit(hi - lo)), lambda x: x == word)) for p in both[1:]), F.size(F.filter(F.slice(both[0], F.lit(lo + 1), F.lit(hi - lo)), lambda x: x == word))).cast("double")

    return {f"k_{w}_{b}": count(w, b) for w in words for b in range(bins)}


def markov_columns(seq: Column, positions: list[int], letters: str = "ACGT") -> dict[str, Column]:
    """One-hot letters at chosen positions, the last letter left out as the base."""
    return {f"m_{p}_{c}": (F.substring(seq, F.lit(p + 1), F.lit(1)) == c).cast("double") for p in positions for c in letters[:-1]}


def tract_columns(seq: Column, letters: str = "AT", least: int = 4) -> dict[str, Column]:
    """Letters in long runs, GC percent, and the squared length of runs."""
    long = F.filter(runs(seq, letters), lambda r: F.length(r) >= least)
    return {
        "tract_letters": F.aggregate(long, F.lit(0.0), lambda s, r: s + F.length(r)), "tract_squares": F.aggregate(long, F.lit(0.0), lambda s, r: s + F.length(r) * F.length(r)),
        "gc": F.coalesce(gc_percent(seq), F.lit(0.0)),
    }


def harmonic_column(center: Column, middle: float) -> dict[str, Column]:
    return {"harmonic": F.pow(center - middle, 2.0) / 2}


def ridge(rows: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> tuple[list[float], float]:
    """Coefficients and intercept that minimise |y - Xb - c|^2 + alpha |b|^2 over all rows.

    Spark's regularisation is scaled by the label's deviation, so alpha is mapped to it; up to 4096 features are solved
    from one aggregated normal matrix, more by L-BFGS, both without moving rows.
    """
    clean = rows.dropna(subset=[*features, label])
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("pop"), F.stddev_samp(label).alias("samp")).first()
    normal = len(features) <= 4096
    if not facts["n"] or not facts["pop"]:
        mean = clean.agg(F.avg(label)).first()[0] if facts["n"] else 0.0
        return [0.0] * len(features), mean
    model = LinearRegression(
        featuresCol="__x", labelCol=label, elasticNetParam=0.0, standardization=False, solver="normal" if normal else "l-bfgs",
        regParam=alpha / facts["n"] * (facts["pop"] if normal else facts["samp"]), maxIter=500, tol=1e-10,
    ).fit(VectorAssembler(inputCols=features, outputCol="__x").transform(clean))
    return [float(x) for x in model.coefficients], float(model.intercept)


#: Features whose normal matrix may be brought to the driver (n^2 doubles: 128 MB).
GRAM_FEATURES = 4096


def symmetric_steps(seq: Column, size: int, width: int = 1, letters: str = "ACGT") -> Column:
    """One-hot pieces of ``width`` letters at each place of a window, averaged with the reverse complement's."""
    words = [""]
    for _ in range(width):
        words = [w + c for w in words for c in letters]
    back = F.reverse(F.translate(seq, "ACGT", "TGCA"))
    known = F.array(*map(F.lit, words))

    def hot(a: Column, b: Column) -> Column:
        return F.transform(known, lambda w: ((a == w).cast("double") + (b == w).cast("double")) / 2)

    return F.flatten(F.zip_with(F.slice(pieces(seq, width), 1, size - width + 1), F.slice(pieces(back, width), 1, size - width + 1), hot))


def symmetric_track(values: Column) -> Column:
    """A shape's values along a window, averaged with the same read backwards."""
    return F.zip_with(values, F.reverse(values), lambda a, b: (a + b) / 2)


def against_key(rows: DataFrame, key: str, place: str, reference: str | int, columns: list[str]) -> DataFrame:
    """Each number, or array of numbers, less the reference key's at the same place; the reference's rows and places that
    it lacks are left out."""
    base = rows.where(F.col(key) == F.lit(reference)).select(place, *(F.col(c).alias(f"__{c}") for c in columns))
    return _less(rows.where(F.col(key) != F.lit(reference)).join(base, place), rows, columns)


def against_place(rows: DataFrame, key: str, place: str, reference: int, columns: list[str]) -> DataFrame:
    """Each number, or array of numbers, less the same key's at the reference place; keys without that place are left out."""
    base = rows.where(F.col(place) == F.lit(reference)).select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return _less(rows.where(F.col(place) != F.lit(reference)).join(base, key), rows, columns)


def _less(met: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    array = {f.name for f in rows.schema.fields if f.dataType.typeName() == "array"}
    less = lambda c: F.zip_with(F.col(c), F.col(f"__{c}"), lambda a, b: a - b) if c in array else F.col(c) - F.col(f"__{c}")
    return met.select(*(less(c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def gram(rows: DataFrame, families: list[str], label: str) -> tuple[list[int], np.ndarray, np.ndarray, int]:
    """Sizes of the families (array columns of one length each), X'X, X'y and the number of rows.

    A task multiplies its batches and hands on one row for each pair of families: what moves is as large as the blocks of
    the normal matrix, whatever the number of rows. Rows without a label are left out.
    """
    data = rows.where(F.col(label).isNotNull()).select(*(F.col(c).cast("array<double>").alias(c) for c in families), F.col(label).cast("double").alias("__y"))
    first = data.select(*(F.size(c) for c in families)).first()
    sizes = [int(n) for n in first] if first else [0] * len(families)
    if sum(sizes) > GRAM_FEATURES:
        raise ValueError(f"over {GRAM_FEATURES} features; use ridge's iterative solver")

    def multiply(parts):
        sums, n = {}, 0
        for part in parts:
            if not len(part):
                continue
            x = [np.vstack(part[c].map(lambda v: np.array([np.nan if u is None else u for u in v], float)).to_numpy()) for c in families] + [part["__y"].to_numpy(float)[:, None]]
            n += len(part)
            for i, a in enumerate(x):
                for j in range(i, len(x)):
                    sums[i, j] = sums.get((i, j), 0.0) + a.T @ x[j]
        for (i, j), m in sums.items():
            yield pd.DataFrame({"i": [i], "j": [j], "m": [m.ravel()], "n": [n]})

    parts = data.mapInPandas(multiply, "i int, j int, m array<double>, n bigint")
    # what is no number comes from Python as null
    numbers = F.transform("m", lambda x: F.coalesce(x, F.lit(float("nan"))))
    blocks = parts.groupBy("i", "j").agg(vector_to_array(Summarizer.sum(array_to_vector(numbers))).alias("m"), F.sum("n").alias("n")).collect()
    ends = np.cumsum([0, *sizes, 1])
    whole, n = np.zeros((ends[-1], ends[-1])), 0
    for b in blocks:
        block = np.array(b["m"]).reshape(ends[b["i"] + 1] - ends[b["i"]], -1)
        whole[ends[b["i"]] : ends[b["i"] + 1], ends[b["j"]] : ends[b["j"] + 1]] = block
        whole[ends[b["j"]] : ends[b["j"] + 1], ends[b["i"]] : ends[b["i"] + 1]] = block.T
        n = b["n"]
    return sizes, whole[:-1, :-1], whole[:-1, -1], int(n)


def block_ridge(rows: DataFrame, families: list[str], label: str, alpha: float = 1.0) -> dict[str, list[float]]:
    """The coefficients of each family that minimise |y - Xb|^2 + alpha |b|^2, from the blocks of the normal matrix.

    A column with a value that is missing or no number (as at the ends of a shape's track) is dropped, and gets 0. Without
    an intercept: differences from a reference have none.
    """
    sizes, whole, right, _ = gram(rows, families, label)
    good = ~np.isnan(np.diag(whole))
    solved = np.zeros(len(right))
    if good.any():
        inner = whole[np.ix_(good, good)] + alpha * np.eye(int(good.sum()))
        solved[good] = np.linalg.solve(inner, right[good])
    ends = np.cumsum([0, *sizes])
    return {c: solved[ends[i] : ends[i + 1]].tolist() for i, c in enumerate(families)}


def block_predict(rows: DataFrame, coefficients: dict[str, list[float]], name: str = "prediction") -> DataFrame:
    """The linear form over the families; a value that isn't there counts as 0."""
    zero = lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    parts = [F.aggregate(F.zip_with(F.col(c), F.array(*(F.lit(float(x)) for x in b)), lambda x, k: zero(x) * k), F.lit(0.0), lambda s, v: s + v) for c, b in coefficients.items() if b]
    return rows.withColumn(name, sum(parts[1:], parts[0]) if parts else F.lit(0.0))


def predict(rows: DataFrame, features: list[str], coefficients: list[float], intercept: float, name: str = "prediction") -> DataFrame:
    """The linear form as a column expression."""
    total = F.lit(float(intercept))
    for f, c in zip(features, coefficients, strict=True):
        total = total + F.col(f) * c
    return rows.withColumn(name, total)


def cross_validated(rows: DataFrame, features: list[str], label: str, fold: str, k: int, alpha: float = 1.0) -> DataFrame:
    """(fold, n, correlation): each fold predicted from the others."""
    out = None
    for i in range(k):
        coefficients, intercept = ridge(rows.where(F.col(fold) != i), features, label, alpha)
        one = predict(rows.where(F.col(fold) == i), features, coefficients, intercept, "__p")
        part = one.agg(F.lit(i).alias("fold"), F.count(F.lit(1)).alias("n"), F.corr("__p", label).alias("correlation"))
        out = part if out is None else out.union(part)
    return out


MODELS: dict[str, tuple[Callable, Callable]] = {
    # curve, and a first guess of its parameters
    "decay": (lambda t, p: p[0] * np.exp(-p[1] * t) + p[2], lambda t, y: [y.max() - y.min(), 1.0 / max(np.ptp(t) / 3, 1e-9), y.min()]),
    "double_decay": (lambda t, p: p[0] * np.exp(-p[1] * t) + p[2] * np.exp(-p[3] * t) + p[4], lambda t, y: [np.ptp(y) / 2, 6.0 / max(np.ptp(t), 1e-9), np.ptp(y) / 2, 1.0 / max(np.ptp(t), 1e-9), y.min()]),
    "saturation": (lambda t, p: p[0] * t / (t + p[1]) + p[2], lambda t, y: [np.ptp(y), max(np.median(t), 1e-6), y.min()]),
}


def least_squares(curve: Callable, t: np.ndarray, y: np.ndarray, start, lower: float | None = None, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Damped Gauss-Newton with a numeric Jacobian; parameters stay at or above ``lower``."""
    p, damp = np.array(start, float), 1e-2
    bound = (lambda q: q) if lower is None else (lambda q: np.maximum(q, lower))
    p = bound(p)
    cost = ((y - curve(t, p)) ** 2).sum()
    for _ in range(rounds):
        r = y - curve(t, p)
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(curve(t, p + d) - curve(t, p)) / s for d, s in zip(np.diag(step), step, strict=True)], 1)
        normal = jac.T @ jac
        try:
            new = bound(p + np.linalg.solve(normal + damp * (np.diag(np.diag(normal)) + 1e-12 * np.eye(len(p))), jac.T @ r))
        except np.linalg.LinAlgError:
            break
        now = ((y - curve(t, new)) ** 2).sum()
        if np.isfinite(now) and now <= cost:
            small = cost - now <= 1e-14 * max(cost, 1e-30)
            p, cost, damp = new, now, max(damp / 3, 1e-12)
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p, float(cost)


def curve_fits(rows: DataFrame, key: str, time: str, value: str, model: str, lower: float | None = None) -> DataFrame:
    """(key, parameters, rate, cost): each group's curve; ``rate`` of a double decay is that of the larger amplitude."""
    curve, guess = MODELS[model]
    shape = rows.select(key, F.array(F.lit(0.0)).alias("parameters"), F.lit(0.0).alias("rate"), F.lit(0.0).alias("cost")).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        t, y = part[time].to_numpy(float), part[value].to_numpy(float)
        p, cost = least_squares(curve, t, y, guess(t, y), lower)
        rate = p[1] if model != "double_decay" or abs(p[0]) >= abs(p[2]) else p[3]
        return pd.DataFrame({key: [part[key].iloc[0]], "parameters": [p.tolist()], "rate": [float(rate)], "cost": [cost]})

    return rows.groupBy(key).applyInPandas(run, shape)
