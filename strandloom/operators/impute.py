"""Imputation of the cuts that cannot be observed, inside and beyond an id's identification window.

Signals are rows (id, tlen, wst, wed, top, bottom) with dense arrays: top strand cuts are unobservable from ``wst`` on,
bottom strand cuts up to ``wed``. All array steps are expressions; only robust fits are Python, on counts of different
pairs of values. The sampler is in ``gibbs``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(values: str, i: Column) -> Column:
    return F.when((i >= 0) & (i < F.size(values)), F.get(values, i)).otherwise(F.lit(0.0))


def _dyads(offset: int) -> Column:
    """Centres from both strands' cuts, for the positions that both can reach."""
    n = F.size("top")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when((j >= offset) & (j < n - offset), _at("top", j - offset) + _at("bottom", j + offset)).otherwise(0.0))


def naive(rows: DataFrame, offset: int = 53) -> DataFrame:
    """Each unobservable cut takes the other strand's count two offsets away; ``dyad`` follows."""
    n = F.size("top")
    cells = F.sequence(F.lit(0), n - 1)
    top = F.transform(cells, lambda j: F.when(j >= F.col("wst"), _at("bottom", j + 2 * offset)).otherwise(F.get("top", j)))
    bottom = F.transform(cells, lambda j: F.when(j <= F.col("wed"), _at("top", j - 2 * offset)).otherwise(F.get("bottom", j)))
    filled = rows.withColumn("__t", top).withColumn("__b", bottom).drop("top", "bottom").withColumnRenamed("__t", "top").withColumnRenamed("__b", "bottom")
    return filled.withColumn("dyad", _dyads(offset))


def huber(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, epsilon: float = 1.35, alpha: float = 1e-4, rounds: int = 100) -> tuple[float, float, np.ndarray]:
    """Slope, intercept and inlier mask of a robust line: concomitant-scale Huber regression by reweighted least squares.

    ``n`` says how often each pair stands there.
    """
    n = np.ones(len(x)) if n is None else n
    slope, const = 0.0, middle(y, n)
    scale = max(middle(np.abs(y - const), n) * 1.4826, 1e-6)
    for _ in range(rounds):
        r = y - slope * x - const
        w = n * np.where(np.abs(r) <= epsilon * scale, 1.0, epsilon * scale / np.maximum(np.abs(r), 1e-12))
        sw, sx, sy = w.sum(), (w * x).sum(), (w * y).sum()
        sxx, sxy = (w * x * x).sum() + alpha * scale, (w * x * y).sum()
        det = sxx * sw - sx * sx
        if abs(det) < 1e-12:
            break
        new = (sxy * sw - sx * sy) / det, (sxx * sy - sx * sxy) / det
        r = y - new[0] * x - new[1]
        inner = np.abs(r) <= epsilon * scale
        # the scale that is stationary in the joint loss, given the residuals
        free = max(n.sum() - epsilon**2 * n[~inner].sum(), 1e-6)
        now = max(float(np.sqrt((n[inner] * r[inner] ** 2).sum() / free)), 1e-6)
        done = abs(new[0] - slope) + abs(new[1] - const) + abs(now - scale) < 1e-9
        (slope, const), scale = new, now
        if done:
            break
    return slope, const, np.abs(y - slope * x - const) <= epsilon * scale


def middle(x: np.ndarray, n: np.ndarray) -> float:
    """The median of values that stand there ``n`` times each."""
    order = np.argsort(x, kind="stable")
    ends = np.cumsum(n[order])
    low, high = np.searchsorted(ends, [(ends[-1] - 1) / 2, ends[-1] / 2], side="right")
    return float(x[order][low] + x[order][min(high, len(x) - 1)]) / 2


def robust_pair(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """Robust lines y(x) and x(y) between two strands' counts, pairs weighted by how often they stand there.

    The fit with the smaller R^2 on its inliers is replaced by the other's inverse; a fit of negative R^2 or of a slope over
    100 by the median.
    """
    def fit(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
        slope, const, inner = huber(a, b, n)
        m = n[inner]
        total = (m * (b[inner] - (m * b[inner]).sum() / m.sum()) ** 2).sum() if inner.any() else 0.0
        return slope, const, 1 - (m * (b[inner] - slope * a[inner] - const) ** 2).sum() / total if total > 0 else -1.0

    a1, c1, r1 = fit(x, y)
    a2, c2, r2 = fit(y, x)
    if r1 >= 0 and r2 >= 0:
        if r1 < r2 and a2:
            a1, c1 = 1 / a2, -c2 / a2
        elif r2 < r1 and a1:
            a2, c2 = 1 / a1, -c1 / a1
    if r1 < 0 or abs(a1) > 100:
        a1, c1 = 0.0, middle(y, n)
    if r2 < 0 or abs(a2) > 100:
        a2, c2 = 0.0, middle(x, n)
    return a1, c1, a2, c2


def pair_counts(rows: DataFrame, group: list[str], offset: int = 53) -> DataFrame:
    """(group, pos, x, y, n): how often each pair of counts of the two strands stands at a position that both can observe."""
    first = F.greatest(F.col("wed") + 1 - 2 * offset, F.lit(0))
    last = F.least(F.size("top") - 2 * offset, F.col("wst")) - 1
    seen = rows.where(first <= last).select(*group, "top", "bottom", F.explode(F.sequence(first, last)).alias("pos"))
    pairs = seen.select(*group, "pos", F.get("top", F.col("pos")).alias("x"), F.get("bottom", F.col("pos") + 2 * offset).alias("y"))
    return pairs.groupBy(*group, "pos", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def branches(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, pos, pairs, branch, x, y): how a position is to be filled, and the medians of both strands.

    ``none`` with fewer than 3 pairs or over 0.7 zeros on either side; ``median`` below 0.2 correlation; else ``line``.
    """
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    facts = counts.groupBy(*group, "pos").agg(
        F.sum(n).alias("pairs"), F.sum(F.when(x == 0, n).otherwise(0)).alias("zx"), F.sum(F.when(y == 0, n).otherwise(0)).alias("zy"),
        F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"),
        F.percentile(x, F.lit(0.5), n).alias("x"), F.percentile(y, F.lit(0.5), n).alias("y"),
    )
    m = F.col("pairs")
    spread = (m * F.col("sxx") - F.col("sx") ** 2) * (m * F.col("syy") - F.col("sy") ** 2)
    correlation = (m * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)
    few = (m < 3) | (F.col("zx") / m > 0.7) | (F.col("zy") / m > 0.7)
    branch = F.when(few, "none").when((spread <= 0) | (F.abs(correlation) < 0.2), "median").otherwise("line")
    return facts.select(*group, "pos", "pairs", branch.alias("branch"), "x", "y")


def lines(rows: DataFrame, group: list[str], offset: int = 53) -> DataFrame:
    """(group, pos, a1, c1, a2, c2): lines bottom(top) and top(bottom) of each group and position that has enough pairs.

    What meets in a task is the different pairs of counts of one position, not the ids of its group.
    """
    counts = pair_counts(rows, group, offset)
    told = branches(counts, group)
    zero = F.lit(0.0)
    flat = told.where("branch = 'median'").select(*group, "pos", zero.alias("a1"), F.col("y").alias("c1"), zero.alias("a2"), F.col("x").alias("c2"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        found = robust_pair(part["x"].to_numpy(float), part["y"].to_numpy(float), part["n"].to_numpy(float))
        return part[[*group, "pos"]].head(1).assign(**dict(zip(("a1", "c1", "a2", "c2"), found, strict=True)))

    fitted = counts.join(told.where("branch = 'line'").select(*group, "pos"), [*group, "pos"], "left_semi")
    return flat.union(fitted.groupBy(*group, "pos").applyInPandas(fit, flat.schema))


def linear(rows: DataFrame, group: list[str], offset: int = 53) -> DataFrame:
    """Unobservable cuts by lines fitted, in each group and position, between the strands' observable counts."""
    table = lines(rows, group, offset).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("a1", "c1", "a2", "c2")))).alias("__lines"))
    met = rows.join(table, group, "left")
    cells = F.sequence(F.lit(0), F.size("top") - 1)
    line = lambda j: F.try_element_at("__lines", j)
    value = lambda a, c, x: F.coalesce(F.greatest(F.nanvl(a * x + c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    top = F.transform(cells, lambda j: F.when(j >= F.col("wst"), value(line(j)["a2"], line(j)["c2"], _at("bottom", j + 2 * offset))).otherwise(F.get("top", j)))
    bottom = F.transform(cells, lambda j: F.when(j <= F.col("wed"), value(line(j - 2 * offset)["a1"], line(j - 2 * offset)["c1"], _at("top", j - 2 * offset))).otherwise(F.get("bottom", j)))
    filled = met.withColumn("__t", top).withColumn("__b", bottom).drop("top", "bottom", "__lines").withColumnRenamed("__t", "top").withColumnRenamed("__b", "bottom")
    return filled.withColumn("dyad", _dyads(offset))


def residuals(imputed: DataFrame, truth: DataFrame, key: list[str], value: str, true_value: str) -> DataFrame:
    """(n, sum_squares, mean_squares) of an imputation against the truth."""
    d = F.col(value) - F.col(true_value)
    return imputed.join(truth, key).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("sum_squares"), F.avg(d * d).alias("mean_squares"))
