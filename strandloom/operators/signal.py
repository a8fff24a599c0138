"""Operators on signals in long form (id, pos, value): histograms, masses, peaks, densities, spectra.

Every operator takes the key columns of a signal, so a window or a group is one id, a few hundred positions: partitions
stay small however many ids there are, and one shuffle by id serves all window steps of a plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: list[str]) -> Window:
    return Window.partitionBy(*key)


def densify(signal: DataFrame, key: list[str], first: int, last: int) -> DataFrame:
    """All positions first..last of each id, missing ones as 0.

    The grid is made by a generator on the distinct ids, not a join with a table of positions.
    """
    grid = signal.select(*key).distinct().withColumn("pos", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(signal.where(F.col("pos").between(first, last)), [*key, "pos"], "left").select(*key, "pos", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def to_arrays(signal: DataFrame, key: list[str]) -> DataFrame:
    """(key, values): the dense view of a signal that has every position."""
    return signal.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def to_rows(arrays: DataFrame, key: list[str], values: str = "values") -> DataFrame:
    """The long form of a dense view."""
    return arrays.select(*key, F.posexplode(values).alias("pos", "value"))


def histogram(frame: DataFrame, value: str, bins: int, share: bool = False) -> DataFrame:
    """(center, count): equal bins between the least and the largest value; the largest itself opens one bin more."""
    ends = frame.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = frame.select(value).join(F.broadcast(ends)).select(F.floor((F.col(value) - F.col("lo")) / width).alias("bin"), "lo", width.alias("width"))
    out = placed.groupBy("bin", "lo", "width").agg(F.count(F.lit(1)).alias("n")).select((F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("center"), "n")
    return out.select("center", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("count")) if share else out.select("center", F.col("n").alias("count"))


def normalise(signal: DataFrame, key: list[str]) -> DataFrame:
    """Values divided by their id's sum; unchanged where that is not positive."""
    total = F.sum("value").over(_by(key))
    return signal.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(F.col("value")))


def subtract_background(signal: DataFrame, key: list[str], fraction: float = 0.1) -> DataFrame:
    """max(value - (least + fraction * (largest - least)), 0) within each id."""
    lo, hi = F.min("value").over(_by(key)), F.max("value").over(_by(key))
    return signal.withColumn("value", F.greatest(F.col("value") - (lo + F.lit(fraction) * (hi - lo)), F.lit(0.0)))


def peaks(signal: DataFrame, key: list[str], top: int | None = None) -> DataFrame:
    """(key, pos, value, rank): strict local maxima, ends excluded, by value then position, both descending."""
    w = _by(key).orderBy("pos")
    sides = signal.withColumn("__a", F.lag("value").over(w)).withColumn("__b", F.lead("value").over(w))
    found = sides.where((F.col("value") > F.col("__a")) & (F.col("value") > F.col("__b"))).drop("__a", "__b")
    ranked = found.withColumn("rank", F.row_number().over(_by(key).orderBy(F.desc("value"), F.desc("pos"))))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def highlight_peaks(signal: DataFrame, key: list[str], top: int = 15, broaden: int = 1) -> DataFrame:
    """The signal with only its top peaks, each added to its neighbours as well; overlaps sum."""
    offsets = F.explode(F.sequence(F.lit(-broaden), F.lit(broaden)))
    grown = peaks(signal, key, top).select(*key, "pos", "value", offsets.alias("d")).groupBy(*key, (F.col("pos") + F.col("d")).alias("pos")).agg(F.sum("value").alias("__v"))
    return signal.join(grown, [*key, "pos"], "left").select(*key, "pos", F.coalesce("__v", F.lit(0.0)).alias("value"))


def common_peaks(signal: DataFrame, key: list[str], top: int = 15) -> DataFrame:
    """Values at the top peaks of the mean signal of all ids, one row for each id and peak."""
    mean = signal.groupBy("pos").agg(F.avg("value").alias("value")).withColumn("__all", F.lit(0))
    return signal.join(F.broadcast(peaks(mean, ["__all"], top).select("pos", "rank")), "pos").select(*key, "pos", "rank", "value")


def peak_ratio(signal: DataFrame, key: list[str]) -> DataFrame:
    """(key, ratio, distance): the second peak's value over the first's, and how far it lies from it."""
    best = peaks(signal, key, 2).groupBy(*key).agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("pos", "value")))
    return best.where("value2 IS NOT NULL").select(*key, (F.col("value2") / F.col("value1")).alias("ratio"), F.abs(F.col("pos2") - F.col("pos1")).alias("distance"))


def density(signal: DataFrame, key: list[str], bandwidth: float = 1.0, scale: float = 1.0) -> DataFrame:
    """(key, pos, density): Gaussian kernel density on the id's own positions, weights floor(scale * value).

    An id's positions meet each other inside one array expression: no self-join, no shuffle beyond the one by id.
    """
    rows = signal.select(*key, "pos", "value", F.floor(F.lit(scale) * F.col("value")).cast("double").alias("w"))
    points = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("points"), F.sum("w").alias("mass")).where("mass > 0")
    factor = 1.0 / (bandwidth * math.sqrt(2 * math.pi))
    grid = points.select(*key, "mass", "points", F.explode("points").alias("p"))
    kernel = F.aggregate("points", F.lit(0.0), lambda s, x: s + x["w"] * F.exp(-F.pow((x["pos"] - F.col("p.pos")) / F.lit(bandwidth), 2) / 2))
    return grid.select(*key, F.col("p.pos").alias("pos"), (kernel / F.col("mass") * factor).alias("density"))


def entropy(signal: DataFrame, key: list[str], bandwidth: float = 1.0, scale: float = 1.0) -> DataFrame:
    """(key, entropy): minus the sum of density times its natural logarithm over the positions."""
    d = F.col("density")
    return density(signal, key, bandwidth, scale).groupBy(*key).agg((-F.sum(F.when(d > 0, d * F.log(d)).otherwise(0.0))).alias("entropy"))


def energy(signal: DataFrame, key: list[str], kt: float = 1.0, bandwidth: float = 1.0, scale: float = 1.0) -> DataFrame:
    """(key, pos, energy): -kT times the logarithm of the density; null where it is 0."""
    return density(signal, key, bandwidth, scale).select(*key, "pos", F.when(F.col("density") > 0, -F.lit(kt) * F.log("density")).alias("energy"))


def force(profile: DataFrame, key: list[str], value: str = "energy") -> DataFrame:
    """(key, pos, force): minus the difference to the next position, per position; the last one has none."""
    w = _by(key).orderBy("pos")
    step = (F.lead(value).over(w) - F.col(value)) / (F.lead("pos").over(w) - F.col("pos"))
    return profile.withColumn("force", -step).where("force IS NOT NULL").select(*key, "pos", "force")


def location(signal: DataFrame, key: list[str], scale: float = 1.0) -> DataFrame:
    """(key, total, mean_pos, median_pos): sum, weighted mean and median (weights floor(scale * value)) of the positions."""
    w = F.floor(F.lit(scale) * F.col("value")).cast("bigint")
    out = signal.groupBy(*key).agg(
        F.sum("value").alias("total"), (F.sum(F.col("pos") * F.col("value")) / F.sum("value")).alias("mean_pos"),
        F.percentile("pos", 0.5, w).alias("median_pos"),
    )
    return out


def share_of_bin(signal: DataFrame, key: list[str], low: int, high: int) -> DataFrame:
    """(key, share): the part of an id's sum that lies in positions low..high."""
    inside = F.sum(F.when(F.col("pos").between(low, high), F.col("value")).otherwise(0.0))
    return signal.groupBy(*key).agg(F.when(F.sum("value") > 0, inside / F.sum("value")).alias("share"))


def depletion(signal: DataFrame, windows: DataFrame, key: str, control: str) -> DataFrame:
    """(key, size, depletion): 1 minus an id's mass in its window (key, loc, size) over the control's there; null without any."""
    mass = normalise(signal, [key])
    reference = mass.where(F.col(key) == control).select("pos", F.col("value").alias("__c"))  # one id's positions
    cells = windows.select(key, "size", F.explode(F.sequence(F.col("loc"), F.col("loc") + F.col("size") - 1)).alias("pos"))
    sums = cells.join(mass, [key, "pos"]).join(F.broadcast(reference), "pos").groupBy(key, "size").agg(F.sum("value").alias("__v"), F.sum("__c").alias("__c"))
    return sums.select(key, "size", F.when(F.col("__c") > 0, 1 - F.col("__v") / F.col("__c")).alias("depletion"))


def spread_by(frame: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, sd) of the values that there are; the population's deviation."""
    return frame.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def occupancy(signal: DataFrame, key: list[str], length: int = 147) -> DataFrame:
    """Sum of the values of the last ``length`` positions up to each one."""
    return signal.withColumn("value", F.sum("value").over(_by(key).orderBy("pos").rowsBetween(1 - length, 0)))


def autocorrelation(signal: DataFrame, key: list[str], lags: int) -> DataFrame:
    """(key, lag, acf): mean product of deviations at each lag over the variance; positions must be dense."""
    points = to_arrays(signal, key)
    mean = F.aggregate("values", F.lit(0.0), lambda s, x: s + x) / F.size("values")
    centred = points.select(*key, F.transform("values", lambda x: x - mean).alias("d")).withColumn("n", F.size("d"))
    rows = centred.withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(F.lit(lags), F.col("n") - 1))))
    product = F.aggregate(F.zip_with(F.slice("d", F.lit(1), F.col("n") - F.col("lag")), F.slice("d", F.col("lag") + 1, F.col("n") - F.col("lag")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    var = F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x) / F.col("n")
    return rows.select(*key, "lag", F.when(var > 0, product / (F.col("n") - F.col("lag")) / var).alias("acf"))


def cross_correlation(pairs: DataFrame, key: list[str], lags: int, a: str = "a", b: str = "b") -> DataFrame:
    """(key, lag, correlation): Pearson correlation of a(pos) with b(pos + lag), for lags 0..lags."""
    shifted = pairs.select(*key, F.col("pos").alias("__p"), F.col(b).alias("__b"))
    spread = pairs.select(*key, "pos", a, F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("__p", F.col("pos") + F.col("lag"))
    return spread.join(shifted, [*key, "__p"]).groupBy(*key, "lag").agg(F.corr(a, "__b").alias("correlation"))


def periodogram(signal: DataFrame, key: list[str]) -> DataFrame:
    """(key, k, period, amplitude, phase): Fourier terms k = 1..n/2-1 of each id's dense signal, over n; phases in pi."""
    points = to_arrays(signal, key).withColumn("n", F.size("values")).where("n >= 4")
    rows = points.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int") - 1)))
    angle = lambda i: F.lit(2 * math.pi) * F.col("k") * i / F.col("n")
    total = lambda f: F.aggregate(F.transform("values", lambda x, i: x * f(angle(i))), F.lit(0.0), lambda s, x: s + x)
    parts = rows.select(*key, "k", "n", total(F.cos).alias("re"), (-total(F.sin)).alias("im"))
    return parts.select(*key, "k", (F.col("n") / F.col("k")).alias("period"), (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.col("n")).alias("amplitude"), (F.atan2("im", "re") / math.pi).alias("phase"))


def resampled(points: DataFrame, key: list[str], x: str, y: str, first: int, last: int) -> DataFrame:
    """(key, pos, value) at the whole places from ``first`` to ``last``, on straight lines between a key's points.

    Equal places are one point, of their mean. A key's points are sorted once; a place is told by the line that ends there
    or passes it. A key whose points don't reach from ``first`` to ``last`` is left out.
    """
    w = Window.partitionBy(*key).orderBy("__x")
    ends = Window.partitionBy(*key)
    knots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*key, F.col(x).cast("double").alias("__x")).agg(F.avg(y).alias("__y"))
    lines = knots.select(*key, "__x", "__y", F.lag("__x").over(w).alias("__a"), F.lag("__y").over(w).alias("__b"), F.min("__x").over(ends).alias("__lo"), F.max("__x").over(ends).alias("__hi"))
    lines = lines.where((F.col("__lo") <= first) & (F.col("__hi") >= last))
    low = F.greatest(F.when(F.col("__a").isNull(), F.ceil("__x")).otherwise(F.floor("__a") + 1), F.lit(first)).cast("int")
    high = F.least(F.floor("__x"), F.lit(last)).cast("int")
    # a key's least point tells its own place only
    places = lines.where(low <= high).withColumn("pos", F.explode(F.sequence(low, high)))
    share = (F.col("pos") - F.col("__a")) / (F.col("__x") - F.col("__a"))
    return places.select(*key, "pos", F.when(F.col("__a").isNull(), F.col("__y")).otherwise(F.col("__b") + share * (F.col("__y") - F.col("__b"))).alias("value"))


def lomb_scargle(signal: DataFrame, key: list[str], periods: list[float]) -> DataFrame:
    """(key, period, power): normalised Lomb-Scargle power of the centred signal, whose positions may have gaps."""
    mean = F.avg("value").over(_by(key))
    rows = signal.where("value IS NOT NULL").withColumn("y", F.col("value") - mean).select(*key, "pos", "y", F.explode(F.array(*map(F.lit, periods))).alias("period"))
    w = F.lit(2 * math.pi) / F.col("period")
    tau = F.atan2(F.sum(F.sin(2 * w * F.col("pos"))), F.sum(F.cos(2 * w * F.col("pos"))))
    shift = rows.groupBy(*key, "period").agg((tau / (2 * (F.lit(2 * math.pi) / F.col("period")))).alias("tau"))
    t = w * (F.col("pos") - F.col("tau"))
    y = F.col("y")
    power = (F.sum(y * F.cos(t)) ** 2 / F.sum(F.cos(t) ** 2) + F.sum(y * F.sin(t)) ** 2 / F.sum(F.sin(t) ** 2)) / F.sum(y * y)
    return rows.join(shift, [*key, "period"]).groupBy(*key, "period").agg(F.when(F.sum(y * y) > 0, power).alias("power"))


def pair_distances(marks: DataFrame, key: list[str], group: str, lags: int) -> DataFrame:
    """(group, lag, n): how often two marks of one group lie ``lag`` positions apart in one id, 1..lags.

    A mark meets those after it in a running window over its id and group, so nothing is joined: a join with marks that are
    made from a short text would be planned by the size of the text's file, and all marks be sent to every task.
    """
    ahead = F.collect_list("pos").over(Window.partitionBy(*key, group).orderBy("pos").rangeBetween(1, lags))
    met = marks.dropna(subset=[*key, group, "pos"]).withColumn("__ahead", ahead).select(group, F.col("pos").alias("__from"), F.explode("__ahead").alias("pos"))
    return met.groupBy(group, (F.col("pos") - F.col("__from")).alias("lag")).agg(F.count(F.lit(1)).alias("n"))


def elementwise(signal: DataFrame, how: str = "mean", by: list[str] | None = None) -> DataFrame:
    """Mean, median or population standard deviation of each position over the ids (within ``by``); nulls are left out."""
    f = {"mean": F.avg, "median": F.median, "std": F.stddev_pop, "var": F.var_pop}[how]
    return signal.groupBy(*(by or []), "pos").agg(f("value").alias("value"))


def most_dynamic(signal: DataFrame, top: int) -> DataFrame:
    """(pos, variance) of the positions whose population variance over the ids is largest; ties to the smaller."""
    return elementwise(signal, "var").withColumnRenamed("value", "variance").orderBy(F.desc("variance"), "pos").limit(top)


def running_mean(trace: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Mean of all values up to and with each row of a trace."""
    return trace.withColumn("running", F.avg(value).over(_by(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def time_average(trace: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """(key, time_average): mean of a state that holds until the next row, weighted by how long."""
    held = F.lead(time).over(_by(key).orderBy(time, value)) - F.col(time)
    rows = trace.select(*key, F.col(value).alias("__v"), held.alias("__d")).where("__d IS NOT NULL")
    return rows.groupBy(*key).agg(F.when(F.sum("__d") > 0, F.sum(F.col("__v") * F.col("__d")) / F.sum("__d")).alias("time_average"))


def boltzmann(profile: DataFrame, key: list[str], scale: float = 1.0, value: str = "energy") -> DataFrame:
    """(key, pos, value): exp(-scale * energy), normalised in each id; shifted by the least energy for range."""
    low = F.min(value).over(_by(key))
    return normalise(profile.select(*key, "pos", F.exp(-F.lit(scale) * (F.col(value) - low)).alias("value")), key)


def power_rescale(signal: DataFrame, key: list[str], exponent: float | Column) -> DataFrame:
    """A mass raised to a power and normalised again."""
    return normalise(signal.withColumn("value", F.pow("value", exponent)), key)


def weighted_copies(frame: DataFrame, weight: str, scale: float = 1.0) -> DataFrame:
    """Rows with a ``copies`` column round(weight * scale) to weight later sums with; rows of no copy go."""
    return frame.withColumn("copies", F.round(F.col(weight) * scale).cast("bigint")).where("copies > 0")


def furthest_peak(signal: DataFrame, key: list[str], centre: int, top: int = 5) -> DataFrame:
    """(key, distance): of the top peaks the one furthest from ``centre``, and on which side; of equal ones the higher."""
    gap = F.col("pos") - centre
    return peaks(signal, key, top).groupBy(*key).agg(F.max_by(gap, F.struct(F.abs(gap), -F.col("rank"))).alias("distance"))


def most_counted(signal: DataFrame, key: list[str], scale: float = 1000.0, share: float = 0.5, margin: int = 73) -> DataFrame:
    """(key, pos, strand, copies): the ``share`` of each id's positions, ``margin`` from both ends, that hold most of its
    signal, on both strands, with the number of copies that stands for it; by copies, then position."""
    total, last = F.sum("value").over(_by(key)), F.max("pos").over(_by(key))
    counted = signal.withColumn("copies", F.round(F.col("value") * scale / total).cast("bigint")).withColumn("__last", last)
    inside = counted.where((F.col("pos") >= margin) & (F.col("pos") <= F.col("__last") - margin))
    ranked = inside.withColumn("__r", F.row_number().over(_by(key).orderBy(F.desc("copies"), "pos"))).withColumn("__n", F.count(F.lit(1)).over(_by(key)))
    return ranked.where(F.col("__r") <= F.round(F.col("__n") * share)).select(*key, "pos", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), "copies")


def boltzmann_padded(profile: DataFrame, key: list[str], scale: float, first: int, last: int, value: str = "energy") -> DataFrame:
    """``boltzmann`` of a profile that tells of inner positions only, with 0 at the others from ``first`` to ``last``."""
    return densify(boltzmann(profile, key, scale, value), key, first, last)
