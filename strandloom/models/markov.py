"""Positional Markov models of sequences: tables by counting, scores by joins, placement by forward-backward sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import letters_once
from ..sources.memo import Settled


def contexts(seqs: DataFrame, key: str, seq: str, order: int) -> DataFrame:
    """(key, ord, pos, prev, cur) for every position and every order up to ``order``."""
    def at(letters: Column, pos: Column) -> Column:
        before = lambda o: F.array_join(F.slice(letters, pos - o + 1, o), "")
        return F.transform(F.sequence(F.lit(0), F.least(F.lit(order), pos)), lambda o: F.struct(o.alias("ord"), pos.alias("pos"), before(o).alias("prev"), F.get(letters, pos).alias("cur")))

    every = letters_once(F.col(seq), lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda pos: at(c, pos))))
    return seqs.where(F.length(seq) > 0).select(key, F.explode(every).alias("x")).select(key, "x.*")


def longest_contexts(seqs: DataFrame, key: str, seq: str, order: int) -> DataFrame:
    """(key, ord, pos, prev, cur) for every position with as many letters before it as there are, up to ``order``."""
    def at(letters: Column, pos: Column) -> Column:
        o = F.least(F.lit(order), pos)
        return F.struct(o.alias("ord"), pos.alias("pos"), F.array_join(F.slice(letters, pos - o + 1, o), "").alias("prev"), F.get(letters, pos).alias("cur"))

    every = letters_once(F.col(seq), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda pos: at(c, pos)))
    return seqs.where(F.length(seq) > 0).select(key, F.explode(every).alias("x")).select(key, "x.*")


def table(seqs: DataFrame, key: str, seq: str, order: int, positional: bool = True) -> DataFrame:
    """(ord, [pos,] prev, cur, n, logp): natural log of the share of ``cur`` after ``prev``."""
    place = ["pos"] if positional else []
    counts = contexts(seqs, key, seq, order).groupBy("ord", *place, "prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("ord", *place, "prev"))
    return counts.withColumn("logp", F.log(F.col("n") / total))


def score(seqs: DataFrame, key: str, seq: str, model: DataFrame, order: int, background: DataFrame | None = None) -> DataFrame:
    """(key, score): log probability of each sequence, less the background's; null where a context was never seen.

    The model is one row a context: 4^(order+1) a position, so the join is broadcast by its size, or shuffled beyond it.
    """
    used = longest_contexts(seqs, key, seq, order)
    met = used.join(model.select("ord", "pos", "prev", "cur", "logp"), ["ord", "pos", "prev", "cur"], "left")
    value = F.col("logp")
    if background is not None:
        met = met.join(background.select("ord", "prev", "cur", F.col("logp").alias("bg")), ["ord", "prev", "cur"], "left")
        value = value - F.col("bg")
    total = met.groupBy(key).agg(F.sum(value).alias("s"), F.count_if(value.isNull()).alias("missing"))
    return total.select(key, F.when(F.col("missing") == 0, F.col("s")).alias("score"))


def placement(scores: DataFrame, key: list[str], length: int = 147, chemical: float = 0.0) -> DataFrame:
    """(key, start, probability) of blocks of ``length`` that exclude each other along a sequence.

    ``scores`` has (key, start, score) for each start; forward and backward partition sums run 147 positions back, a
    recurrence that has no column form, so each sequence is one group of its own, as long as one template.
    """
    shape = scores.select(*key, "start", F.lit(0.0).alias("probability")).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        w = part["score"].to_numpy(float) + chemical
        n = len(w)
        size = n + length - 1
        ahead, back = np.zeros(size + 1), np.zeros(size + 2)
        for i in range(1, size + 1):
            ahead[i] = ahead[i - 1] if i < length else np.logaddexp(ahead[i - 1], ahead[i - length] + w[i - length])
        for i in range(size, 0, -1):
            back[i] = back[i + 1] if i + length - 1 > size else np.logaddexp(back[i + 1], back[i + length] + w[i - 1] if i + length <= size + 1 else w[i - 1])
        start = np.arange(n)
        logp = ahead[start] + w + back[np.minimum(start + length + 1, size + 1)] - ahead[size]
        return part[[*key, "start"]].assign(probability=np.exp(logp))

    return scores.groupBy(*key).applyInPandas(run, shape)


def interpolated(seqs: DataFrame, key: str, seq: str, order: int, letters: int, fold: Column | None = None, rounds: int = 30) -> tuple[DataFrame, list[float], list[float]]:
    """Deleted interpolation of all orders: (the table of ``table``, the weights, the held-out likelihoods).

    Weights are for a uniform share of ``letters`` letters, then for the orders 0 to ``order``; they maximise the likelihood
    of each fold (by default a quarter of the keys) under the counts of the other folds, by expectation-maximisation: a round is one aggregate over the
    different (position, context, letter) of each fold, whose number is bounded by the contexts, not by the sequences. The
    likelihoods (mean log a letter) are the mixture's, then those of the orders alone (None where a letter was never seen).
    """
    fold = F.pmod(F.xxhash64(key), F.lit(4)) if fold is None else fold
    events = held_out(seqs, seq, order, fold).withColumn("p", F.concat(F.array(F.lit(1.0 / letters)), F.col("p")))
    state = Settled(seqs.sparkSession, "held-out")
    events = state.put(events)
    weights = [1.0 / (order + 2)] * (order + 2)

    def parts(w: list[float]) -> tuple[Column, list[Column]]:
        each = [F.col("p")[i] * F.lit(float(w[i])) for i in range(order + 2)]
        return sum(each[1:], each[0]), each

    for _ in range(rounds):
        total, each = parts(weights)
        row = events.agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * x / total).alias(f"w{i}") for i, x in enumerate(each))).first()
        if not row["n"]:
            break
        weights = [row[f"w{i}"] / row["n"] for i in range(order + 2)]
    mix, _ = parts(weights)
    alone = [F.when(F.min(F.col("p")[i + 1]) > 0, F.sum(F.col("n") * F.log(F.col("p")[i + 1])) / F.sum("n")) for i in range(order + 1)]
    said = events.agg((F.sum(F.col("n") * F.log(mix)) / F.sum("n")).alias("m"), *(c.alias(f"o{i}") for i, c in enumerate(alone))).first()
    return table(seqs, key, seq, order), weights, list(said)


def held_out(seqs: DataFrame, seq: str, order: int, fold: Column) -> DataFrame:
    """(fold, pos, prev, cur, n, p): what stands in each fold from position ``order`` on, and the shares that the other
    folds give it by the last 0 to ``order`` letters (0 where they never saw the context)."""
    counts = contexts(seqs.withColumn("__f", fold.cast("int")), "__f", seq, order).withColumnRenamed("__f", "fold")
    counts = counts.where(F.col("pos") >= order).groupBy("fold", "ord", "pos", "prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    after, before = Window.partitionBy("ord", "pos", "prev", "cur"), Window.partitionBy("ord", "pos", "prev")
    other = F.sum("n").over(after) - F.col("n")
    own_context = F.sum("n").over(Window.partitionBy("ord", "pos", "prev", "fold"))
    seen = F.sum("n").over(before) - own_context
    shares = counts.select("fold", "ord", "pos", "prev", "cur", "n", F.when(seen > 0, other / seen).otherwise(0.0).alias("share"))
    full = shares.where(F.col("ord") == order).select("fold", "pos", F.col("prev").alias("whole"), "cur", "n")
    asked = full.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(order)))).withColumn("prev", F.expr("right(whole, ord)"))
    met = asked.join(shares.drop("n"), ["fold", "ord", "pos", "prev", "cur"])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "share"))), lambda x: x["share"])
    return met.groupBy("fold", "pos", F.col("whole").alias("prev"), "cur").agg(F.first("n").alias("n"), ordered.alias("p"))


def mixed_score(seqs: DataFrame, key: str, seq: str, model: DataFrame, weights: list[float]) -> DataFrame:
    """(key, score): log likelihood of each sequence under the weighted orders; before the highest order's first position
    the weights of the orders that are there are raised to 1."""
    order, letters_share = len(weights) - 2, weights[0]
    used = contexts(seqs, key, seq, order).join(model.select("ord", "pos", "prev", "cur", F.exp("logp").alias("p")), ["ord", "pos", "prev", "cur"], "left")
    weight = F.array(*map(F.lit, weights[1:]))[F.col("ord")]
    places = used.groupBy(key, "pos").agg(F.sum(weight * F.coalesce("p", F.lit(0.0))).alias("s"), F.sum(weight).alias("w"))
    even = F.lit(letters_share / max(model.select("cur").distinct().count(), 1))
    return places.groupBy(key).agg(F.sum(F.log((F.col("s") + even) / (F.col("w") + letters_share))).alias("score"))
