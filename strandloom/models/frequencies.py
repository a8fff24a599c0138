"""Shares of sequence pieces under weights: bias reports, spectra of quantile groups, and cuts corrected for their sequence.

Counts are summed on the map side and are 4^k rows a group (and position) at most, so what follows them is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import explode_pieces, gc_percent, reverse_complement
from ..operators.sampling import quantile_groups
from ..operators.signal import normalise
from .regression import windows


def _strands(rows: DataFrame, seq: str, symmetric: bool) -> DataFrame:
    up = F.upper(seq)
    return rows.withColumn("__s", F.explode(F.array(up, reverse_complement(F.col(seq)))) if symmetric else up)


def _share(value: str, by: list[str]) -> Column:
    total = F.sum(value).over(Window.partitionBy(*(by or [F.lit(0)])))
    return F.when(total > 0, F.col(value) / total)


def bias_report(rows: DataFrame, seq: str, weight: str, k: int, positional: bool = True, symmetric: bool = True) -> DataFrame:
    """([pos,] kmer, weighted, even, fold): each piece's share with every sequence ``weight`` times, and once; their ratio.

    With ``symmetric`` the reverse complement counts as well. Pieces that no sequence holds have no row.
    """
    place = ["pos"] if positional else []
    named = _strands(rows.withColumn("__w", F.col(weight).cast("double")), seq, symmetric)
    counts = explode_pieces(named, ["__w"], "__s", k).groupBy(*place, "kmer").agg(F.sum("__w").alias("__b"), F.count(F.lit(1)).alias("__e"))
    shares = counts.select(*place, "kmer", _share("__b", place).alias("weighted"), _share("__e", place).alias("even"))
    return shares.withColumn("fold", F.col("weighted") / F.col("even"))


def spectrum(rows: DataFrame, key: str, seq: str, score: str, groups: int, k: int, symmetric: bool = True) -> DataFrame:
    """(grp, kmer, fold): each piece's share in each group by rising score, over its share in all."""
    named = _strands(quantile_groups(rows.select(key, seq, score), score, key, groups), seq, symmetric)
    counts = explode_pieces(named, ["grp"], "__s", k).groupBy("grp", "kmer").agg(F.count(F.lit(1)).alias("__n"))
    whole = counts.groupBy("kmer").agg(F.sum("__n").alias("__m")).select("kmer", _share("__m", []).alias("__all"))
    own = counts.select("grp", "kmer", _share("__n", ["grp"]).alias("__own"))
    return own.join(whole, "kmer").select("grp", "kmer", (F.col("__own") / F.col("__all")).alias("fold"))


def _around(seq: Column, at: Column, k: int) -> Column:
    return F.substring(seq, at - k // 2 + 1, F.lit(k))


def cut_folds(cuts: DataFrame, refs: DataFrame, key: str, k: int) -> DataFrame:
    """(kmer, fold): how much more often a piece (of odd length, on the strand cut) has a cut in its middle than it stands in the
    references of the ids that are cut, on either strand."""
    used = refs.select(key, F.upper("seq").alias("seq")).join(cuts.select(key).distinct(), key, "left_semi")
    met = cuts.groupBy(key, "side", "cut").agg(F.count(F.lit(1)).alias("__n")).join(used, key)
    met = met.where((F.col("cut") >= k // 2) & (F.col("cut") < F.length("seq") - k // 2))
    piece = _around(F.col("seq"), F.col("cut"), k)
    seen = met.groupBy(F.when(F.col("side") == "R", piece).otherwise(reverse_complement(piece)).alias("kmer")).agg(F.sum("__n").alias("__n"))
    there = explode_pieces(_strands(used, "seq", True), [key], "__s", k).groupBy("kmer").agg(F.count(F.lit(1)).alias("__m"))
    shares = there.select("kmer", _share("__m", []).alias("__m")).join(seen.select("kmer", _share("__n", []).alias("__n")), "kmer")
    return shares.select("kmer", (F.col("__n") / F.col("__m")).alias("fold"))


def corrected(rows: DataFrame, folds: DataFrame, key: str, offset: int, k: int) -> DataFrame:
    """(key, pos, value): centres from both strands' cuts (key, seq, top, bottom), each over its piece's fold; a mass.

    Positions are those whose two pieces lie on the sequence; a piece without a fold adds nothing.
    """
    low = offset + k // 2
    at = F.explode(F.sequence(F.lit(low), F.length("seq") - low - 1)).alias("pos")
    cells = rows.where(F.length("seq") > 2 * low).select(key, F.upper("seq").alias("seq"), "top", "bottom", at)
    top, bottom = F.col("pos") - offset, F.col("pos") + offset
    side = lambda n, kmer: F.struct(n.alias("n"), kmer.alias("kmer"))
    sides = F.array(side(F.get("top", top), _around(F.col("seq"), top, k)), side(F.get("bottom", bottom), reverse_complement(_around(F.col("seq"), bottom, k))))
    both = cells.select(key, "pos", F.explode(sides).alias("x")).select(key, "pos", "x.n", "x.kmer").join(folds, "kmer", "left")
    sums = both.groupBy(key, "pos").agg(F.sum(F.coalesce(F.col("n") / F.col("fold"), F.lit(0.0))).alias("value"))
    return normalise(sums, [key])


def weighted_gc(signal: DataFrame, seqs: DataFrame, key: str, seq: str, size: int = 147) -> DataFrame:
    """(key, gc): GC percent of the window around each position, weighted with the id's mass there."""
    gc = windows(seqs, key, seq, size).select(key, F.col("center").alias("pos"), gc_percent(F.col("window")).alias("__g"))
    return normalise(signal, [key]).join(gc, [key, "pos"]).groupBy(key).agg(F.sum(F.col("value") * F.col("__g")).alias("gc"))
