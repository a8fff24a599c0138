"""Exact mapping of sequences to a genome: a seed index over overlapping chunks, both strands, whole-length matches.

The genome's chromosomes are cut into chunks that overlap by the longest sequence, so no task holds a chromosome's pieces
at once and a match lies whole in the chunk that holds its first letter. Each strand of a sequence is looked up by that of
its seeds (its non-overlapping pieces) which is rarest in the genome; a sequence with a seed that the genome lacks is
nowhere. The candidates so found are compared letter by letter, at full length and without mismatch or gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import pieces, reverse_complement

CHUNK = 4096
#: Letters and rows' own bytes of the sequences that may be broadcast; more of them, and the genome, are joined by shuffles.
BESIDE_BYTES = 1 << 23


def chunks(genome: DataFrame, overlap: int, chunk: int = CHUNK) -> DataFrame:
    """(chr, no, text): chunk ``no`` holds the letters from no * chunk on, and ``overlap`` letters of the next."""
    both = chunk + overlap
    return genome.where(F.length("seq") > 0).select("chr", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{both}}})).{{1,{chunk}}}"), F.lit(1))).alias("no", "text"))


def hits(genome: DataFrame, reads: DataFrame, seed: int = 12, chunk: int = CHUNK) -> DataFrame:
    """(read_id, chr, pos, strand) of every exact occurrence of ``reads`` (read_id, seq) in ``genome`` (chr, seq).

    Seeds are as long as the shortest sequence at most. A palindrome is found on both strands; empty sequences nowhere.
    The joins are named here: the planner knows the sizes of files only, and would send the genome's pieces to every task.
    """
    named = reads.where(F.length("seq") > 0).select("read_id", "seq").distinct()
    size = named.agg(F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most"), F.sum(F.length("seq") + 64).alias("bytes")).first()
    schema = f"read_id {reads.schema['read_id'].dataType.simpleString()}, chr {genome.schema['chr'].dataType.simpleString()}, pos bigint, strand string"
    if size["least"] is None:
        return reads.sparkSession.createDataFrame([], schema)
    k, most = min(seed, size["least"]), size["most"]
    beside = F.broadcast if 4 * size["bytes"] <= BESIDE_BYTES else lambda frame: frame.hint("merge")
    cut = chunks(genome, most, chunk)
    own = cut.select("chr", "no", F.posexplode(pieces(F.col("text"), k)).alias("at", "seed")).where(F.col("at") < chunk)
    counts = own.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("s"))))
    turned = named.select("read_id", strands.alias("x")).select("read_id", "x.strand", "x.s")
    # a sequence's seeds: its letters in groups of k, the rest left out
    seeds = turned.select("read_id", "strand", F.posexplode(F.regexp_extract_all("s", F.lit(f"(?s).{{{k}}}"), F.lit(0))).alias("i", "seed"))
    met = seeds.join(counts.hint("merge"), "seed", "left")
    rarest = met.groupBy("read_id", "strand").agg(F.min_by(F.struct("seed", "i"), F.struct(F.coalesce("n", F.lit(0)), "i")).alias("x"), F.count_if(F.col("n").isNull()).alias("gone"))
    asked = turned.join(rarest.where("gone = 0").select("read_id", "strand", "x.seed", (F.col("x.i") * k).alias("before")).hint("merge"), ["read_id", "strand"])
    places = own.join(beside(asked), "seed").select("read_id", "strand", "s", "chr", (F.col("no").cast("bigint") * chunk + F.col("at") - F.col("before")).alias("pos")).where("pos >= 0")
    places = places.withColumn("no", F.floor(F.col("pos") / chunk).cast("int"))
    same = F.substring(F.col("text"), (F.col("pos") - F.col("no").cast("bigint") * chunk + 1).cast("int"), F.length("s")) == F.col("s")
    return places.join(cut.hint("merge"), ["chr", "no"]).where(same).select("read_id", "chr", "pos", "strand")


def mapped(genome: DataFrame, reads: DataFrame, seed: int = 12) -> DataFrame:
    """(read_id, chr, pos, strand, places) of every sequence: its first place (by chr, pos, strand), or nulls and 0."""
    found = hits(genome, reads, seed).groupBy("read_id").agg(F.min(F.struct("chr", "pos", "strand")).alias("x"), F.count(F.lit(1)).alias("places"))
    return reads.select("read_id").distinct().join(found.hint("merge"), "read_id", "left").select("read_id", "x.chr", "x.pos", "x.strand", F.coalesce("places", F.lit(0)).alias("places"))


def lifted(sites: DataFrame, old: DataFrame, new: DataFrame, flank: int = 100, reach: int = 10_000, seed: int = 12) -> DataFrame:
    """(id, new_pos, places): where the letters around a site (id, chr, pos) of one genome begin in another.

    Looked for on the same chromosome and strand within ``reach`` of the old place; null where there are several.
    """
    around = cut_around(old, sites, flank)
    found = hits(new, around.select(F.col("id").alias("read_id"), "seq"), seed).where("strand = '+'")
    near = found.withColumnRenamed("read_id", "id").withColumnRenamed("pos", "found").join(sites, ["id", "chr"])
    near = near.where((F.col("found") >= F.col("pos") - reach) & (F.col("found") + F.lit(2 * flank) <= F.col("pos") + reach + 2 * flank))
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("places"), F.min("found").alias("p")).select("id", F.when(F.col("places") == 1, F.col("p")).alias("new_pos"), "places")


def cut_around(genome: DataFrame, sites: DataFrame, flank: int) -> DataFrame:
    """(id, seq): up to ``flank`` letters before each site and from it on, cut from the chunk that holds the first."""
    begin = F.greatest(F.col("pos") - flank, F.lit(0))
    wanted = sites.select("id", "chr", begin.alias("b"), (F.col("pos") + flank - begin).cast("int").alias("n"), F.floor(begin / CHUNK).cast("int").alias("no"))
    return wanted.join(chunks(genome, 2 * flank).hint("merge"), ["chr", "no"]).select("id", _piece("text", F.col("b") - F.col("no") * CHUNK, F.col("n")).alias("seq"))


def _piece(text: str, at: Column, n: Column) -> Column:
    return F.substring(F.col(text), (at + 1).cast("int"), n)
