"""Sequence functions as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


def reverse_complement(seq: Column) -> Column:
    """Upper case, complemented over ACGT and reversed; other letters stay."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def gc_percent(seq: Column) -> Column:
    """Share of the letters G and C (as written, case matters) in percent; null for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(F.regexp_replace(seq, "[GC]", ""))) * 100.0 / n)


def gc_difference(seq: Column) -> Column:
    """GC percent of the right half minus that of the left half; a middle letter belongs to neither."""
    half = F.floor(F.length(seq) / 2).cast("int")
    return gc_percent(F.right(seq, half)) - gc_percent(F.left(seq, half))


def letter_share(seq: Column, letters: str) -> Column:
    """Percent of letters in a set, whatever their case."""
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(F.regexp_replace(F.lower(seq), f"[{letters.lower()}]", ""))) * 100.0 / n)


def runs(seq: Column, letters: str) -> Column:
    """All maximal runs of one letter of ``letters``, in order."""
    return F.regexp_extract_all(seq, F.lit("(" + "|".join(f"{c}+" for c in letters) + ")"), F.lit(1))


def longest_run(seq: Column, letters: str) -> Column:
    """Length of the longest run of one letter of ``letters``; 0 without any."""
    return F.coalesce(F.array_max(F.transform(runs(seq, letters), F.length)), F.lit(0))


def run_starts(frame: DataFrame, key: str, seq: str, letters: str, at_least: int = 1) -> DataFrame:
    """(key, letter, start, size) of each run of one letter, 0-based."""
    pattern = F.lit("(" + "|".join(f"{c}+" for c in letters) + f"|[^{letters}]+)")
    parts = F.regexp_extract_all(F.col(seq), pattern, F.lit(1))
    starts = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,part:string>>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), p.alias("part"))).alias("out")),
        lambda s: s["out"],
    )
    found = frame.select(key, F.explode(starts).alias("r")).select(key, F.left("r.part", F.lit(1)).alias("letter"), "r.start", F.length("r.part").alias("size"))
    return found.where(F.col("letter").isin(*letters) & (F.col("size") >= at_least))


def letters_once(seq: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` on the array of the sequence's letters, which is made once a row. Substrings by place walk from the start
    of a text each time; slices of the array don't."""
    return F.element_at(F.transform(F.array(F.split(seq, "")), use), 1)


def pieces(seq: Column, k: int) -> Column:
    """All overlapping substrings of length k, in order; empty where the sequence is shorter.

    One pass of a matcher that looks k letters ahead and takes one: linear in the text, and letters beyond 16 bits count once.
    """
    return F.when(F.length(seq) >= k, F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))).otherwise(F.array().cast("array<string>"))


def explode_pieces(frame: DataFrame, key: list[str], seq: str, k: int) -> DataFrame:
    """(key, pos, kmer), 0-based: one row for each overlapping substring of length k."""
    return frame.where(F.length(seq) >= k).select(*key, F.posexplode(pieces(F.col(seq), k)).alias("pos", "kmer"))


def dinucleotide_count(seq: Column, step: str) -> Column:
    """Overlapping occurrences of one two-letter step, whatever the case."""
    return F.size(F.filter(pieces(F.upper(seq), 2), lambda x: x == step.upper()))


def is_palindrome(seq: Column) -> Column:
    """Equal to its own reverse complement, of even length."""
    return (F.length(seq) % 2 == 0) & (F.upper(seq) == reverse_complement(seq))


def words(spark: SparkSession, k: int, letters: str = "ATCG", palindromes: bool | None = None) -> DataFrame:
    """(kmer) all words of length k over ``letters``: a cross join of constants, of size letters^k."""
    alphabet = spark.createDataFrame([(c,) for c in letters], "kmer string")
    out = alphabet
    for _ in range(k - 1):
        out = out.crossJoin(F.broadcast(alphabet.withColumnRenamed("kmer", "x"))).select(F.concat("kmer", "x").alias("kmer"))
    return out if palindromes is None else out.where(is_palindrome(F.col("kmer")) == palindromes)


def mismatched_words(frame: DataFrame, word: str, letters: str = "ATCG") -> DataFrame:
    """(word, bubble): all words of the same length that differ from ``word`` at every position."""
    other = lambda c: F.filter(F.array(*map(F.lit, letters)), lambda x: x != c)
    start = F.array(F.lit(""))
    grown = F.aggregate(
        F.filter(F.split(word, ""), lambda c: c != ""), start,
        lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(other(c), lambda x: F.concat(a, x)))),
    )
    return frame.select(word, F.explode(grown).alias("bubble"))


def masked(seq: Column, first: Column | int, length: Column | int, mode: str = "skip", fill: str = "N") -> Column:
    """Without a span (skip), only the span (include), or the span replaced by a letter (replace); 0-based."""
    first, length = (F.lit(x) if isinstance(x, int) else x for x in (first, length))
    left, span, right = F.substring(seq, F.lit(1), first), F.substring(seq, first + 1, length), F.substring(seq, first + length + 1, F.length(seq))
    return {"skip": F.concat(left, right), "include": span, "replace": F.concat(left, F.repeat(F.lit(fill), length), right)}[mode]


def extinction(seq: Column) -> Column:
    """Single-strand extinction coefficient by nearest neighbours: steps' sum less the inner letters' sum."""
    steps = F.create_map(*(F.lit(x) for kv in tables.EXTINCTION_STEPS.items() for x in kv))
    ones = F.create_map(*(F.lit(x) for kv in tables.EXTINCTION_BASES.items() for x in kv))
    up = F.upper(seq)
    total = F.aggregate(pieces(up, 2), F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(steps, x), F.lit(0.0)))
    inner = F.aggregate(pieces(F.substring(up, F.lit(2), F.length(up) - 2), 1), F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(ones, x), F.lit(0.0)))
    return F.when(F.length(up) >= 2, total - inner)


def library_extinction(library: DataFrame, seq: str, weight: str, by: list[str]) -> DataFrame:
    """(by, total, mean) of both strands' coefficients over a library, each sequence as often as ``weight`` says."""
    both = F.coalesce(duplex_extinction(F.col(seq)), F.lit(0.0)) * F.col(weight)
    return library.groupBy(*by).agg(F.sum(both).alias("total"), (F.sum(both) / F.sum(weight)).alias("mean"))


def duplex_extinction(seq: Column) -> Column:
    """Both strands."""
    return extinction(seq) + extinction(reverse_complement(seq))


def log2_fold(after: Column, before: Column, pseudo: float = 1.0) -> Column:
    return F.log2((after + pseudo) / (before + pseudo))


def rescale(value: Column, old_low: Column | float, old_high: Column | float, low: float, high: float) -> Column:
    """Linear map of [old_low, old_high] to [low, high]."""
    lo, hi = (F.lit(x) if isinstance(x, (int, float)) else x for x in (old_low, old_high))
    return F.lit(low) + (value - lo) * (F.lit(high - low)) / (hi - lo)


VARIANT = "struct<loc:int,mtype:string,nts:string,size:int>"


def variant(identifier: Column) -> Column:
    """Struct (loc, mtype, nts, size) of an identifier "loc-M-nts" (or I, D), or of the older "nts-loc" and "size-loc"; else null."""
    loc, kind, nts = (F.regexp_extract(identifier, r"^(\d+)-([MID])-([^,]*)$", i) for i in (1, 2, 3))
    old = F.regexp_extract(identifier, r"^([A-Za-z]+|\d+)-(\d+)$", 1)
    old_loc = F.regexp_extract(identifier, r"^([A-Za-z]+|\d+)-(\d+)$", 2)
    size = F.when(nts.rlike(r"^\d+$"), nts.cast("int")).otherwise(F.length(nts))
    old_size = F.when(old.rlike(r"^\d+$"), old.cast("int")).otherwise(F.length(old))
    return (
        F.when(kind != "", F.struct(loc.cast("int").alias("loc"), kind.alias("mtype"), nts.alias("nts"), size.alias("size")))
        .when(old_loc != "", F.struct(old_loc.cast("int").alias("loc"), F.lit("M").alias("mtype"), old.alias("nts"), old_size.alias("size")))
        .cast(VARIANT)
    )


def variant_label(v: Column) -> Column:
    """"M_3[10:13]" for a variant struct."""
    return F.format_string("%s_%d[%d:%d]", v["mtype"], v["size"], v["loc"], v["loc"] + v["size"])


def extended_tract(seq: Column, loc: Column, size: Column, letter: str = "A") -> Column:
    """Struct (start, size) of the run of one letter that holds a tract, grown to the flanking equal letters."""
    left = F.length(F.regexp_extract(F.substring(seq, F.lit(1), loc), f"({letter}*)$", 1))
    right = F.length(F.regexp_extract(F.substring(seq, loc + size + 1, F.length(seq)), f"^({letter}*)", 1))
    return F.struct((loc - left).alias("start"), (left + size + right).alias("size"))


def mismatch_runs(frame: DataFrame, key: str, seq: str, template: str) -> DataFrame:
    """(key, start, size): maximal runs of positions at which a sequence differs from its template."""
    flags = F.array_join(F.zip_with(F.filter(F.split(seq, ""), lambda c: c != ""), F.filter(F.split(template, ""), lambda c: c != ""), lambda a, b: F.when(a.eqNullSafe(b), "=").otherwise("x")), "")
    return run_starts(frame.select(key, flags.alias("__f")), key, "__f", "x").select(key, "start", "size")


def bending_energy(seq: Column, weights: dict[str, float], phase: Column | float = 0.0, period: float = 10.0, amplitude: float = 9.0) -> Column:
    """Sum over steps i of k(step) * w(i)^2, with w(i) = amplitude in radians times sin(pi i / period - (phase - 1.5) / 2)^2."""
    k = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    phase = F.lit(phase) if isinstance(phase, (int, float)) else phase
    steps = F.transform(pieces(F.upper(seq), 2), lambda x, i: F.struct(F.coalesce(F.try_element_at(k, x), F.lit(0)).cast("double").alias("k"), i.cast("double").alias("i")))
    angle = lambda i: F.lit(math.pi / period) * i - (phase - 1.5) * 0.5
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x["k"] * F.pow(F.radians(F.lit(amplitude)) * F.pow(F.sin(angle(x["i"])), 2.0), 2.0))


def least_bending_energy(seq: Column, weights: dict[str, float], period: float = 10.0, step: int = 5) -> Column:
    """The least bending energy over the phases 0, step, ..., 360 degrees."""
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(360), F.lit(step)), lambda p: bending_energy(seq, weights, F.radians(p.cast("double")), period)))
