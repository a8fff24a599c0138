"""Reads to signals: alignment walks, variant calls, read types, cut and dyad histograms.

A read's walk along its CIGAR stays inside array expressions (prefix sums over the operations, then one pass over each),
so classification is narrow: no shuffle but the one that meets the dictionary of references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import variant

OPS = "array<struct<op:string,n:int,ref:int,read:int>>"


def cigar_ops(cigar: Column, start: Column) -> Column:
    """Operations of a CIGAR with where each begins on the reference (from ``start``) and on the read."""
    counts, kinds = F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Za-z=])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Za-z=])"), F.lit(2))
    zipped = F.zip_with(counts, kinds, lambda n, k: F.struct(n.cast("int").alias("n"), k.alias("k")))
    first = F.struct(start.cast("int").alias("ref"), F.lit(0).alias("read"), F.array().cast(OPS).alias("out"))
    return F.aggregate(
        zipped, first,
        lambda s, x: F.struct(
            (s["ref"] + F.when(x["k"] == "I", 0).otherwise(x["n"])).alias("ref"),
            (s["read"] + F.when(x["k"] == "D", 0).otherwise(x["n"])).alias("read"),
            F.array_append(s["out"], F.struct(x["k"].alias("op"), x["n"].alias("n"), s["ref"].alias("ref"), s["read"].alias("read"))).alias("out"),
        ),
        lambda s: s["out"],
    )


def aligned_end(ops: Column, start: Column) -> Column:
    """Reference position after the last one the alignment covers."""
    return F.aggregate(ops, start.cast("int"), lambda s, x: s + F.when(x["op"] == "I", 0).otherwise(x["n"]))


def _differences(ref: Column, read: Column) -> Column:
    """(start, nts) of runs of read letters that differ from the reference's, 0-based within the two strings."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    shown = F.array_join(F.zip_with(letters(ref), letters(read), lambda a, b: F.when(a.eqNullSafe(b), "=").otherwise(F.coalesce(b, F.lit("=")))), "")
    parts = F.regexp_extract_all(shown, F.lit("(=+|[^=]+)"), F.lit(1))
    return F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,nts:string>>").alias("out")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(p.startswith("="), s["out"]).otherwise(F.array_append(s["out"], F.struct(s["at"].alias("start"), p.alias("nts")))).alias("out")),
        lambda s: s["out"],
    )


def variant_calls(sam: DataFrame, backbone: str) -> DataFrame:
    """``sam`` (read_id, pos 0-based, cigar, seq, ...) with ``calls``: the tokens "pos-M-nts", "pos-I-nts", "pos-D-nts".

    Neighbouring mismatches of one operation are one token; an insertion is named by the position before it. A change at
    the very edge of the read (an outer insertion or deletion, or a mismatch of its first or last letter) voids all.
    """
    whole = F.lit(backbone)
    ops = sam.withColumn("__ops", cigar_ops(F.col("cigar"), F.col("pos")))
    cut = lambda text, at, n: F.substring(text, at + 1, n)
    diff = lambda x: F.transform(_differences(cut(whole, x["ref"], x["n"]), cut(F.col("seq"), x["read"], x["n"])), lambda d: F.struct((x["ref"] + d["start"]).alias("at"), F.lit("M").alias("k"), d["nts"].alias("nts"), (x["read"] + d["start"]).alias("r")))
    one = lambda x: (
        F.when(x["op"] == "M", diff(x))
        .when(x["op"] == "I", F.array(F.struct((x["ref"] - 1).alias("at"), F.lit("I").alias("k"), cut(F.col("seq"), x["read"], x["n"]).alias("nts"), x["read"].alias("r"))))
        .when(x["op"] == "D", F.array(F.struct(x["ref"].alias("at"), F.lit("D").alias("k"), cut(whole, x["ref"], x["n"]).alias("nts"), x["read"].alias("r"))))
        .otherwise(F.array().cast("array<struct<at:int,k:string,nts:string,r:int>>"))
    )
    called = ops.withColumn("__calls", F.flatten(F.transform("__ops", one)))
    outer = F.coalesce(F.try_element_at("__ops", F.lit(1))["op"].isin("I", "D") | F.try_element_at("__ops", F.lit(-1))["op"].isin("I", "D"), F.lit(False))
    edge = outer | F.exists("__calls", lambda c: (c["k"] == "M") & ((c["r"] == 0) | (c["r"] + F.length(c["nts"]) == F.length("seq"))))
    tokens = F.transform("__calls", lambda c: F.concat_ws("-", c["at"].cast("string"), c["k"], c["nts"]))
    return called.withColumn("calls", F.when(edge, F.array().cast("array<string>")).otherwise(F.array_distinct(tokens))).withColumn("aligned_end", aligned_end(F.col("__ops"), F.col("pos"))).drop("__ops", "__calls")


def _placed(pos: Column, end: Column, length: Column, margin: int) -> tuple[Column, Column]:
    """Type and cut of a read by which ends of its reference it reaches."""
    left, right = pos < margin, end > length - margin - 1
    kind = F.when(left & right, "freeDNA").when(left | right, "valid").otherwise("frag")
    cut = F.when(left & ~right, F.concat(F.lit("L:"), (end + 1).cast("string"))).when(~left & right, F.concat(F.lit("R:"), (pos - 1).cast("string")))
    return kind, cut


def unmapped(sam: DataFrame) -> Column:
    return (F.col("pos") < 0) | (F.col("flag").bitwiseAND(4) != 0) | (F.col("rname") == "*")


def met_calls(tokens: DataFrame, refs: DataFrame) -> DataFrame:
    """``tokens`` (call, ...) with the length of the reference of that name, and the letters a call without one changes."""
    met = tokens.join(refs.select(F.col("ref_id").alias("call"), F.length("seq").alias("ref_len")), "call", "left")
    size = F.length(F.regexp_extract("call", r"^-?\d+-[MID]-(.*)$", 1))
    return met.withColumn("edit", F.when(F.col("ref_len").isNull() & F.col("call").isNotNull(), size).otherwise(0))


def probe(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """(read_id, hits, edits): how many calls of each read (read_id, calls) are references, and the letters of the others."""
    tokens = calls.select("read_id", F.explode_outer("calls").alias("call"))
    return met_calls(tokens, refs).groupBy("read_id").agg(F.count("ref_len").alias("hits"), F.sum("edit").alias("edits"))


def classify_direct(sam: DataFrame, refs: DataFrame, backbone: str, max_edits: int = 20, margin: int = 10) -> DataFrame:
    """(read_id, type, hit, cut_loc) of reads aligned to the backbone: their variant calls are looked up in ``refs`` (ref_id, seq)."""
    called = variant_calls(sam, backbone)
    bad = unmapped(called)
    token = called.select("read_id", "pos", "aligned_end", bad.alias("bad"), F.explode_outer("calls").alias("call"))
    grouped = met_calls(token, refs).groupBy("read_id", "pos", "aligned_end", "bad").agg(
        F.sort_array(F.collect_list(F.when(F.col("ref_len").isNotNull(), F.struct(F.col("call"), F.col("ref_len"))))).alias("hits"),
        F.sum("edit").alias("edits"),
    )
    one = F.get("hits", 0)
    v = variant(one["call"])
    end = F.least(F.col("aligned_end"), F.lit(len(backbone))) - 1 + F.when(v["mtype"] == "I", v["size"]).when(v["mtype"] == "D", -v["size"]).otherwise(0)
    kind, cut = _placed(F.col("pos"), end, one["ref_len"], margin)
    state = F.when(F.col("bad"), "mutant").when(F.col("edits") > max_edits, "mutant").when(F.size("hits") < 1, "unIden").when(F.size("hits") > 1, "multHit").otherwise(kind)
    hit = F.when(state.isin("mutant", "unIden"), "NA").otherwise(F.array_join(F.transform("hits", lambda h: h["call"]), ":"))
    return grouped.select("read_id", state.alias("type"), hit.alias("hit"), F.when(state == "valid", cut).otherwise("NA").alias("cut_loc"))


def identification_windows(refs: DataFrame) -> DataFrame:
    """(ref_id, windows): for ids of variants joined by commas, each variant's window (mtype, st, ed) on its reference.

    Ends are included; insertions and deletions get one letter on either side; earlier ones shift later windows.
    """
    parts = F.transform(F.split("ref_id", ","), lambda c: variant(F.trim(c)))
    good = refs.where(~F.exists(F.split("ref_id", ","), lambda c: ~F.trim(c).rlike(r"^\d+-[MID]-[^,-]*$")))
    ordered = good.select("ref_id", F.array_sort(parts).alias("vs"))
    first = F.struct(F.lit(0).alias("off"), F.array().cast("array<struct<mtype:string,st:int,ed:int>>").alias("out"))
    walk = F.aggregate(
        "vs", first,
        lambda s, v: F.struct(
            (s["off"] + F.when(v["mtype"] == "I", F.length(v["nts"])).when(v["mtype"] == "D", -F.length(v["nts"])).otherwise(0)).alias("off"),
            F.array_append(s["out"], F.struct(
                v["mtype"].alias("mtype"),
                (v["loc"] + s["off"] - F.when(v["mtype"] == "D", 1).otherwise(0)).alias("st"),
                (v["loc"] + s["off"] + F.when(v["mtype"] == "M", F.length(v["nts"]) - 1).when(v["mtype"] == "I", F.length(v["nts"]) + 1).otherwise(0)).alias("ed"),
            )).alias("out"),
        ),
        lambda s: s["out"],
    )
    return ordered.select("ref_id", walk.alias("windows"))


def _visits(ops: Column, loc: Column) -> Column:
    """Read positions at which the walk stands on a reference position; each inserted letter is a visit of its own."""
    return F.flatten(F.transform(
        F.filter(ops, lambda x: F.when(x["op"] == "I", x["ref"] == loc).otherwise((x["ref"] <= loc) & (loc < x["ref"] + x["n"]))),
        lambda x: F.when(x["op"] == "I", F.sequence(x["read"], x["read"] + x["n"] - 1)).when(x["op"] == "D", F.array(x["read"])).otherwise(F.array(x["read"] + loc - x["ref"])),
    ))


def classify(sam: DataFrame, refs: DataFrame, max_edits: int = 20, margin: int = 10, check_windows: bool = True) -> DataFrame:
    """(read_id, type, hit, cut_loc) of reads aligned to their references: the windows that tell variants apart must agree."""
    known = refs.select(F.col("ref_id").alias("rname"), F.col("seq").alias("ref_seq"))
    if check_windows:
        known = known.join(identification_windows(refs).withColumnRenamed("ref_id", "rname"), "rname", "left")
    else:
        known = known.withColumn("windows", F.lit(None).cast("array<struct<mtype:string,st:int,ed:int>>"))
    met = sam.join(known, "rname", "left").withColumn("__ops", cigar_ops(F.col("cigar"), F.col("pos")))

    def wrong(w: Column) -> Column:
        where = F.array_sort(F.concat(_visits(F.col("__ops"), w["st"]), F.when(w["ed"] != w["st"], _visits(F.col("__ops"), w["ed"])).otherwise(_visits(F.col("__ops"), w["st"]))))
        a, b = F.get(where, 0), F.get(where, 1)
        cut_off = (w["mtype"] == "M") & ((a == 0) | (b == F.length("seq") - 1))
        differs = F.substring("ref_seq", w["st"] + 1, w["ed"] - w["st"] + 1) != F.substring("seq", a + 1, b - a + 1)
        return (F.size(where) != 2) | F.coalesce(cut_off | differs, F.lit(True))

    length = F.length("ref_seq")
    end = F.least(aligned_end(F.col("__ops"), F.col("pos")), length) - 1
    kind, cut = _placed(F.col("pos"), end, length, margin)
    state = (
        F.when(F.col("rname") == "BACKBONE", "unIden").when(unmapped(met), "mutant").when(F.coalesce(F.col("nm"), F.lit(0)) > max_edits, "mutant")
        .when(F.coalesce(F.exists("windows", wrong), F.lit(False)), "unIden").when(F.col("ref_seq").isNull(), "unIden").otherwise(kind)
    )
    hit = F.when(unmapped(met) | (F.col("rname") == "BACKBONE"), "NA").otherwise(F.col("rname"))
    return met.select("read_id", state.alias("type"), hit.alias("hit"), F.when(state == "valid", cut).otherwise("NA").alias("cut_loc"))


def type_report(reads: DataFrame, column: str = "type") -> DataFrame:
    """(type, n, percent), most first."""
    counts = reads.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), column)


def cuts(reads: DataFrame, types: tuple[str, ...] = ("valid",), mtypes: tuple[str, ...] | None = None, length: int = 225, offset: int = 53, pad: int = 0) -> DataFrame:
    """Rows (id, side, cut, pos, tlen, wst, wed) of the reads that tell something: cuts on the template and their dyads.

    A variant's window must lie inside the read; deletions shorten the template, insertions move cuts and window ends.
    """
    rows = reads.where(F.col("type").isin(*types) & (F.col("mapped_id") != "BACKBONE") & F.col("cut_loc").rlike(r"^[LR]:-?\d+$"))
    rows = rows.select(F.col("mapped_id").alias("id"), F.split("cut_loc", ":")[0].alias("side"), F.split("cut_loc", ":")[1].cast("int").alias("cut"))
    # exploded as an array of one, so that the optimiser doesn't write the parsing out wherever a part of it is used
    parsed = F.when(F.col("id").rlike(r"^\d+-[MID]-[^-]*$"), variant(F.col("id")))
    rows = rows.select("*", F.explode(F.array(parsed)).alias("v"))
    if mtypes is not None:
        rows = rows.where(F.col("v").isNull() | F.col("v.mtype").isin(*mtypes))
    n, loc, kind = F.length("v.nts"), F.col("v.loc"), F.col("v.mtype")
    rows = rows.withColumn("wst", loc - F.when(kind == "I", 0).otherwise(1) - pad)
    rows = rows.withColumn("wed", F.when(kind == "M", loc + n).when(kind == "I", loc + n + 1).otherwise(loc) + pad)
    rows = rows.where(F.col("v").isNull() | ((F.col("side") == "R") & (F.col("cut") < F.col("wst"))) | ((F.col("side") == "L") & (F.col("cut") > F.col("wed"))))
    rows = rows.withColumn("tlen", F.lit(length) - F.when(kind == "D", n).otherwise(0))
    rows = rows.withColumn("cut", F.col("cut") - F.when((F.col("side") == "L") & (kind == "I"), n).otherwise(0)).withColumn("wed", F.col("wed") - F.when(kind == "I", n).otherwise(0))
    rows = rows.withColumn("pos", F.col("cut") + F.when(F.col("side") == "R", offset).otherwise(-offset))
    return rows.where((F.col("pos") >= 0) & (F.col("pos") < F.col("tlen"))).select("id", "side", "cut", "pos", "tlen", "wst", "wed")


def cut_histogram(found: DataFrame) -> DataFrame:
    """(id, side, pos, value): cuts by strand; right cuts are the top strand's, left cuts the bottom's."""
    return found.groupBy("id", "side", F.col("cut").alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def dyad_histogram(found: DataFrame) -> DataFrame:
    """(id, pos, value): positions of the centre, an offset from either cut."""
    return found.groupBy("id", "pos").agg(F.count(F.lit(1)).cast("double").alias("value"))


def enough(signal: DataFrame, key: list[str], more_than: float) -> DataFrame:
    """Ids whose values sum to more than a limit."""
    return signal.withColumn("__t", F.sum("value").over(Window.partitionBy(*key))).where(F.col("__t") > more_than).drop("__t")


def valid_fraction(reads: DataFrame, key: str, valid: Column) -> DataFrame:
    """(key, share) of valid reads."""
    return reads.groupBy(key).agg(F.avg(valid.cast("double")).alias("share"))


def abundance(reads: DataFrame, key: str) -> DataFrame:
    """(key, share) of all reads."""
    counts = reads.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = reads.agg(F.count(F.lit(1)).alias("__all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(key, (F.col("n") / F.col("__all")).alias("share"))


def crosstalk(reads: DataFrame) -> DataFrame:
    """(truth, kind, n) for simulated reads whose name ends in /<ref_id>/<cut>: right, wrong id, wrong cut or not placed."""
    part = F.split("read_id", "/")
    truth, cut = F.element_at(part, -2), F.element_at(part, -1)
    kind = F.when(F.col("type") != "valid", "lost").when(F.col("hit") != truth, "wrong id").when(F.split("cut_loc", ":")[1] != cut, "wrong cut").otherwise("right")
    return reads.where(F.size(part) >= 3).groupBy(truth.alias("truth"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def library_report(reads: DataFrame, seq: str = "read_seq") -> DataFrame:
    """(measure, item, n): types, read lengths, GC percents and coverage of ids, in one pass over an expanded row."""
    gc = F.floor((F.length(seq) - F.length(F.regexp_replace(seq, "[GCgc]", ""))) * 100.0 / F.length(seq)).cast("string")
    named = lambda measure, item: F.struct(F.lit(measure).alias("measure"), item.alias("item"))
    items = F.array(named("type", F.col("type")), named("length", F.length(seq).cast("string")), named("gc", gc), named("coverage", F.when(F.col("type") == "valid", F.col("mapped_id"))))
    return reads.select(F.explode(items).alias("x")).select("x.*").where("item IS NOT NULL").groupBy("measure", "item").agg(F.count(F.lit(1)).alias("n"))


def library_coverage(reads: DataFrame, best: int = 10) -> DataFrame:
    """(measure, item, n, mean, sd): valid reads an id, by kind and by size of its variant, and the ``best`` ids' own."""
    counts = reads.where((F.col("type") == "valid") & F.col("mapped_id").isNotNull()).groupBy("mapped_id").agg(F.count(F.lit(1)).alias("c"))
    # exploded as an array of one, so that the parsing is done once a row
    v = counts.select("mapped_id", "c", F.explode(F.array(variant(F.col("mapped_id")))).alias("v"))
    items = F.array(F.struct(F.lit("kind").alias("measure"), F.col("v.mtype").alias("item")), F.struct(F.lit("size").alias("measure"), F.col("v.size").cast("string").alias("item")))
    told = v.select("c", F.explode(items).alias("x")).select("c", "x.*").where("item IS NOT NULL")
    told = told.groupBy("measure", "item").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("sd"))
    first = counts.orderBy(F.desc("c"), "mapped_id").limit(best)
    return told.union(first.select(F.lit("top"), "mapped_id", F.lit(1).cast("bigint"), F.col("c").cast("double"), F.lit(0.0)))
