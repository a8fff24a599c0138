"""Readers of line and record formats as DataFrames, and writers.

Line formats split anywhere. Record formats (a mark at line start, then lines) are read with the mark as the separator,
which Spark splits as well; those whose records depend on more than their own lines come from ``records``, by byte ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import FOUR_LINES, SPLIT_BYTES, records


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def sorted_reads(spark: SparkSession, path: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """(read_id, type, mapped_id, cut_loc, read_seq) of a table of classified reads, without the backbone's."""
    f = _lines(spark, path).select(_fields(F.col("value")).alias("f")).where("size(f) >= 5")
    rows = f.select(*(F.col("f")[i].alias(n) for i, n in enumerate(("read_id", "type", "mapped_id", "cut_loc", "read_seq")))).where("mapped_id <> 'BACKBONE'")
    return rows.where(F.col("type").isin(*types)) if types else rows


def fasta(spark: SparkSession, path: str, upper: bool = False, tricky: bool = False) -> DataFrame:
    """(ref_id, seq): a record's lines are joined; the id is the header's first word, or with ``tricky`` "chr" and the value
    of a "[chromosome=..]" field where there is one."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    parts = F.split("value", r"\r?\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s+", "")
    word, number = F.regexp_extract(parts[0], r"^\s*(\S+)", 1), F.regexp_extract(parts[0], r"\[chromosome=([^\]]+)\]", 1)
    name = F.when(number != "", F.concat(F.lit("chr"), number)).otherwise(word) if tricky else word
    return records.select(name.alias("ref_id"), (F.upper(seq) if upper else seq).alias("seq")).where("ref_id <> ''")


def fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(read_id, seq, qual) of four-line records."""
    l = F.col("lines")
    return records(spark, path, FOUR_LINES, split_bytes=split_bytes).select(F.regexp_extract(l[0], r"^@(\S+)", 1).alias("read_id"), l[1].alias("seq"), l[3].alias("qual"))


def write_fastq(rows: DataFrame, path: str) -> None:
    """Four-line records of rows (read_id, seq, qual)."""
    rows.select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").text(path)


def merge_pairs(pairs: DataFrame, seq1: str, seq2: str, least: int = 10, mismatches: float = 0.1) -> DataFrame:
    """``pairs`` with ``merged``: read 1 overlapped with read 2's reverse complement at the longest overlap that fits; else null."""
    back = F.reverse(F.translate(F.upper(F.col(seq2)), "ACGT", "TGCA"))
    n1, n2 = F.length(seq1), F.length(seq2)
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    differing = lambda o: F.aggregate(F.zip_with(letters(F.right(F.col(seq1), o)), letters(F.left(back, o)), lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    most = F.least(n1, n2)
    overlaps = F.filter(F.sequence(most, F.lit(least), F.lit(-1)), lambda o: differing(o) <= o * F.lit(mismatches))
    best = F.when(most >= least, F.get(overlaps, 0))
    return pairs.withColumn("merged", F.when(best.isNotNull(), F.concat(F.col(seq1), F.substring(back, best + 1, n2))))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, flag, rname, pos 0-based, mapq, cigar, seq, qual, tags, nm) of alignment rows; header lines are left out."""
    # fields are parted by tabs alone: the value of a tag may hold blanks
    f = _lines(spark, path).where(~F.col("value").startswith("@")).select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f")).where("size(f) >= 11")
    tags = F.map_from_entries(F.transform(F.filter(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: t.rlike("^..:.:")), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(6), F.length(t)))))
    rows = f.select(F.col("f")[0].alias("read_id"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("rname"), (F.col("f")[3].cast("int") - 1).alias("pos"), F.col("f")[4].cast("int").alias("mapq"), F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), F.col("f")[10].alias("qual"), tags.alias("tags"))
    return rows.withColumn("nm", F.try_element_at("tags", F.lit("NM")).cast("int"))


SECTIONS = {
    "Sequence": "seq", "MinorGrooveWidth": "mgw", "HelixTwist": "helt", "PropellerTwist": "prot", "Roll": "roll", "IdentificationWindow": "window",
    "ImputationMethod": "method", "TopCleavageCounts": "top", "BottomCleavageCounts": "bottom", "PositioningSignal": "dyad",
}


def signal_file(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each id of signal files: header values, sequence, shapes, window, method and the dense signals.

    A file's header holds for all its records: it goes with each byte range of the file.
    """
    found = records(spark, path, ">", head=True, split_bytes=split_bytes)
    head = lambda name: F.regexp_extract(F.try_element_at("head", F.lit(name)), r"^(\d+)", 1).try_cast("int").alias(name)
    # trim itself would take the index as the letters to trim
    lines = F.transform(F.transform("lines", lambda x: F.regexp_replace(x, "^>", "")), lambda x: F.trim(x))
    rows = found.select(head("ref_length"), head("left_offset"), head("right_offset"), lines.alias("lines"))
    section = lambda name: F.get("lines", F.array_position("lines", f"@{name}").cast("int"))
    numbers = lambda name: F.when(F.array_contains("lines", f"@{name}"), F.transform(F.split(section(name), ","), lambda x: F.trim(x).try_cast("double")))
    text = lambda name: F.when(F.array_contains("lines", f"@{name}"), section(name))
    window = F.split(text("IdentificationWindow"), r"\s+")
    return rows.select(
        F.col("lines")[0].alias("id"), "ref_length", "left_offset", "right_offset", text("Sequence").alias("seq"),
        *(numbers(k).alias(v) for k, v in SECTIONS.items() if v in ("mgw", "helt", "prot", "roll", "top", "bottom", "dyad")),
        F.get(window, 0).try_cast("int").alias("wst"), F.get(window, 1).try_cast("int").alias("wed"), text("ImputationMethod").alias("method"),
    )


def write_signal_file(rows: DataFrame, path: str) -> None:
    """Rows as ``signal_file`` gives them, one file a partition with a header of its own."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("NA"))), ",")
    part = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"@{name}\n"), value, F.lit("\n"))).otherwise("")
    values = {v: (F.col(v) if v in ("seq", "method") else F.when(F.col(v).isNotNull(), listed(v))) for v in SECTIONS.values() if v != "window"}
    values["window"] = F.when(F.col("wst").isNotNull(), F.format_string("%d %d", "wst", "wed"))
    body = F.concat(F.lit(">"), F.col("id"), F.lit("\n"), *(part(k, values[v]) for k, v in SECTIONS.items()))
    head = F.format_string("@ref_length\t%d\n@left_offset\t%d\n@right_offset\t%d\n\n", F.max("ref_length"), F.max("left_offset"), F.max("right_offset"))
    files = rows.withColumn("__f", F.spark_partition_id())
    text = files.withColumn("__b", body).groupBy("__f").agg(head.alias("h"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "__b"))), lambda x: x["__b"]), "\n").alias("b"))
    text.select(F.concat("h", "b").alias("value")).write.mode("overwrite").text(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(cycle, row, pos, value) of trace files: ">cycle" lines, then comma rows; what is no number is null."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = records.select(F.split("value", r"\r?\n").alias("l")).select(F.trim(F.col("l")[0]).try_cast("int").alias("cycle"), F.posexplode(F.filter(F.slice("l", F.lit(2), F.lit(1 << 30)), lambda x: F.trim(x) != "")).alias("row", "line"))
    return lines.select("cycle", "row", F.posexplode(F.split("line", ",")).alias("pos", "v")).select("cycle", "row", "pos", F.trim("v").try_cast("double").alias("value"))


def shapes(spark: SparkSession, prefix: str, tracks: tuple[str, ...] = ("MGW", "HelT", "ProT", "Roll")) -> DataFrame:
    """(id, track, pos, value) of a prefix's four shape files; values may run over lines; NA is null."""
    out = None
    for track in tracks:
        records = spark.read.option("lineSep", ">").text(f"{prefix}.{track}").where(F.trim("value") != "")
        parts = F.split("value", r"\r?\n", 2)
        one = records.select(F.trim(parts[0]).alias("id"), F.lit(track).alias("track"), F.posexplode(F.split(F.regexp_replace(parts[1], r"\s+", ""), ",")).alias("pos", "v"))
        one = one.where("v <> ''").select("id", "track", "pos", F.col("v").try_cast("double").alias("value"))
        out = one if out is None else out.union(one)
    return out


def table(spark: SparkSession, path: str, columns: list[tuple[str, str]], header: bool = False) -> DataFrame:
    """White-space separated rows with these (name, type) columns; "_" skips one; rows that don't fit are left out."""
    f = _lines(spark, path).select(_fields(F.col("value")).alias("f")).where(F.size("f") >= len(columns))
    named = [(i, n, t) for i, (n, t) in enumerate(columns) if n != "_"]
    rows = f.select(*(F.col("f")[i].try_cast(t).alias(n) for i, n, t in named))
    solid = [n for _, n, t in named if t != "string"]
    rows = rows.dropna(subset=solid) if solid else rows
    return rows.where(F.col(named[0][1]) != F.lit(columns[0][0])) if header and not solid else rows


def nucleosomes(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos 0-based, score, snr) with a positive signal-to-noise ratio."""
    rows = table(spark, path, [("chr", "string"), ("pos", "int"), ("score", "double"), ("snr", "double")])
    return rows.where("snr > 0").withColumn("pos", F.col("pos") - 1)


def genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, chr, strand, tss, tts): open reading frames; ends swapped on the minus strand; a repeated name gets "-alt"."""
    rows = table(spark, path, [("id", "string"), ("chrom", "int"), ("strand", "string"), ("start", "int"), ("end", "int"), ("type", "string"), ("gene", "string")]).where("type = 'ORF-T'")
    again = F.row_number().over(Window.partitionBy("gene").orderBy("chrom", "start", "end"))
    minus = F.col("strand") == "-"
    return rows.withColumn("__n", again).select(
        F.concat("gene", F.when(F.col("__n") > 1, "-alt").otherwise("")).alias("gene"), F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chr"), "strand",
        F.when(minus, F.greatest("start", "end")).otherwise(F.least("start", "end")).alias("tss"), F.when(minus, F.least("start", "end")).otherwise(F.greatest("start", "end")).alias("tts"),
    )


def expression(spark: SparkSession, path: str) -> DataFrame:
    """(gene, fpkm), "-" left out, the first value of a gene by size."""
    rows = table(spark, path, [("_", "string"), ("gene", "string"), ("_", "string"), ("fpkm", "double")]).where("gene <> '-'")
    return rows.groupBy("gene").agg(F.max("fpkm").alias("fpkm"))


def occupancies(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, value) of rows "chr start end v;v;..." whose values fill start..end."""
    rows = table(spark, path, [("chr", "string"), ("st", "int"), ("ed", "int"), ("v", "string")])
    values = rows.withColumn("v", F.filter(F.split("v", ";"), lambda x: x != "")).where(F.size("v") == F.col("ed") - F.col("st") + 1)
    return values.select("chr", "st", F.posexplode("v").alias("i", "x")).select("chr", (F.col("st") + F.col("i")).alias("pos"), F.col("x").try_cast("double").alias("value"))


def loops(spark: SparkSession, path: str, trim: int = 0) -> DataFrame:
    """(seq, score) with flanks of ``trim`` letters cut."""
    rows = table(spark, path, [("seq", "string"), ("score", "double")])
    return rows.withColumn("seq", F.substring("seq", F.lit(trim + 1), F.length("seq") - 2 * trim))


def assays(spark: SparkSession, path: str) -> DataFrame:
    """(sample, rep, time, value): "@sample" sections of rows "time v v ..."; a repeated name is skipped after its first."""
    named = records(spark, path, "@").select(F.struct("file", "start").alias("i"), F.trim(F.substring(F.col("lines")[0], 2, 1 << 30)).alias("sample"), F.slice("lines", F.lit(2), F.lit(1 << 30)).alias("l"))
    first = named.groupBy("sample").agg(F.min_by("l", "i").alias("l"))
    rows = first.select("sample", F.explode("l").alias("line")).select("sample", F.transform(_fields(F.col("line")), lambda x: x.try_cast("double")).alias("v"))
    return rows.where("size(v) >= 2 AND v[0] IS NOT NULL").select("sample", F.col("v")[0].alias("time"), F.posexplode(F.slice("v", F.lit(2), F.lit(1 << 30))).alias("rep", "value")).where("value IS NOT NULL").select("sample", "rep", "time", "value")


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """(serial, atom, resn, chain, resi, x, y, z, b, kind) of fixed-width atom records; kind is the chain's commoner residues."""
    cut = lambda a, b, t: F.trim(F.substring("value", a, b - a + 1)).try_cast(t)
    rows = spark.read.text(path).where(F.col("value").startswith("ATOM")).select(
        cut(7, 11, "int").alias("serial"), cut(13, 16, "string").alias("atom"), cut(18, 20, "string").alias("resn"), cut(22, 22, "string").alias("chain"), cut(23, 26, "int").alias("resi"),
        cut(31, 38, "double").alias("x"), cut(39, 46, "double").alias("y"), cut(47, 54, "double").alias("z"), cut(61, 66, "double").alias("b"),
    )
    dna = F.col("resn").isin("DA", "DC", "DG", "DT", "A", "C", "G", "T", "U")
    kinds = rows.groupBy("chain").agg(F.when(F.avg(dna.cast("int")) > 0.5, "DNA").otherwise("protein").alias("kind"))
    return rows.join(kinds, "chain")


def write_fasta(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit(">"), "ref_id", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def write_sorted(reads: DataFrame, path: str, keep_seq: bool = False) -> None:
    """The table of classified reads; a valid read's sequence is N unless kept."""
    seq = F.col("read_seq") if keep_seq else F.lit("N")
    reads.select(F.concat_ws("\t", "read_id", "type", "mapped_id", "cut_loc", seq).alias("value")).write.mode("overwrite").text(path)


def write_rows(arrays: DataFrame, key: str, values: str, path: str) -> None:
    """">id" lines with one comma row each."""
    arrays.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit("NaN"))), ",")).alias("value")).write.mode("overwrite").text(path)


def transposed(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Long cells as one row for each ``row`` and one column for each of the named ``columns``."""
    return cells.groupBy(row).pivot(column, columns).agg(F.first(value))
