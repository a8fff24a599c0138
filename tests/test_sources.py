"""Text formats: round trips and odd lines."""

from strandloom.functions import sequence as S
from strandloom.operators import signal as G
from strandloom.sources import text


def put(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body)
    return str(path)


def test_sorted_reads(spark, tmp_path):
    path = put(tmp_path, "a.sort", "r1\tvalid\t3-M-A\tL:100\tN\n\nr2 frag 601 NA N\nr3\tvalid\tBACKBONE\tL:1\tN\n")
    assert [r.read_id for r in text.sorted_reads(spark, path).orderBy("read_id").collect()] == ["r1", "r2"]
    assert text.sorted_reads(spark, path, ("valid",)).count() == 1


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.ref", ">one x\nACGT\nAC\n>two\nGG\n")
    assert {r.ref_id: r.seq for r in text.fasta(spark, path).collect()} == {"one": "ACGTAC", "two": "GG"}


def test_fastq_and_merge(spark, tmp_path):
    path = put(tmp_path, "a.fq", "@r1/1\nACGTACGTACGTTT\n+\n@GGGGGGGGGGGGG\n@r2\nAC\n+\nGG\n")
    assert [(r.read_id, r.qual) for r in text.fastq(spark, path).orderBy("read_id").collect()] == [("r1/1", "@GGGGGGGGGGGGG"), ("r2", "GG")]
    whole = "ACGGTTAACCGGATCGATTTGCA"
    pair = spark.createDataFrame([(whole[:18], whole[6:][::-1].translate(str.maketrans("ACGT", "TGCA")))], "a string, b string")
    assert text.merge_pairs(pair, "a", "b").first().merged == whole


def test_sam(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@HD x\nr1\t0\tref\t5\t42\t4M\t*\t0\t0\tACGT\tGGGG\tAS:i:0\tNM:i:2\n")
    row = text.sam(spark, path).first()
    assert (row.pos, row.nm, row.tags["AS"], row.seq) == (4, 2, "0", "ACGT")


def test_signal_file_round_trip(spark, tmp_path):
    body = "@ref_length\t5\n@left_offset\t1\n@right_offset\t1\n\n>a\n@Sequence\nACGTA\n@IdentificationWindow\n1 3\n@ImputationMethod\nlinear\n@TopCleavageCounts\n1.0,2.0,0.0,0.0,1.0\n\n>b\n@TopCleavageCounts\n0.0,0.0,0.0,0.0,3.0\n"
    rows = text.signal_file(spark, put(tmp_path, "a.data", body))
    a, b = rows.orderBy("id").collect()
    assert (a.wst, a.wed, a.method, a.top[1], a.ref_length) == (1, 3, "linear", 2.0, 5) and b.seq is None and b.top[4] == 3.0
    text.write_signal_file(rows.coalesce(1), str(tmp_path / "out"))
    again = text.signal_file(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_other_formats(spark, tmp_path):
    trace = text.blocks(spark, put(tmp_path, "t", ">0\n1,2\nx,4\n>1\n5,6\n"))
    assert trace.count() == 6 and trace.where("value IS NULL").count() == 1
    for track in ("MGW", "HelT", "ProT", "Roll"):
        put(tmp_path, f"s.{track}", ">a\n1.0,NA,\n3.0\n")
    shapes = text.shapes(spark, str(tmp_path / "s"))
    assert shapes.count() == 12 and shapes.where("value IS NULL").count() == 4
    assert text.nucleosomes(spark, put(tmp_path, "n", "chr1 10 1.0 2.0\nchr1 11 1.0 0\nbad\n")).collect()[0].pos == 9
    genes = text.genes(spark, put(tmp_path, "g", "x 1 - 5 20 ORF-T G1\nx 1 + 5 20 other G2\nx 2 + 1 9 ORF-T G1\n")).orderBy("gene").collect()
    assert [(g.gene, g.tss, g.tts) for g in genes] == [("G1", 20, 5), ("G1-alt", 1, 9)]
    assert text.expression(spark, put(tmp_path, "e", "a G1 b 2.5\na - b 1\n")).count() == 1
    assert text.occupancies(spark, put(tmp_path, "o", "chr1 5 7 1;2;3\nchr1 5 7 1;2\n")).count() == 3
    assert text.loops(spark, put(tmp_path, "l", "AACCGG 0.5\n"), 2).first().seq == "CC"
    assays = text.assays(spark, put(tmp_path, "k", "@a\n0 1 2\nx y\n1 3 4\n@b\n0 5\n@a\n0 9\n"))
    assert assays.count() == 5
    atom = "ATOM      1  P    DA I   1      10.000  20.000  30.000  1.00 40.00"
    assert text.atoms(spark, put(tmp_path, "p", atom + "\n")).first().kind == "DNA"


def test_signal_file_to_peaks(spark, tmp_path):
    top, bottom = [0.0] * 20, [0.0] * 20
    top[3], top[6], bottom[13] = 5.0, 2.0, 4.0
    dyad = [(top[i - 5] if i >= 5 else 0.0) + (bottom[i + 5] if i + 5 < 20 else 0.0) for i in range(20)]
    listed = lambda v: ",".join(map(str, v))
    body = f"@ref_length\t20\n@left_offset\t5\n@right_offset\t5\n\n>a\n@Sequence\nACGGT\n@TopCleavageCounts\n{listed(top)}\n@BottomCleavageCounts\n{listed(bottom)}\n@PositioningSignal\n{listed(dyad)}\n"
    rows = text.signal_file(spark, put(tmp_path, "b.data", body))
    signal = G.to_rows(rows, ["id"], "dyad")
    assert [(p.pos, p.value) for p in G.peaks(signal, ["id"], 2).orderBy("rank").collect()] == [(8, 9.0), (11, 2.0)]
    assert abs(G.location(signal, ["id"]).first().mean_pos - (8 * 9 + 11 * 2) / 11) < 1e-9
    assert rows.select(S.gc_percent(rows.seq)).first()[0] == 60.0


def test_sam_tag_values_hold_blanks(spark, tmp_path):
    row = text.sam(spark, put(tmp_path, "b.sam", "r1\t0\tref\t5\t42\t4M\t*\t0\t0\tACGT\tGGGG\tCO:Z:two  words\tNM:i:1\n")).first()
    assert (row.tags["CO"], row.nm) == ("two  words", 1)


def test_memo_computes_once(spark, tmp_path):
    from strandloom.sources import memo

    calls = []

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "kept")
    assert [memo.load_or_compute(spark, path, compute).count() for _ in range(2)] == [1, 1]
    assert memo.load_or_compute(spark, path, compute, again=True).count() == 2 and len(calls) == 2
    (tmp_path / "kept" / "_SUCCESS").unlink()
    assert memo.load_or_compute(spark, path, compute).count() == 3
    assert memo.common_stem(["a/lib_rep1.sort", "a/lib_rep2.sort"]) == "a/lib_rep" and memo.common_stem(["x.a", "y.a"]) is None
