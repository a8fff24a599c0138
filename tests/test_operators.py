"""Reads, imputation, joins, sampling and streaming against small truths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.models import simulate
from strandloom.operators import divergence as D
from strandloom.operators import gibbs as B
from strandloom.operators import impute as I
from strandloom.operators import joins as J
from strandloom.operators import reads as R
from strandloom.operators import sampling as P
from strandloom.operators import signal as G

TEMPLATE = "".join("ACGT"[(i * i + 3 * i + i // 7) % 4] for i in range(60))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_sequence_functions(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="aaCNg") == "CNGTT"
    assert one(spark, S.reverse_complement(S.reverse_complement(F.col("s"))), s="ACGGT") == "ACGGT"
    assert one(spark, S.extinction(F.col("s")), s="ACG") == 21200 + 18000 - 7400
    assert one(spark, S.dinucleotide_count(F.col("s"), "aa"), s="AAAT") == 2
    v = one(spark, S.variant(F.col("s")), s="12-D-ACG")
    assert (v.loc, v.mtype, v.size) == (12, "D", 3)
    assert one(spark, S.variant(F.col("s")), s="601") is None and one(spark, S.variant(F.col("s")), s="AAA-7").loc == 7
    frame = spark.createDataFrame([(1, "AAxxB", "AAyxC")], "k int, a string, b string")
    assert [(r.start, r.size) for r in S.mismatch_runs(frame, "k", "a", "b").collect()] == [(2, 1), (4, 1)]


def test_windows_follow_indels(spark):
    refs = spark.createDataFrame([("3-I-GG,10-M-A",), ("601",)], "ref_id string")
    w = {r.ref_id: r.windows for r in R.identification_windows(refs).collect()}
    assert [(x.mtype, x.st, x.ed) for x in w["3-I-GG,10-M-A"]] == [("I", 3, 6), ("M", 12, 12)] and "601" not in w


def sam(spark, rows):
    return spark.createDataFrame(rows, "read_id string, flag int, rname string, pos int, cigar string, seq string, nm int")


def test_classify_direct(spark):
    n = len(TEMPLATE)
    other = {"A": "C", "C": "A", "G": "T", "T": "G"}
    change = lambda i: TEMPLATE[:i] + other[TEMPLATE[i]] + TEMPLATE[i + 1 :]
    name = f"30-M-{other[TEMPLATE[30]]}"
    refs = spark.createDataFrame([(name, change(30)), ("BACKBONE", TEMPLATE)], "ref_id string, seq string")
    rows = [
        ("left", 0, "BACKBONE", 0, "50M", change(30)[:50], 1), ("right", 0, "BACKBONE", 15, f"{n - 15}M", change(30)[15:], 1),
        ("free", 0, "BACKBONE", 0, f"{n}M", change(30), 1), ("none", 0, "BACKBONE", 0, "50M", TEMPLATE[:50], 0),
        ("edge", 0, "BACKBONE", 0, "31M", change(30)[:31], 1), ("lost", 4, "*", -1, "*", "ACGT", 0), ("frag", 0, "BACKBONE", 15, "30M", change(30)[15:45], 1),
    ]
    got = {r.read_id: (r.type, r.cut_loc) for r in R.classify_direct(sam(spark, rows), refs, TEMPLATE).collect()}
    assert got == {"left": ("valid", "L:50"), "right": ("valid", "R:14"), "free": ("freeDNA", "NA"), "none": ("unIden", "NA"), "edge": ("unIden", "NA"), "lost": ("mutant", "NA"), "frag": ("frag", "NA")}


def test_variant_calls_with_indels(spark):
    read = TEMPLATE[:20] + "GG" + TEMPLATE[20:30] + TEMPLATE[33:50]
    row = R.variant_calls(sam(spark, [("a", 0, "x", 0, "20M2I10M3D17M", read, 5)]), TEMPLATE).first()
    assert sorted(row.calls) == sorted(["19-I-GG", f"30-D-{TEMPLATE[30:33]}"]) and row.aligned_end == 50


def test_classify_by_windows(spark):
    ref = TEMPLATE[:30] + "T" + TEMPLATE[31:] if TEMPLATE[30] != "T" else TEMPLATE[:30] + "A" + TEMPLATE[31:]
    refs = spark.createDataFrame([("30-M-" + ref[30], ref)], "ref_id string, seq string")
    rows = [("good", 0, "30-M-" + ref[30], 0, "50M", ref[:50], 0), ("bad", 0, "30-M-" + ref[30], 0, "50M", TEMPLATE[:50], 1), ("far", 0, "30-M-" + ref[30], 35, "25M", ref[35:], 0)]
    got = {r.read_id: r.type for r in R.classify(sam(spark, rows), refs).collect()}
    assert got == {"good": "valid", "bad": "unIden", "far": "unIden"}


def test_cuts_by_variant(spark):
    rows = [("a", "valid", "100-M-AA", "R:90", "N"), ("b", "valid", "100-M-AA", "R:99", "N"), ("c", "valid", "100-I-AA", "L:150", "N"), ("d", "valid", "601", "R:10", "N"), ("e", "frag", "601", "NA", "N"), ("f", "valid", "100-D-AAA", "L:160", "N")]
    found = {(r.id, r.side): r for r in R.cuts(spark.createDataFrame(rows, "read_id string, type string, mapped_id string, cut_loc string, read_seq string")).collect()}
    assert set(found) == {("100-M-AA", "R"), ("100-I-AA", "L"), ("601", "R"), ("100-D-AAA", "L")}
    assert found["100-I-AA", "L"].cut == 148 and found["100-D-AAA", "L"].tlen == 222 and found["601", "R"].pos == 63


def test_imputation_recovers_hidden_cuts(spark):
    truth = simulate.simulated_counts(spark, 12, length=120, offset=20, centres=(40, 60, 80), width=30, depth=60.0, noise=0.0, seed=3)
    hidden = truth.select("id", F.lit(55).alias("wst"), F.lit(60).alias("wed"), F.transform("top", lambda x, i: F.when(i >= 55, 0.0).otherwise(x)).alias("top"), F.transform("bottom", lambda x, i: F.when(i <= 60, 0.0).otherwise(x)).alias("bottom"), F.lit("g").alias("g"), F.col("dyad").alias("truth"))
    for filled in (I.naive(hidden, 20), I.linear(hidden, ["g"], 20), B.bayesian(hidden, ["g"], 20, rounds=4, inner=6, burn=1)):
        rows = filled.select("dyad", "truth", "top").collect()
        assert all(len(r.dyad) == 120 for r in rows)
        if "g" in filled.columns and filled.count():
            assert np.mean([np.corrcoef(r.dyad[20:100], r.truth[20:100])[0, 1] for r in rows]) > 0.5


def test_huber_ignores_an_outlier():
    x = np.arange(30.0)
    y = 2 * x + 1
    y[5] = 500
    slope, const, inner = I.huber(x, y)
    assert abs(slope - 2) < 0.05 and not inner[5]


def test_interval_join_equals_nested_loop(spark):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.uniform(0, 100, 80))], "i int, p double")
    spans = spark.createDataFrame([(j, float(a), float(a + w)) for j, (a, w) in enumerate(zip(rng.uniform(-5, 100, 60), rng.uniform(0, 30, 60)))], "j int, lo double, hi double")
    got = J.interval_join(points, spans, "p", "lo", "hi", 7.0).select("i", "j")
    want = points.join(spans, (F.col("p") > F.col("lo")) & (F.col("p") < F.col("hi"))).select("i", "j")
    assert sorted(got.collect()) == sorted(want.collect())


def test_masses_and_divergence(spark):
    rows = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 5.0]), (3, [1.0, 1.0, 0.0])], "id int, v array<double>")
    got = {(r.id1, r.id2): r.js for r in D.pair_divergences(rows, "id", "v").collect()}
    assert got[1, 2] == pytest.approx(1.0) and got[1, 3] == pytest.approx(0.0)


def test_empty_signal(spark):
    empty = spark.createDataFrame([], "id int, pos int, value double")
    assert G.peaks(G.densify(empty, ["id"], 0, 9), ["id"]).count() == 0 and G.normalise(empty, ["id"]).count() == 0


def test_sampling_language(spark):
    ids = spark.createDataFrame([("5-M-AA", 1.0), ("9-I-C", 2.0), ("12-M-AAA", 3.0)], "id string, x double")
    pick = lambda spec: sorted(r.id for r in P.sample(ids, "id", spec, {"x": "x"}).collect())
    assert pick("POS:5,..,9") == ["5-M-AA", "9-I-C"] and pick("size:3") == ["12-M-AAA"] and pick("x:2,..") == ["12-M-AAA", "9-I-C"]
    assert pick("ID:9-I-C") == ["9-I-C"] and len(pick("r:2")) == 2 and len(pick("obs:x/t/2/1")) >= 2
    with pytest.raises(ValueError):
        pick("what:1")


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = [(f"r{i}", "valid", "601", f"{'LR'[i % 2]}:{60 + i % 40}", "N") for i in range(200)]
    schema = "read_id string, type string, mapped_id string, cut_loc string, read_seq string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    from strandloom.streaming import counts

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = counts.dyads(stream).writeStream.format("memory").queryName("dyads").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    batch = R.dyad_histogram(R.cuts(spark.createDataFrame(rows, schema)))
    assert sorted(spark.table("dyads").collect()) == sorted(batch.collect())


def test_asof_along_a_strand(spark):
    genes = spark.createDataFrame([(1, "c", "+", 100, 200), (2, "c", "-", 300, 180), (3, "c", "+", 210, 215), (4, "d", "-", 50, 10)], "gene int, chr string, strand string, tss int, tes int")
    marks = spark.createDataFrame([("c", 90, 1), ("c", 150, 2), ("c", 190, 3), ("c", 290, 4)], "chr string, pos int, n int")
    got = {r.gene: (r.near_pos, r.near_n) for r in J.asof_strand(genes, marks, ["chr"], "tss", "tes", "strand", "pos", ["n"]).collect()}
    assert got == {1: (150, 2), 2: (290, 4), 3: (None, None), 4: (None, None)}
    spans = genes.select("gene", "chr", "strand", F.least("tss", "tes").alias("lo"), F.greatest("tss", "tes").alias("hi"))
    order = J.interval_order(marks, spans, "pos", "lo", "hi", "strand", ["gene"], 100, ["chr"])
    assert {(r.gene, r.pos): r.order for r in order.collect()} == {(1, 150): 1, (1, 190): 2, (2, 290): 1, (2, 190): 2}


def test_pieces_of_wide_letters(spark):
    rows = spark.createDataFrame([("x😀y\n😀z",), ("ab",), ("",)], "t string")
    assert [r.p for r in rows.select(S.pieces(F.col("t"), 3).alias("p")).collect()] == [["x😀y", "😀y\n", "y\n😀", "\n😀z"], [], []]


def test_containment_places(spark):
    texts = spark.createDataFrame([(1, "aaaaaXYaaaaa"), (2, "none"), (1, "aaaaaXYaaaaa")], "tid int, t string")
    asked = spark.createDataFrame([(7, "aaaa"), (8, "aXYaa"), (9, "abcd")], "qid int, q string")
    got = sorted(tuple(r) for r in J.containment(asked, texts.dropDuplicates(), "qid", "q", "tid", "t", 4, unique=False).collect())
    assert got == [(7, 1, 0), (7, 1, 1), (7, 1, 7), (7, 1, 8), (8, 1, 4)]
    assert [r.qid for r in J.containment(asked, texts.dropDuplicates(), "qid", "q", "tid", "t", 4).collect()] == [8]


def test_sample_of_each_cluster(spark):
    frame = spark.createDataFrame([(str(i), i % 3) for i in range(30)] + [("x", 9)], "id string, c int")
    got = P.sample(frame, "id", "cluster:c/4", {"c": "c"}, seed=1)
    assert {r.cluster: r["count"] for r in got.groupBy("cluster").count().collect()} == {0: 4, 1: 4, 2: 4, 9: 1}
    assert sorted(got.collect()) == sorted(P.sample(frame.repartition(5), "id", "cluster:c/4", {"c": "c"}, seed=1).collect())


def test_ranks_of_a_value_that_most_rows_hold(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.col("id")).otherwise(4).alias("v"))
    got = {r["id"]: r["rank"] for r in P.global_rank(rows, "v", "id").collect()}
    want = sorted((r["v"] is None, r["v"] or 0, r["id"]) for r in rows.collect())
    assert got == {k[2]: i + 1 for i, k in enumerate(want)}
    assert P.global_rank(rows.limit(0), "v", "id").collect() == []


def test_folds_are_even(spark):
    sizes = sorted(r["count"] for r in P.folds(spark.range(103), "id", 10, 3).groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3
