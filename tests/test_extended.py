"""Record source, sampler, mapping and models against plain versions."""

import gzip
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.models import markov, matrices, regression
from strandloom.operators import gibbs, impute, mapping, reads
from strandloom.operators import signal as G
from strandloom.sources import records, text
from strandloom.streaming import counts

# -- records -----------------------------------------------------------------------------------------------------------


def fastq_lines(n, rng, end="\n"):
    out = []
    for i in range(n):
        k = rng.randrange(1, 60)
        quality = "".join(rng.choice("@+>IG#") for _ in range(k))
        out.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(k)), quality))
    return out, "".join(f"@{a} x y{end}{s}{end}+{a}{end}{q}{end}" for a, s, q in out)


@pytest.mark.parametrize("split", [1, 37, 100, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_cut_anywhere(tmp_path, split, end):
    want, body = fastq_lines(60 if split == 1 else 300, random.Random(split), end)
    (tmp_path / "a.fq").write_text("\n" + body + "\n\n", newline="")
    reader = records.RecordReader({"path": str(tmp_path / "a.fq"), "mark": records.FOUR_LINES, "splitBytes": str(split)})
    got = [r["lines"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(l[0].split()[0][1:], l[1], l[3]) for l in got] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab >@", max_size=9), min_size=1, max_size=4), max_size=8), st.integers(1, 40))
def test_marked_records_cut_anywhere(tmp_path_factory, bodies, split):
    path = tmp_path_factory.mktemp("r") / "x.txt"
    want = [[f">{i}", *(line for line in body if not line.startswith(">"))] for i, body in enumerate(bodies)]
    path.write_text("@length 7\nnoise\n" + "".join("\n".join(r) + "\n" for r in want))
    reader = records.RecordReader({"path": f"file://{path}", "mark": ">", "splitBytes": str(split), "head": "true"})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["lines"] for r in got] == want and all(dict(r["head"]) == {"length": "7"} for r in got)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    want, body = fastq_lines(20_000, random.Random(2))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_text(body)
    (tmp_path / "in" / "_hidden").write_text("no record")
    with gzip.open(tmp_path / "in" / "b.fq.gz", "wt") as f:
        f.write(body)
    found = text.fastq(spark, str(tmp_path / "in"), split_bytes=len(body) // 16)
    assert found.rdd.getNumPartitions() >= 17
    assert sorted(tuple(r) for r in found.collect()) == sorted(want * 2)


def test_a_broken_record_is_told(tmp_path):
    (tmp_path / "a.fq").write_text("@a\nAC\n+\nGG\n@b\nACG\n+\nG\n")
    reader = records.RecordReader({"path": str(tmp_path / "a.fq"), "mark": records.FOUR_LINES})
    with pytest.raises(ValueError, match="byte 11"):
        [list(reader.read(p)) for p in reader.partitions()]


def test_no_files_and_no_records(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "empty.fq").write_text("")
    assert text.fastq(spark, str(tmp_path / "none")).collect() == []
    assert text.fastq(spark, str(tmp_path / "empty.fq")).collect() == []


def test_tricky_headers(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">ref|NC_1| [org=S c] [strain=S288C] [moltype=genomic] [chromosome=IV] [x=y]\nACGT\nAC\n>plain one\nTT\n")
    assert sorted(tuple(r) for r in text.fasta(spark, str(tmp_path / "g.fa"), tricky=True).collect()) == [("chrIV", "ACGTAC"), ("plain", "TT")]


# -- imputation --------------------------------------------------------------------------------------------------------


def hidden_cuts(n=40, length=120, offset=20, seed=5):
    rng = np.random.default_rng(seed)
    centres = np.arange(offset, length - offset)
    ratio = 0.5 + 0.3 * np.sin(centres / 9.0)
    depth = rng.gamma(2.0, 15.0, (n, len(centres)))
    top, bottom = np.zeros((n, length)), np.zeros((n, length))
    top[:, centres - offset], bottom[:, centres + offset] = rng.poisson(depth * ratio), rng.poisson(depth * (1 - ratio))
    wst = rng.integers(20, 90, n)
    at = np.arange(length)[None]
    no_top, no_bottom = at >= wst[:, None], at <= (wst + 5)[:, None]
    rows = [(i, "g" if i % 2 else None, int(wst[i]), int(wst[i]) + 5, np.where(no_top[i], 0.0, top[i]).tolist(), np.where(no_bottom[i], 0.0, bottom[i]).tolist()) for i in range(n)]
    no_top[:, length - 2 * offset :] = False
    no_bottom[:, : 2 * offset] = False
    return rows, top, bottom, no_top, no_bottom


def test_sampler_recovers_hidden_cuts_better_than_copies(spark):
    rows, top, bottom, no_top, no_bottom = hidden_cuts()
    df = spark.createDataFrame(rows, "id int, g string, wst int, wed int, top array<double>, bottom array<double>")

    def error(filled):
        got = {r.id: r for r in filled.collect()}
        t, b = (np.array([got[i][c] for i in range(len(rows))]) for c in ("top", "bottom"))
        assert (t[~no_top] == np.array([r[4] for r in rows])[~no_top]).all()
        return ((t - top)[no_top] ** 2).mean() + ((b - bottom)[no_bottom] ** 2).mean()

    run = lambda: gibbs.bayesian(df.repartition(3), ["g"], 20, rounds=5, inner=6, burn=2)
    first = run()
    assert error(first) < error(impute.naive(df, 20)) / 2
    # the same draws wherever the rows lie
    assert sorted(map(str, first.collect())) == sorted(map(str, gibbs.bayesian(df.coalesce(1), ["g"], 20, rounds=5, inner=6, burn=2).collect()))


def test_sampler_of_no_rows(spark):
    none = spark.createDataFrame([], "id int, g string, wst int, wed int, top array<double>, bottom array<double>")
    assert gibbs.bayesian(none, ["g"], 20).columns == [*none.columns, "dyad"]


def test_running_medians(spark):
    rng = np.random.default_rng(1)
    draws = rng.poisson(rng.gamma(3, 9, 200), (400, 200)).astype(float)
    heights, places = np.zeros((5, 200)), np.zeros((5, 200))
    for n, x in enumerate(draws, 1):
        heights, places = gibbs.median_marks(heights, places, n, x)
    assert np.abs(gibbs.median_of(heights, 400) - np.median(draws, axis=0)).max() <= 1.5
    assert (gibbs.median_of(draws[:4].copy(), 4) == np.median(draws[:4], axis=0)).all()


def test_lines_of_counts_equal_lines_of_rows(spark):
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = rng.poisson(9, 40).astype(float)
        y = (rng.poisson(2, 40) + 2 * x).round()
        pairs, n = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
        whole = impute.huber(x, y)
        told = impute.huber(pairs[:, 0], pairs[:, 1], n.astype(float))
        assert told[:2] == pytest.approx(whole[:2], rel=1e-6, abs=1e-6)
        assert impute.middle(pairs[:, 1], n) == np.median(y)


# -- mapping -----------------------------------------------------------------------------------------------------------


def back(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("chunk", [16, 50, 4096])
def test_hits_equal_plain_search(spark, chunk):
    rng = random.Random(chunk)
    genome = {f"c{i}": "".join(rng.choice("ACGT" if i else "A") for _ in range(n)) for i, n in enumerate((90, 700, 333, 1))} | {"none": "", "null": None}
    asked = {}
    for i in range(40):
        c = genome[f"c{1 + i % 2}"]
        at = rng.randrange(len(c) - 40)
        s = c[at : at + rng.randrange(6, 40)]
        asked[i] = back(s) if i % 3 else s
    asked |= {50: "A" * 12, 51: "ACGT" * 30, 52: "", 53: None}
    want = set()
    for i, s in asked.items():
        for strand, t in (("+", s), ("-", back(s) if s else s)):
            for c, g in genome.items():
                want |= {(i, c, p, strand) for p in range(len(g or "")) if t and g.startswith(t, p)}
    found = mapping.hits(spark.createDataFrame(list(genome.items()), "chr string, seq string"), spark.createDataFrame(list(asked.items()), "read_id int, seq string"), 8, chunk)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sites_lifted_to_another_genome(spark):
    rng = random.Random(1)
    old = "".join(rng.choice("ACGT") for _ in range(9000))
    new = old[:1000] + "TTT" + old[1000:5000] + old[4700:5000] + old[5000:]
    genomes = [spark.createDataFrame([("c", g)], "chr string, seq string") for g in (old, new)]
    sites = spark.createDataFrame([(1, "c", 500), (2, "c", 2000), (3, "c", 4850), (4, "c", 1000)], "id int, chr string, pos bigint")
    got = {r.id: (r.new_pos, r.places) for r in mapping.lifted(sites, *genomes, flank=50, reach=3000).collect()}
    assert got == {1: (450, 1), 2: (1953, 1), 3: (None, 2)}


# -- models ------------------------------------------------------------------------------------------------------------


def test_interpolation_is_never_below_an_order(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("AC" if (i + p) % 3 else "ACGT") for p in range(12))) for i in range(60)]
    seqs = spark.createDataFrame(rows, "k int, s string")
    model, weights, said = markov.interpolated(seqs, "k", "s", 2, 4, rounds=40)
    assert sum(weights) == pytest.approx(1.0)
    assert all(x is None or said[0] >= x - 1e-9 for x in said[1:]) and said[0] > np.log(0.25)
    scores = markov.mixed_score(seqs, "k", "s", model, weights).collect()
    assert len(scores) == 60 and all(np.isfinite(r.score) for r in scores)


def test_planted_outliers_dont_move_the_envelope(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 400), rng.normal(12, 0.1, (80, 2))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, pcs array<double>")
    found = {r.k: r.distance for r in matrices.robust_envelope(rows, "k").collect()}
    assert min(found[i] for i in range(400, 480)) > 2 * max(found[i] for i in range(400))
    plain = {r.k: r.distance for r in matrices.outliers(rows, "k").collect()}
    assert min(plain[i] for i in range(400, 480)) < max(plain[i] for i in range(400))


def test_leading_vectors_equal_the_exact_ones(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.4, (12, 3)) for c in (0, 2, 5)])
    n = len(x)
    s = np.exp(-((x[:, None] - x[None]) ** 2).sum(2))
    pairs = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(n) for j in range(i + 1, n)], "id1 int, id2 int, score double")
    found, values = matrices.leading_vectors(pairs, "score", 3)
    got = np.array([r.vector for r in found.orderBy("id").collect()])
    root = np.sqrt(s.sum(1))
    exact_values, exact = np.linalg.eigh(s / root[:, None] / root[None])
    assert values == pytest.approx(exact_values[::-1][:3], abs=1e-8)
    assert np.abs(got @ got.T - exact[:, -3:] @ exact[:, -3:].T).max() < 1e-4
    clusters = matrices.spectral_clusters(pairs, 3)
    assert clusters.groupBy("cluster").count().select("count").collect() == [(12,)] * 3
    coordinates = np.array([r.coordinates for r in matrices.diffusion_coordinates(pairs.withColumn("d", F.sqrt(-F.log("score"))), "d", 0.5).orderBy("id").collect()])
    plain = np.array(matrices.diffusion_map(pairs.withColumn("d", F.sqrt(-F.log("score"))), "d", 0.5)["coordinates"].tolist())
    assert np.abs(np.abs(coordinates) - np.abs(plain)).max() < 1e-4


def test_descendants_deep_and_in_cycles(spark):
    chain = [(str(i), str(i + 1)) for i in range(40)]
    rows = [*chain, ("40", "12"), ("a", "b"), ("b'", "c"), ("0", "b'"), ("5", "c"), (None, "z"), ("0", None)]
    tree = spark.createDataFrame(rows, "parent string, child string")
    below = lambda root: sorted(r.node for r in matrices.descendants(tree, root).collect())
    assert below("0") == sorted([*(str(i) for i in range(1, 41)), "b'", "c"])
    assert below("40") == sorted([*(str(i) for i in range(12, 41))]) and below("b'") == ["c"] and below("none") == []


def test_many_children(spark):
    tree = spark.range(1_200_000).select(F.lit(0).alias("parent"), (F.col("id") + 1).alias("child"))
    assert matrices.descendants(tree, 0).count() == 1_200_000


def test_breaks_of_counts(spark):
    rng = np.random.default_rng(0)
    for _ in range(40):
        v = rng.poisson(rng.choice([1, 5, 40], size=rng.integers(6, 60))).astype(float)
        u, n = np.unique(v, return_counts=True)
        k = min(3, len(u))
        ends = matrices.natural_breaks(u, k, n)
        assert ends == matrices.natural_breaks(v, k)
        cost = lambda e: sum(((p - p.mean()) ** 2).sum() for p in np.split(np.sort(v), np.searchsorted(np.sort(v), e, side="right")) if len(p))  # noqa: B023, E731
        assert cost(ends) == pytest.approx(min(cost([a, b]) for a in u for b in u if a <= b) if k == 3 else cost(ends))


def test_blocks_of_the_normal_matrix(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(200, 3)), rng.normal(size=(200, 4))
    a[5, 1] = np.nan
    y = a[:, 0] - 2 * b[:, 3] + rng.normal(0, 0.1, 200)
    rows = spark.createDataFrame([(a[i].tolist(), b[i].tolist(), float(y[i])) for i in range(200)], "a array<double>, b array<double>, y double").repartition(5)
    found = regression.block_ridge(rows, ["a", "b"], "y", 0.5)
    x = np.hstack([a[:, [0, 2]], b])
    want = np.linalg.solve(x.T @ x + 0.5 * np.eye(6), x.T @ y)
    assert [found["a"][0], found["a"][2], *found["b"]] == pytest.approx(want.tolist()) and found["a"][1] == 0.0
    assert regression.block_predict(rows, found).where("prediction IS NULL OR isnan(prediction)").count() == 0


def test_features_read_alike_from_both_strands(spark):
    s = "ACGGTTAC"
    rows = spark.createDataFrame([(s, back(s), [1.0, 2.0, 4.0])], "s string, r string, t array<double>")
    r = rows.select(regression.symmetric_steps(F.col("s"), 8, 2).alias("a"), regression.symmetric_steps(F.col("r"), 8, 2).alias("b"), regression.symmetric_track(F.col("t")).alias("t")).first()
    assert r.a == r.b and len(r.a) == 7 * 16 and sum(r.a) == 7 and r.t == [2.5, 2.0, 2.5]
    cells = spark.createDataFrame([(k, p, float(10 * k + p), [float(k), 1.0]) for k in range(3) for p in range(4)], "k int, p int, v double, x array<double>")
    assert {(r.k, r.p): (r.v, r.x) for r in regression.against_place(cells, "k", "p", 1, ["v", "x"]).collect()} == {(k, p): (p - 1.0, [0.0, 0.0]) for k in range(3) for p in (0, 2, 3)}
    assert {r.v for r in regression.against_key(cells, "k", "p", 1, ["v", "x"]).collect()} == {-10.0, 10.0}


def test_resampling_equals_interpolation(spark):
    rng = np.random.default_rng(2)
    x = np.unique(rng.uniform(-3, 25, 30))
    y = rng.normal(size=len(x))
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 5.0, 1.0), (1, None, 3.0)], "k int, x double, y double")
    first, last = int(np.ceil(x[0])), int(x[-1])
    got = {r.pos: r.value for r in G.resampled(rows, ["k"], "x", "y", first, last).collect()}
    assert [got[p] for p in range(first, last + 1)] == pytest.approx(np.interp(range(first, last + 1), x, y).tolist())


# -- streaming ---------------------------------------------------------------------------------------------------------


def test_stream_of_calls_met_with_references(spark, tmp_path):
    refs = spark.createDataFrame([("5-M-A", "ACGT"), ("9-D-CC", "ACG")], "ref_id string, seq string")
    schema = "read_id string, calls array<string>, at timestamp"

    def put(i, rows):
        spark.createDataFrame(rows, "read_id string, calls array<string>, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        writer = counts.probed(stream, refs, "at", "10 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    rows = [("a", ["5-M-A", "7-I-GGG"], "2024-01-01 00:00:00"), ("b", ["9-D-CC"], "2024-01-01 00:05:00"), ("a", ["5-M-A"], "2024-01-01 00:06:00")]
    put(0, rows)
    batch = reads.met_calls(spark.createDataFrame([r[:2] for r in rows[:2]], "read_id string, calls array<string>").select("read_id", F.explode("calls").alias("call")), refs)
    want = sorted(tuple(r) for r in batch.select("read_id", "call", "ref_len", "edit").collect())
    assert run() == want
    # after a restart the state still knows what came, a new read is met, and a late one is left out
    put(1, [("b", ["9-D-CC"], "2024-01-01 00:07:00"), ("c", ["5-M-A"], "2024-01-01 02:00:00")])
    assert run() == sorted([*want, ("c", "5-M-A", 4, 0)])
    put(2, [("late", ["5-M-A"], "2024-01-01 00:01:00"), ("d", ["5-M-A"], "2024-01-01 02:01:00")])
    assert run() == sorted([*want, ("c", "5-M-A", 4, 0), ("d", "5-M-A", 4, 0)])
