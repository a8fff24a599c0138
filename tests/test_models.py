"""Models against closed forms and small numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.models import markov, matrices, regression, simulate


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x, n, alpha = rng.normal(size=(40, 3)), 40, 0.5
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=40) * 0.1
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    got, intercept = regression.ridge(frame, ["a", "b", "c"], "y", alpha)
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(got, want, atol=1e-8) and abs(intercept - (y.mean() - x.mean(0) @ want)) < 1e-8 and n == 40


def test_curves(spark):
    t = np.linspace(0, 10, 30)
    rows = [("a", float(x), float(3 * np.exp(-0.7 * x) + 1)) for x in t]
    r = regression.curve_fits(spark.createDataFrame(rows, "k string, t double, y double"), "k", "t", "y", "decay").first()
    assert r.parameters == pytest.approx([3, 0.7, 1], abs=1e-4)


def test_placement_sums(spark):
    w = [0.3, -0.2, 0.5, 0.1]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(w)], "id string, start int, score double")
    got = {r.start: r.probability for r in markov.placement(rows, ["id"], 2).collect()}
    weight, each = 0.0, np.zeros(4)
    for pick in range(16):  # all sets of starts two apart at least
        on = [i for i in range(4) if pick >> i & 1]
        if all(b - a >= 2 for a, b in zip(on, on[1:])):
            v = np.exp(sum(w[i] for i in on))
            weight += v
            each[on] += v
    assert [got[i] for i in range(4)] == pytest.approx(list(each / weight))


def test_natural_breaks():
    assert matrices.natural_breaks(np.array([1, 2, 1, 50, 52, 51, 99, 100.0]), 3) == [2.0, 52.0, 100.0]


def test_nmf_fits_a_low_rank_matrix(spark):
    rng = np.random.default_rng(2)
    x = rng.random((30, 2)) @ rng.random((2, 12))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    weights, basis, error = matrices.nmf(frame, "id", "v", 2, rounds=25)
    assert error < 0.05 * np.linalg.norm(x) and (basis >= 0).all() and weights.count() == 30


def test_clusterings_split_two_groups(spark):
    ids = range(8)
    pairs = [(i, j, 0.05 if (i < 4) == (j < 4) else 1.0) for i in ids for j in ids if i < j]
    frame = spark.createDataFrame(pairs, "id1 long, id2 long, d double")
    split = lambda f: {tuple(sorted(g["id"])) for _, g in f.groupby("cluster")}
    want = {(0, 1, 2, 3), (4, 5, 6, 7)}
    assert split(matrices.average_linkage(frame, "d", 0.5)[0]) == want
    assert split(matrices.spectral(frame.withColumn("score", F.exp(-10 * F.col("d"))), 2)) == want
    assert matrices.tsne(frame, "d", rounds=50).shape == (8, 3)


def test_descendants(spark):
    tree = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("x", "y")], "parent string, child string")
    assert sorted(r.node for r in matrices.descendants(tree, "r").collect()) == ["a", "b", "c"]


def test_caliber_keeps_the_stationary_distribution():
    p = np.array([0.2, 0.3, 0.5])
    joint, mean = simulate.steady_path(p, np.ones((3, 3)), np.abs(np.subtract.outer(range(3), range(3))).astype(float), 0.5)
    assert np.allclose(joint.sum(0), p) and np.allclose(joint.sum(1), p) and mean > 0


def test_kinetic_traces_repeat(spark):
    rates = simulate.energy_rates(np.zeros(5), 1.0)
    a = simulate.kinetic_traces(spark, rates, 5, 10.0, 2, seed=1)
    assert a.count() > 20 and sorted(a.collect()) == sorted(a.repartition(3).collect())


def test_deconvolution_finds_the_centre(spark):
    top, bottom = [0.0] * 60, [0.0] * 60
    top[20], bottom[40] = 50.0, 50.0
    row = simulate.deconvolve(spark.createDataFrame([(1, top, bottom)], "id int, top array<double>, bottom array<double>"), "id", {"R": {-10: 1.0}, "L": {10: 1.0}}).first()
    assert int(np.argmax(row.dyad)) == 30


def test_prior_integrates_to_one():
    x = np.linspace(1e-3, 30, 4000)
    assert np.trapezoid([simulate.ratio_prior(v, 2.0, 3, 400) for v in x], x) == pytest.approx(1.0, abs=0.02)


def test_registered_models_run_their_default_rounds(spark, sf, monkeypatch):
    from strandloom.operators import gibbs
    from strandloom.plans import catalog

    class Called(Exception):
        pass

    def record(*_, **given):
        raise Called(given)

    for where, name, query in ((gibbs, "bayesian", "bayes_impute"), (matrices, "nmf", "nmf"), (matrices, "tsne", "tsne"), (simulate, "deconvolve", "em_deconvolution")):
        monkeypatch.setattr(where, name, record)
        with pytest.raises(Called) as found:
            catalog.QUERIES[query](spark, sf)
        assert not {"rounds", "cycles", "burn"} & set(found.value.args[0])


def test_driven_walk_has_the_distribution_asked_for():
    start, asked = np.array([0.2, 0.3, 0.5]), np.array([0.5, 0.1, 0.4])
    gap = np.abs(np.arange(3)[:, None] - np.arange(3)[None])
    joint, _ = simulate.equilibrium_path(start, np.ones((3, 3)), gap.astype(float), 1.0)
    walk = simulate.driven_path(asked, joint / start[:, None])
    assert np.allclose(walk.sum(1), 1) and np.allclose(asked @ walk, asked)


def test_reads_with_indels_keep_their_truth(spark):
    refs = spark.createDataFrame([("601", "ACGT" * 50)], "ref_id string, seq string")
    rows = simulate.simulated_reads(refs, 40, left=0.0, right=0.0, indel=0.1).collect()
    assert {r.read_id.split("/")[1] for r in rows} == {"601"} and len({len(r.seq) for r in rows}) > 5 and all(len(r.seq) == len(r.qual) for r in rows)


def test_bisections_find_nested_blocks(spark):
    block = lambda i: (i // 4, i // 2)
    near = lambda i, j: 0.9 if block(i)[1] == block(j)[1] else 0.4 if block(i)[0] == block(j)[0] else 0.01
    pairs = spark.createDataFrame([(i, j, near(i, j)) for i in range(8) for j in range(i + 1, 8)], "id1 int, id2 int, score double")
    path = matrices.bisections(pairs).set_index("id")["path"]
    assert [path[i] for i in range(8)] == ["LL", "LL", "LR", "LR"] + ["RL", "RL", "RR", "RR"]


def test_nmf_errors_fall_with_the_rank(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rng.random((12, 2)) @ rng.random((2, 6)))], "id int, v array<double>")
    errors = matrices.nmf_errors(rows, "id", "v", [1, 2], rounds=30)["error"]
    assert errors[1] < errors[0] / 3
