"""How the sampler's rows and sums are dealt."""

import numpy as np

from strandloom.operators import gibbs


def test_a_round_has_tasks_by_its_rows(spark, monkeypatch):
    class Ended(Exception):
        pass

    counts = []
    put = gibbs.Settled.put

    def kept(self, frame):
        counts.append(frame.rdd.getNumPartitions())
        if len(counts) == 2:
            raise Ended
        return put(self, frame)

    monkeypatch.setattr(gibbs.Settled, "put", kept)
    rows = spark.range(300).selectExpr("id", "id % 2 AS g", "110 AS wst", "115 AS wed", "array_repeat(1.0D, 225) AS top", "array_repeat(1.0D, 225) AS bottom").coalesce(1)
    try:
        gibbs.bayesian(rows, ["g"], initial="naive")
    except Ended:
        pass
    assert counts[1:] == [3] and gibbs.tasks_of(0) == 1 and gibbs.tasks_of(10**9) == gibbs.MOST_TASKS


def test_profile_equals_the_plain_sums():
    rng = np.random.default_rng(0)
    t, b, d = rng.poisson(0.4, (30, 7)).astype(float), rng.poisson(0.4, (30, 7)).astype(float), rng.gamma(2, 1, (30, 7)) + 0.5
    ratios, noises = gibbs.grid(0.2)
    want = np.stack([gibbs._log_likelihood(t, b, d, r, noise).sum(axis=0) for r in ratios for noise in noises], axis=1)
    assert np.allclose(gibbs.profile(t, b, d, 0.2), want)
