from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.functions import float_label, missing_to_null, uniform, uniform_of
from pairloom.operators import chains as C
from pairloom.operators import diagnostics as D
from pairloom.operators import estimators as E
from pairloom.operators import matching as M
from pairloom.operators import summaries as S


def make_units(spark, n_r=3, n_d=7, sims=2, seed=1):
    rng = np.random.default_rng(seed)
    rows = [
        (s, g * 100 + p, g, float(rng.normal()), float(rng.normal()), float(rng.normal()), p)
        for s in range(sims)
        for g, n in ((1, n_r), (0, n_d))
        for p in range(1, n + 1)
    ]
    return spark.createDataFrame(rows, "sim long, unit long, g int, x1 double, x2 double, y double, p long")


def test_uniform_is_the_same_in_python(spark):
    row = spark.range(5).select("id", uniform("a", F.col("id"), 3).alias("u")).collect()
    assert [r["u"] for r in row] == [uniform_of("a", i, 3) for i in range(5)]


def test_alpha_sums_to_one_and_cdf_rises(spark):
    rows = M.cumulate(M.kernel(M.pair_units(make_units(spark)), 2.0)).orderBy("sim", "rp", "dp").toPandas()
    for _, own in rows.groupby(["sim", "rp"]):
        assert own.alpha.sum() == pytest.approx(1)
        assert own.cdf.is_monotonic_increasing and own.cdf.iloc[-1] == 1.0


def test_beta_zero_is_uniform(spark):
    rows = M.kernel(M.pair_units(make_units(spark)), 0.0).toPandas()
    assert np.allclose(rows.alpha, 1 / 7)


def test_donor_at_distance_zero_raises(spark):
    units = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 1), (1, 2, 0, 0.0, 0.0, 1.0, 1), (1, 3, 0, 1.0, 0.0, 1.0, 2)], make_units(spark).schema)
    with pytest.raises(Exception, match="distance 0"):
        M.kernel(M.pair_units(units)).collect()


def test_ties_go_to_the_first_donor(spark):
    units = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 1), (1, 2, 0, 1.0, 0.0, 1.0, 1), (1, 3, 0, -1.0, 0.0, 2.0, 2)], make_units(spark).schema)
    assert M.nearest(M.pair_units(units), 1).select("dp").first()["dp"] == 1


def test_estimators_against_matrices(spark):
    matches = M.nearest(M.pair_units(make_units(spark)), 2)
    got = E.effects(matches, "sim").orderBy("sim").toPandas()
    for sim, own in matches.toPandas().groupby("sim"):
        t = own.groupby("rp").ry.first()
        y = np.concatenate([t, own.dy])
        g = np.concatenate([np.ones(len(t)), np.zeros(len(own))])
        w = np.where(g == 1, 1.0, 0.5)
        x = np.column_stack([np.ones(len(y)), g])
        row = got[got.sim == sim].iloc[0]
        for weights, value in ((np.ones(len(y)), row.ols_var), (w, row.wls_var)):
            inverse = np.linalg.inv(x.T @ (x * weights[:, None]))
            b = inverse @ x.T @ (weights * y)
            e = y - x @ b
            assert b[1] == pytest.approx(row.est)
            assert (weights * e * e).sum() / (len(y) - 2) * inverse[1, 1] == pytest.approx(value)
        inverse = np.linalg.inv(x.T @ x)
        e = y - x @ (inverse @ x.T @ y)
        cluster = np.concatenate([t.index, own.rp])
        scores = [x[cluster == c].T @ e[cluster == c] for c in t.index]
        meat = sum(np.outer(s, s) for s in scores)
        assert math.sqrt((inverse @ meat @ inverse)[1, 1]) == pytest.approx(row.cluster_se)


def test_cluster_se_and_paired_variance_agree_for_one_to_one(spark):
    rows = E.effects(M.nearest(M.pair_units(make_units(spark, n_r=5)), 1), "sim").toPandas()
    assert np.allclose(rows.cluster_se**2, rows.paired_var * (5 - 1) / 5)


def test_one_draw_has_no_between_variance_and_no_interval(spark):
    draws = spark.createDataFrame([(1, 2.0, 0.5)], "sim long, est double, v double")
    row = E.add_interval(E.pool(draws, ["sim"], "v"), 1.0).first()
    assert row["between_var"] is None and row["ll"] is None and row["covers_true"] is None


def test_missing_interval_counts_as_not_covering(spark):
    rows = spark.createDataFrame([(0.0, 2.0), (float("nan"), 2.0), (None, None), (0.0, float("inf"))], "ll double, ul double")
    assert rows.agg(S.coverage(1.0)).first()[0] == 0.25


def test_mixed(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "x string, y int, z int")
    assert tuple(rows.agg(S.mixed("x"), S.mixed("y"), S.mixed("z")).first()) == ("a", "mixed", "mixed")


def test_cells_and_labels(spark):
    cells = spark.createDataFrame([(c,) for c in ["", "nan", "N/A", " null ", "1.5", "x", None]], "c string")
    assert [r[0] for r in cells.select(missing_to_null(F.col("c"))).collect()] == [None, None, None, None, 1.5, None, None]
    numbers = spark.createDataFrame([(0.0,), (0.25,), (200.0,), (float("inf"),)], "x double")
    assert [r[0] for r in numbers.select(float_label(F.col("x"))).collect()] == ["0", "0.25", "200", "inf"]


def state(seed=3, n_r=2, n_d=4, k=1, key=(0, 1)):
    rng = np.random.default_rng(seed)
    return C.Matching(rng.random((n_r, n_d)), rng.random(n_r), rng.random(n_d), rng.random((n_r, 2)), rng.random((n_d, 2)), np.arange(n_r * k).reshape(n_r, k), key)


STEPS = {
    "local": lambda s, t: C.local_mh(s, t, 2.0, 0.5),
    "block": lambda s, t: C.block_mh(s, t, 2.0, 2),
    "slot": lambda s, t: C.gibbs_slot(s, t, 2.0),
    "sweep": lambda s, t: C.gibbs_sweep(s, t, 2.0),
}


@pytest.mark.parametrize("name", STEPS)
def test_chains_reach_their_target(name):
    s = state()
    weights = {p: math.exp(-2.0 * (s.dist[0, p[0]] + s.dist[1, p[1]])) for p in itertools.permutations(range(4), 2)}
    seen = Counter()
    n = 12_000
    for t in range(1, n + 1):
        STEPS[name](s, t)
        seen[tuple(s.cols[:, 0].tolist())] += 1
    total = sum(weights.values())
    assert max(abs(seen[p] / n - w / total) for p, w in weights.items()) < 0.03


@pytest.mark.parametrize("name", STEPS)
def test_cached_sums_do_not_drift(name):
    s = state(n_r=3, n_d=9, k=2)
    for t in range(1, 400):
        STEPS[name](s, t)
    assert len(set(s.cols.ravel())) == 6 and set(s.cols.ravel()) | set(s.free) == set(range(9))
    assert s.distance == pytest.approx(np.take_along_axis(s.dist, s.cols, axis=1).sum())
    assert s.matched_y == pytest.approx(s.y_d[s.cols].sum())
    assert np.allclose(s.matched_x, s.x_d[s.cols].sum(axis=(0, 1)))
    assert s.retained == sum(len(set(a) & b) for a, b in zip(s.cols.tolist(), s.initial, strict=True))


def test_no_free_donors():
    s = state(n_r=2, n_d=4, k=2)
    assert C.gibbs_slot(s, 1, 1.0) == (0, "gibbs_degenerate_no_unmatched")
    assert {C.local_mh(s, t, 1.0, 0.0)[1] for t in range(20)} == {"unmatched_swap_none"}
    with pytest.raises(ValueError, match="block"):
        C.block_mh(s, 1, 1.0, 2)


def test_infeasible_starts_raise():
    for make in (lambda: C.greedy(np.ones((3, 4)), 2), lambda: C.random_start(3, 4, 2, (0, 1))):
        with pytest.raises(ValueError, match="donors"):
            make()


def test_two_draws_have_exact_frequencies(spark):
    weighted = M.kernel(M.pair_units(make_units(spark, n_r=1, n_d=4, sims=1)))
    w = {r["dp"]: r["alpha"] / (1 - r["alpha"]) for r in weighted.collect()}
    pairs = {p: w[p[0]] * w[p[1]] for p in itertools.combinations(sorted(w), 2)}
    seen = Counter((r["d1"], r["d2"]) for r in M.draw_many(weighted, 4000).collect())
    assert max(abs(seen[p] / 4000 - v / sum(pairs.values())) for p, v in pairs.items()) < 0.03


def test_unconstrained_chain_moves_one_donor(spark):
    rows = C.run_unconstrained(M.sized(make_units(spark, n_r=1, n_d=5, sims=1)), 50).toPandas()
    sets = rows.groupby("iter").dp.apply(set).tolist()
    assert all(len(s) == 2 for s in sets) and all(len(a & b) >= 1 for a, b in itertools.pairwise(sets))


def test_diagnostics_of_odd_chains(spark):
    rows = [(1, i, 5.0) for i in range(1, 11)] + [(2, i, float(i % 2)) for i in range(1, 11)] + [(3, 1, 1.0)] + [(4, 1, float("nan")), (4, 2, 1.0)]
    trace = spark.createDataFrame(rows, "chain long, i long, v double")
    acf = {(r["chain"], r["lag"]): r["rho"] for r in D.autocorrelation(trace, 3, "chain").collect()}
    assert [acf[1, k] for k in range(4)] == [1.0, 0.0, 0.0, 0.0]
    assert acf[2, 1] < 0
    ess = {r["chain"]: r for r in D.ess(trace, 3, "chain").collect()}
    assert ess[1]["iact"] == 1.0 and ess[2]["ess"] == 10 and ess[3]["ess"] is None and ess[4]["n"] == 1


def test_rhat_of_equal_and_constant_chains(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=8)
    v[4:] = v[:4]
    rows = [("same", c, i + 1, float(x)) for c in (1, 2) for i, x in enumerate(v)]
    rows += [("flat", c, i, 1.0) for c in (1, 2) for i in range(1, 9)] + [("short", c, i, float(i)) for c in (1, 2) for i in range(1, 4)]
    trace = spark.createDataFrame(rows, "grp string, chain long, i long, v double")
    found = {r["grp"]: r["rhat"] for r in D.split_rhat(trace, "grp", "chain").collect()}
    assert found["same"] == pytest.approx(math.sqrt(3 / 4)) and found["flat"] is None and "short" not in found


def test_sd_of_one_replication(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.1)], "k int, tau double, x_gap double")
    assert S.replication_summary(rows, ["k"], 1.0).first()["sd_tau"] == 0.0
    assert S.checkpoint_summary(rows.withColumn("r", F.lit(1)), ["k"], "r", 1.0).first()["sd_tau"] is None


def test_trace_keeps_first_and_last(spark):
    trace = C.run_chains(make_units(spark), lambda s, t: C.local_mh(s, t, 1.0, 0.5), 7, k=2, starts=C.STARTS, thin=3).toPandas()
    assert isinstance(trace, pd.DataFrame)
    assert set(trace.proposal) == {0, 3, 6, 7} and len(trace) == 2 * 4 * 4


def test_salted_pairs_are_all_pairs(spark):
    units = make_units(spark)
    rows = lambda salts: sorted(map(tuple, M.pair_units(units, salts=salts).select("sim", "rp", "dp", "dist").collect()))
    assert rows(1) == rows(3) and len(rows(3)) == 2 * 3 * 7
