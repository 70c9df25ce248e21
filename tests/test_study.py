from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import diagnose, sources, study
from pairloom.__main__ import main
from pairloom.operators import draws
from pairloom.operators import matching as M
from pairloom.sources.datasets import supply


@pytest.fixture(scope="module")
def units(spark):
    return sources.generate(spark, 3, 8, 24).cache()


def test_generated_units(spark):
    rows = sources.generate(spark, 20, 50, 150, shift=0.5).groupBy("g").agg(F.count("*").alias("n"), F.avg(F.col("x")[0]).alias("x"), F.var_samp(F.col("x")[1]).alias("v")).toPandas().set_index("g")
    assert rows.n[1] == 1000 and rows.n[0] == 3000
    assert abs(rows.x[1] - 0.5) < 0.1 and abs(rows.x[0]) < 0.07 and abs(rows.v[0] - 1) < 0.1
    with pytest.raises(ValueError):
        sources.generate(spark, 1, 2, 2, model="cubic")
    assert supply(5, 1, 1.5) == 8 and supply(5, 1, 1.3) == 6  # 7.5 and 6.5, rounded to even
    with pytest.raises(ValueError):
        supply(5, 2, 0.9)


@pytest.mark.parametrize("method", study.METHODS)
def test_studies(units, method):
    rows = study.run_study(units, method, study.Options(n_iter=20)).toPandas()
    assert len(rows) == 3 and np.isfinite(rows.est).all() and (rows.miVar >= rows.wiVar).all()
    assert ((rows.ll <= 1) & (rows.ul >= 1)).astype(int).tolist() == rows.covers_true.tolist()
    assert ("wiVarclus" in rows) == method.startswith("constrained") and ("wiVarpaired" in rows) == (method not in ("constrained_1tok", "constrained_1tok_gibbs"))


@pytest.mark.parametrize("method", study.METHODS)
def test_a_study_runs_its_sampler_once(units, method):
    plan = study.run_study(units, method, study.Options(n_iter=5))
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FlatMapGroupsInPandas") == 1


def test_parts_and_lazy_distances_change_nothing(units, monkeypatch):
    from pairloom.operators import chains, draws

    run = lambda m, **more: study.run_study(units, m, study.Options(n_iter=15, **more)).drop("method").orderBy("sim").toPandas()
    before = {m: run(m) for m in ("unconstrained_1to1", "unconstrained_1tok", "constrained_1tok_gibbs")}
    monkeypatch.setattr(chains, "RECIPIENTS", 3)
    for m in ("unconstrained_1to1", "unconstrained_1tok"):
        assert np.allclose(run(m), before[m]), m
    x = np.random.default_rng(1).normal(size=(9, 4))
    whole = chains.distances_of(x[:3], x[3:])
    monkeypatch.setattr(draws, "CELLS", 1)
    lazy = chains.distances_of(x[:3], x[3:])
    assert isinstance(lazy, chains.Distances) and all((lazy[r, :] == whole[r]).all() for r in range(3)) and lazy[1, 2] == whole[1, 2]
    assert (chains.greedy(lazy, 2, True) == chains.greedy(whole, 2, True)).all() and (chains.greedy(lazy, 1) == chains.greedy(whole, 1)).all()


def test_profile_and_distances(units):
    for distance in study.DISTANCES:
        rows = study.run_study(units, "constrained_1to1", study.Options(n_iter=10, distance=distance, profile=True)).toPandas()
        assert np.isfinite(rows.est).all() and (rows.n_sampling_draws == 10).all() and (rows.time_method_total > 0).all()
        assert np.allclose(rows.share_mcmc_in_method, rows.time_mcmc_total / rows.time_method_total)


def test_mahalanobis_of_any_covariates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 3))
    x = np.column_stack([x, x[:, 0] - 2 * x[:, 1]])  # dependent: the covariance has no inverse
    g = np.array([1] * 4 + [0] * 8)
    rows = [(1, i, int(g[i]), [float(v) for v in x[i]], 0.0, int(i if g[i] else i - 4) + 1) for i in range(12)]
    pairs = M.squared_mahalanobis(spark.createDataFrame(rows, "sim long, unit long, g int, x array<double>, y double, p long")).collect()
    inverse = np.linalg.pinv(np.cov(x, rowvar=False))
    for r in pairs:
        gap = x[r["rp"] - 1] - x[r["dp"] + 3]
        assert r["dist"] == pytest.approx(gap @ inverse @ gap)
    assert len(pairs) == 32


def test_draws_of_k_have_exact_frequencies():
    w = np.array([0.5, 1.0, 2.0, 0.3, 0.7])
    alpha = w / (1 + w)  # odds() gives w again
    found = Counter(map(tuple, draws.k_donors(alpha, 1, 1, 20_000, 3).tolist()))
    sets = {s: np.prod(w[list(s)]) for s in itertools.combinations(range(5), 3)}
    total = sum(sets.values())
    assert max(abs(found[s] / 20_000 - v / total) for s, v in sets.items()) < 0.02 and set(found) <= set(sets)


def test_a_registered_method(units):
    study.register("greedy_only", study.Method(lambda u, k, o: study.chain_sums(u, lambda s, t: (0, "stay"), k, o), True))
    try:
        rows = study.run_study(units, "greedy_only", study.Options(n_iter=3)).toPandas()
        assert (rows.bwVar < 1e-20).all()
        with pytest.raises(ValueError):
            study.register("greedy_only", study.METHODS["greedy_only"])
    finally:
        del study.METHODS["greedy_only"]


def test_units_that_are_not_finite_raise(spark, units):
    broken = units.withColumn("y", F.when((F.col("unit") == 2) & (F.col("sim") == 1), float("nan")).otherwise(F.col("y")))
    with pytest.raises(Exception, match="not finite"):
        study.run_study(broken, "constrained_1to1", study.Options(n_iter=2)).collect()


def test_diagnostics_end_to_end(spark, tmp_path):
    settings = diagnose.grid("constrained_1tok", n_r=[4], k=[2], rho=[1.5, 2.0], beta=[1.0]) + diagnose.grid("constrained_1tok_block", [2], n_r=[4], k=[2], rho=[2.0])
    assert len(settings) == 3 and diagnose.close_rhos([*settings, diagnose.Setting(rho=1.0)]) == [1.0]
    trace = diagnose.traces(spark, settings, str(tmp_path / "data"), n_chains=3, n_sweeps=4, thin=5)
    path = diagnose.write_run(trace, str(tmp_path / "out"), max_lag=10)
    assert path.endswith("/run") and diagnose.write_run(trace.limit(0), str(tmp_path / "out")).endswith("/run_run2")
    rows = spark.read.parquet(f"{path}/trace").toPandas()
    assert set(rows.proposal) == {0, 5, 10, 15, 20, 25, 30, 32} and len(rows) == 3 * 3 * 8 and np.allclose(rows.log_target, -rows.beta * rows.d_total)
    summary, chains = spark.read.parquet(f"{path}/summary").toPandas(), spark.read.parquet(f"{path}/chain_summary").toPandas()
    assert len(summary) == 3 * 4 and set(summary.n_chains) == {3} and (summary.mean_ess_per_sampler_sec > 0).all() and set(summary.rho) == {1.5, 2.0}
    assert len(chains) == 9 and (chains.n_saved == 8).all() and (chains.final_sweep == 4).all() and set(chains.start) == {"greedy", "random", "high_distance"}
    running, acf = diagnose.plot_data(spark.read.parquet(f"{path}/trace"), 5)
    assert running.count() == len(rows) * 4 and acf.where("lag = 0").count() == 9 * 4
    for bad in ({"method": "none"}, {"pstar": 2.0}, {"block": 2}, {"rho": 0.5}):
        with pytest.raises(ValueError):
            diagnose.Setting(**bad)


def test_command_line(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    assert main(["generate", "--n-sim", "3", "--n-pop", "20", "--out", at("units")], spark) == 0
    for method in ("constrained_1to1", "unconstrained_1tok"):
        assert main(["run", "--datasets", at("units"), "--method", method, "--n-mcmc", "5", "--max-sim", "2", "--profile", "--out-dir", at("results")], spark) == 0
    assert main(["summarize", "--results-dir", at("results"), "--save", "--out-dir", at("summaries")], spark) == 0
    printed = capsys.readouterr().out
    assert "constrained_1to1_beta1p0_1.csv" in printed and "summary_1.csv" in printed and "mean_time_method_total" in printed
    back = sources.read_results(spark, folder=at("summaries")).toPandas()
    assert len(back) == 2 and (back.n_sim == 2).all() and back.mean_change_rate.isna().all() if "mean_change_rate" in back else len(back) == 2
    assert main(["diagnose", "--n-r", "3", "--k", "1,2", "--n-sweeps", "2", "--data-dir", at("data"), "--out-dir", at("runs"), "--max-acf-lag", "3"], spark) == 0
    assert main(["diagnose", "--n-r", "3", "--k", "1", "--rho", "1", "--data-dir", at("data"), "--out-dir", at("runs")], spark) == 2
    assert main(["beta-path", "--n", "20", "--n-reps", "4", "--betas", "0, 1,,inf", "--out", at("path")], spark) == 0
    assert sorted(sources.read_results(spark, path=at("path")).toPandas().n_reps) == [4, 4, 4]


def test_bad_studies_raise(spark, units):
    with pytest.raises(ValueError):
        study.run_study(units, "none")
    with pytest.raises(ValueError):
        study.run_study(units, "unconstrained_1to1", study.Options(n_iter=1))
    with pytest.raises(Exception, match="too few"):
        study.run_study(sources.generate(spark, 1, 5, 6), "constrained_1tok", study.Options(n_iter=2)).collect()


def test_results_round_trip(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 'a,"b"\nc', 1.5), (2, None, None)], "sim int, method string, est double")
    sources.write_results(rows, folder)
    back = sources.read_results(spark, path=folder)
    assert back.columns == ["est", "method", "sim", "file", "_columns"]
    assert sorted((r["sim"], r["method"], r["est"]) for r in back.collect()) == [(1.0, 'a,"b"\nc', 1.5), (2.0, None, None)]
    with pytest.raises(ValueError):
        sources.read_results(spark)
    with pytest.raises(ValueError, match="fits"):
        sources.read_results(spark, folder=folder, pattern="none*")
    (tmp_path / "bad.csv").write_text('a,b\n1,"open\n')
    with pytest.raises(ValueError, match="quote"):
        sources.read_results(spark, path=str(tmp_path / "bad.csv"))


def test_names(spark, tmp_path):
    for name in ("s_1.csv", "s_7.csv", "s_x.csv", "t_9.csv"):
        (tmp_path / name).touch()
    (tmp_path / "a").mkdir()
    assert sources.next_number(spark, str(tmp_path), "s").endswith("/s_8.csv")
    assert sources.run_folder(spark, str(tmp_path), "a").endswith("/a_run2") and sources.run_folder(spark, str(tmp_path), "b").endswith("/b")


def test_cache_and_archive(spark, tmp_path):
    first = sources.get_or_create(spark, str(tmp_path), 4, 2, 1.5).orderBy("unit").collect()
    assert sources.get_or_create(spark, str(tmp_path), 4, 2, 1.5).orderBy("unit").collect() == first and len(first) == 16
    x, y, g = np.random.default_rng(0).normal(size=(2, 5, 4)), np.ones((2, 5)), np.array([[1, 1, 0, 0, 0]] * 2)
    np.savez_compressed(tmp_path / "d.npz", X=x, Y=y, g=g)
    rows = sources.read_npz(spark, str(tmp_path / "d.npz")).orderBy("sim", "unit").collect()
    assert len(rows) == 10 and rows[7]["x"] == x[1, 2].tolist()
    rows[0].asDict()
    sources.read_npz(spark, str(tmp_path / "d.npz")).drop("file", "seed").write.parquet(str(tmp_path / "p"))
    assert sources.read_units(spark, str(tmp_path / "p"), max_sim=1).count() == 5 and sources.read_units(spark, str(tmp_path / "p"), sim=2).count() == 5
    again = sources.read_archives(sources.archives(sources.read_units(spark, str(tmp_path / "p")), sims_a_file=1)).orderBy("file", "unit").collect()
    assert [(r["x"], r["y"], r["g"]) for r in again] == [(r["x"], r["y"], r["g"]) for r in rows] and {r["seed"] for r in again} == {1, 2}
    with pytest.raises(ValueError, match="no replication"):
        sources.read_units(spark, str(tmp_path / "p"), sim=9)
    np.savez(tmp_path / "bad.npz", X=x, Y=y)
    with pytest.raises(Exception, match="lacks"):
        sources.read_npz(spark, str(tmp_path / "bad.npz")).collect()


def test_a_comparison_is_summed_up_from_one_run(spark):
    """Two aggregates read the checkpoints; what makes these runs once."""
    from pairloom import compare

    rows = [(s, t, 0.1 * s, 0.2 * s, 0.01, 0.02) for s in range(5) for t in (5, 10)]
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    schema = "sim long, mcmc_iter long, running_tau_mcmc double, running_tau_monte_carlo double, tau_diff double, mc_error_diff double"
    found = compare.comparison_summary(spark.createDataFrame(rows, schema).mapInPandas(counted, schema), False).collect()
    assert len(found) == 4 and ran.value == len(rows)
