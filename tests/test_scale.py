"""Operators that go without a pair join, a percentile buffer or one task for a group, against plain versions."""

from __future__ import annotations

import csv
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom import bias, compare, sources, study
from pairloom.__main__ import main
from pairloom.operators import diagnostics as D
from pairloom.operators import metric, ordered
from pairloom.operators import matching as M

# Nearest donors


def _points(spark, n, seed, key, sims=2, dims=2, spread=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)) + spread * rng.integers(0, 8, (n, 1)), 1)  # many ties
    rows = [(int(i % sims) if i % 5 else 0, i, [float(v) for v in x[i]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"sim long, {key} long, x array<double>")


@pytest.mark.parametrize("kind", metric.METRICS)
def test_nearest_join_is_that_of_all_pairs(spark, kind, monkeypatch):
    for name, value in {"ROWS": 60, "CELLS": 500}.items():
        monkeypatch.setattr(metric, name, value)
    mine, recipients = _points(spark, 150, 1, "rid", sims=3)
    others, donors = _points(spark, 400, 2, "did", sims=3)
    found = {}
    for r in metric.nearest_join(recipients, donors, 3, kind).collect():
        found.setdefault((r["sim"], r["rid"]), []).append((r["slot"], r["did"], r["dist"]))
    for sim, rid, x in mine:
        far = [((np.abs(np.subtract(x, y)).sum() if kind == "l1" else math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)))), did) for s, did, y in others if s == sim]
        want = sorted(far)[:3]
        got = sorted(found[sim, rid])
        assert [d for _, d, _ in got] == [d for _, d in want] and np.allclose([d for _, _, d in got], [d for d, _ in want])


def test_pivots_in_one_place_are_taken_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(metric, "ROWS", 30)
    donors = spark.range(200).select(F.lit(0).alias("sim"), F.col("id").alias("did"), F.array((F.col("id") % 3).cast("double")).alias("x")).repartition(7)
    recipients = spark.range(40).select(F.lit(0).alias("sim"), F.col("id").alias("rid"), F.array(F.lit(1.0)).alias("x"))
    for _ in range(3):
        found = metric.nearest_join(recipients, donors, 5).groupBy("rid").agg(F.array_sort(F.collect_list("did")).alias("d")).select("d").distinct().collect()
        assert [r["d"] for r in found] == [[1, 4, 7, 10, 13]]


def test_nearest_join_visits_few(spark):
    _, recipients = _points(spark, 300, 3, "rid", sims=1, spread=20.0)
    _, donors = _points(spark, 3000, 4, "did", sims=1, spread=20.0)
    compared = metric.pairs_compared(recipients, donors, 2).agg(F.sum("compared")).first()[0]
    assert compared < 0.2 * 300 * 3000


def test_nearest_join_of_few_donors(spark):
    recipients = spark.createDataFrame([(1, 1, [0.0]), (2, 1, [0.0])], "sim long, rid long, x array<double>")
    donors = spark.createDataFrame([(1, 7, [1.0]), (1, 8, [1.0])], "sim long, did long, x array<double>")
    assert [tuple(r) for r in metric.nearest_join(recipients, donors, 5).orderBy("slot").collect()] == [(1, 1, 7, 1, 1.0), (1, 1, 8, 2, 1.0)]
    assert metric.nearest_join(recipients, donors.limit(0), 1).count() == 0
    with pytest.raises(ValueError):
        metric.nearest_join(recipients, donors, 1, "cosine")


# Quantiles and running sums


@pytest.mark.parametrize("few", [5, 100])
def test_quantiles(spark, few):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=2000) ** 9, "b": np.repeat([1.0, 2.0], [900, 300]), "c": np.array([4.0]), "d": np.array([1.7e308, -1.7e308] * 60), "e": rng.integers(0, 3, 400) * 1.0}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("f", float("nan")), ("a", None), (None, 1.0)]
    asked = {"low": 0.05, "mid": 0.5, "high": 0.95, "least": 0.0, "most": 1.0}
    found = {r["k"]: r for r in ordered.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", asked, few).collect()}
    assert found.keys() == groups.keys()
    with np.errstate(over="ignore"):
        for k, values in groups.items():
            for name, p in asked.items():
                s = np.sort(values)
                at = p * (len(s) - 1)
                a, b = s[math.floor(at)], s[math.ceil(at)]
                assert found[k][name] == pytest.approx(a + (b - a) * (at - math.floor(at)), rel=1e-12), (k, name)


def test_quantiles_of_all_rows(spark):
    rows = spark.range(50_001).select((F.col("id") * 7919 % 50_001).cast("double").alias("v"))
    assert ordered.quantiles(rows, [], "v", {"mid": 0.5, "q": 0.9}).first() == (25_000.0, 45_000.0)
    assert ordered.quantiles(rows.limit(0), [], "v", {"mid": 0.5}).count() == 0


def test_running_sums(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), (F.col("id") * 37 % 3000).alias("i"), (F.col("id") % 11).cast("double").alias("v"))
    own = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"s": F.sum("v").over(own), "n": F.count("*").over(own)}).orderBy("k", "i").collect()
    assert ordered.running_sums(rows, ["k"], ["i"], s=F.col("v"), n=F.lit(1)).orderBy("k", "i").collect() == want


# Chains


def test_autocorrelation_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    chains = {"a": np.cumsum(rng.normal(size=500)), "b": rng.normal(size=23), "c": np.full(9, 0.1), "d": np.array([2.0])}
    rows = [(k, 3 * i, float(v)) for k, values in chains.items() for i, v in enumerate(values)] + [("a", 1, float("inf"))]
    trace = spark.createDataFrame(rows, "chain string, i long, v double")
    for block in (D.BLOCK, 64):
        monkeypatch.setattr(D, "BLOCK", block)
        found = {(r["chain"], r["lag"]): (r["n"], r["rho"]) for r in D.autocorrelation(trace, 30, "chain").collect()}
        for k, values in chains.items():
            x = values - values.mean()
            for lag in range(min(30, len(x) - 1) + 1):
                want = float(x[lag:] @ x[: len(x) - lag] / (x @ x)) if k in "ab" else float(lag == 0)
                assert found.pop((k, lag)) == (len(x), pytest.approx(want, abs=1e-9))
        assert not found


def test_a_summary_runs_its_chains_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def chain(rows):
        for batch in rows:
            ran.add(len(batch))
            yield batch

    columns = ["sim", "chain", "i", *D.VARIABLES]
    made = spark.range(40).select(F.lit(1).alias("sim"), (F.col("id") % 2).alias("chain"), F.col("id").alias("i"), *[F.sin("id").alias(v) for v in D.VARIABLES])
    found = D.trace_summary(made.mapInPandas(chain, made.schema).select(*columns), ["sim"], max_lag=5)
    assert found.count() == 4 and found.count() == 4 and ran.value == 40


def test_two_samplers_agree(spark):
    units = sources.generate(spark, 2, 6, 20)
    for donors_once, k in ((True, 1), (True, 2), (False, 2)):
        o = study.Options(n_iter=600, k=k)
        rows = compare.compared(units, donors_once, k, o, 250).toPandas().sort_values(["sim", "mcmc_iter"])
        names = compare.CONSTRAINED if donors_once else compare.UNCONSTRAINED
        assert rows.mcmc_iter.tolist() == [250, 500, 600] * 2
        a, b = (rows[f"running_tau_{s}"] for s in names)
        assert np.allclose(rows.tau_diff, a - b) and (rows.tau_diff.abs() < 0.25).all() and (rows.mc_error_diff > 0).all()
        assert rows[f"moved_rate_{names[0]}"].between(0, 1).all()
    means = compare.series(units, True, ("mcmc",), 1, study.Options(n_iter=40)).groupBy("sim").agg(F.avg("tau_mcmc").alias("m")).toPandas().set_index("sim").m
    same = study.run_study(units, "constrained_1to1", study.Options(n_iter=40)).toPandas().set_index("sim").est
    assert np.allclose(means.sort_index(), same.sort_index())
    with pytest.raises(ValueError):
        compare.series(units, True, ("monte_carlo",), 1)


def test_batch_error():
    values = np.array([1.0, 3.0, 2.0, 2.0, 5.0, 7.0, 0.0, 0.0, 4.0, 9.0])
    assert compare.batch_error(values) == pytest.approx(math.sqrt(np.var([2.0, 14 / 3, 4 / 3], ddof=1) / 3))
    assert math.isnan(compare.batch_error(np.array([1.0])))


# Sizes


def test_ragged_replications(spark):
    rows = bias.ragged(spark, {30: 2, 10: 3}, 0.29, k=2).groupBy("sim").agg(F.count("*").alias("n"), F.sum("g").alias("r"), F.max("unit").alias("u"), F.max("n").alias("m")).orderBy("sim").collect()
    assert [(r["n"], r["r"], r["u"], r["m"]) for r in rows] == [(10, 2, 10, 10)] * 3 + [(30, 8, 30, 30)] * 2
    for sizes in ({5: 1}, {100: 0}):
        with pytest.raises(ValueError):
            bias.ragged(spark, sizes, 0.3)


def test_bias_is_that_of_the_study(spark, monkeypatch):
    from pairloom.operators import chains

    monkeypatch.setattr(chains, "RECIPIENTS", 5)
    o = study.Options(n_iter=30)
    units = bias.ragged(spark, {20: 2, 60: 2})
    rows = bias.replications(units, o)
    assert rows._jdf.queryExecution().executedPlan().toString().count("shufflepartitionidpassthrough") == 1
    want = study.run_study(units.drop("n"), "unconstrained_1tok", o).toPandas().set_index("sim").est
    got = rows.toPandas().set_index("sim")
    assert np.allclose(got.tau.sort_index(), want.sort_index()) and got.n.sort_index().tolist() == [20, 20, 60, 60]
    tasks = bias.dealt_by_cost(spark.range(40).select(F.floor(F.col("id") / 4).alias("sim"), (F.col("id") % 4).alias("part"), F.lit(60).alias("n"), F.lit(20).alias("n_r")), 10)
    assert tasks.groupBy("task").count().agg(F.max("count")).first()[0] <= 1 + 40 // 12 + 4


def test_published_bias(spark):
    """The published values for N = 100 and 300, each within four errors of both sides."""
    found = bias.bias_by_size(spark, {100: 150, 300: 60}, study.Options(n_iter=60)).orderBy("n").collect()
    for row, (mean, error) in zip(found, ((1.042660, 0.013639), (1.057280, 0.008370)), strict=True):
        assert abs(row["mean_tau"] - mean) < 4 * math.hypot(error, row["mc_se_bias"])


# Files and commands


def test_results_go_round(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1 / 3, 5, None), ('a,"b"', 1e-300, 7, 2.0)], "method string, est double, k long, wiVar double")
    sources.write_results(rows, f"{tmp_path}/a.csv", digits=17, crlf=True)
    read = sources.read_results(spark, f"{tmp_path}/a.csv")
    sources.write_results(read, f"{tmp_path}/b.csv")
    again = sources.read_results(spark, f"{tmp_path}/b.csv")
    columns = ["method", "est", "k", "wiVar"]
    assert sorted(map(tuple, again.select(*columns).collect())) == sorted(map(tuple, rows.withColumn("k", F.col("k").cast("double")).select(*columns).collect()))
    text = b"".join(p.read_bytes() for p in (tmp_path / "a.csv").glob("part-*"))
    assert text.count(b"\r\n") == text.count(b"\n") > 2 and b"0.33333333333333331" in text or b"0.3333333333333333" in text


def _table(folder):
    return [r for p in sorted(folder.glob("part-*")) for r in csv.DictReader(p.open())]


def test_shares_are_cut_not_rounded(spark, tmp_path):
    for frac, want in ((0.29, 28), (0.295, 29)):
        assert main(["generate", "--n-sim", "2", "--n-pop", "100", "--perc-rc", str(frac), "--out", f"{tmp_path}/{frac}"], spark) == 0
        assert spark.read.parquet(f"{tmp_path}/{frac}").where("sim = 1").agg(F.sum("g")).first()[0] == want
    from pairloom.__main__ import beta_path_rows

    assert beta_path_rows(spark, 100, 0.29, 0.3, 1, 1, [1.0]).count() == 1


def test_commands(spark, tmp_path, capsys):
    units = f"{tmp_path}/units"
    main(["generate", "--n-sim", "3", "--n-pop", "20", "--out", units], spark)
    common = ["--datasets", units, "--n-mcmc", "30", "--checkpoint-every", "10"]
    assert main(["compare", *common, "--print-every", "3", "--out", f"{tmp_path}/c.csv", "--out-summary", f"{tmp_path}/cs.csv"], spark) == 0
    assert len(_table(tmp_path / "c.csv")) == 9 and len(_table(tmp_path / "cs.csv")) == 6
    assert "running_tau_gibbs" in capsys.readouterr().out
    assert main(["trace", *common, "--sim-index", "2", "--no-donors-once", "--k", "2", "--sampler", "monte_carlo", "--out", f"{tmp_path}/t.csv"], spark) == 0
    assert [(r["sim"], r["mcmc_iter"]) for r in _table(tmp_path / "t.csv")] == [("2", "10"), ("2", "20"), ("2", "30")]
    assert main(["trace", *common, "--sampler", "monte_carlo", "--out", f"{tmp_path}/no.csv"], spark) == 2
    assert main(["bias-by-size", "--reps-by-size", "20:3, 40:2", "--n-mcmc", "20", "--out", f"{tmp_path}/b.csv"], spark) == 0
    assert sorted((r["N"], r["n_reps"]) for r in _table(tmp_path / "b.csv")) == [("20", "3"), ("40", "2")]
    capsys.readouterr()
    assert main(["run-all", "--datasets", units, "--n-mcmc", "10", "--methods", "constrained_1to1,unconstrained_1tok", "--out-dir", f"{tmp_path}/all"], spark) == 0
    assert "unconstrained_1tok.csv" in capsys.readouterr().out and len(_table(tmp_path / "all" / "summaries" / "summary_1.csv")) == 2


def test_report_has_every_file(spark, capsys):
    from pairloom.__main__ import _told

    _told(spark.range(1500).select("id", F.lit(None).cast("string").alias("x")))
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 1501 and lines[0] == "id | x" and lines[-1] == "1499 | "


def test_whitened_units_join_by_mahalanobis_distance(spark):
    units = study.place_units(sources.generate(spark, 1, 6, 30))
    white = M.whitened(units, 4)
    found = metric.nearest_join(*metric.of_units(white, [F.col("x")[i] for i in range(4)]), 1).toPandas().sort_values("rid")
    want = M.nearest(M.squared_mahalanobis(units, dims=4), 1).toPandas().sort_values("rp")
    assert found.did.tolist() == want.dp.tolist() and np.allclose(found.dist**2, want.dist)
