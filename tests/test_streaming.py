from __future__ import annotations

import pytest

from pairloom import sources, streaming, study
from pairloom.__main__ import main
from pairloom.streaming import append_results, running_effects

SCHEMA = "sim long, chain long, proposal long, accepted long, tau double"


def test_running_effects_over_two_batches(spark, tmp_path):
    rows = [(1, 1, t, t % 2, float(t)) for t in range(10)] + [(1, 2, t, 1, 1.0) for t in range(3)]
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_effects(stream).writeStream.format("memory").queryName("effects").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r["chain"]: (r["n"], r["running_tau"], r["running_acceptance"], r["last"]) for r in spark.table("effects").collect()}
    assert found == {1: (10, 4.5, 0.5, 9), 2: (3, 1.0, 1.0, 2)}


def test_results_are_appended_once(spark, tmp_path):
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for n in (3, 5):
        spark.createDataFrame([(1, 1, n, 0, 0.0)] * n, SCHEMA).write.mode("append").parquet(source)
        append_results(spark.readStream.schema(SCHEMA).parquet(source), out, marks).awaitTermination(120)
    assert spark.read.parquet(out).count() == 8


def test_a_study_that_was_killed_goes_on(spark, tmp_path, monkeypatch):
    units, out, marks = (str(tmp_path / x) for x in ("units", "out", "marks"))
    made = sources.generate(spark, 9, 4, 12)
    sources.write_units(made, units, sims_a_file=3)
    o = study.Options(n_iter=12)
    whole = study.run_study
    want = whole(made, "constrained_1to1", o).orderBy("sim").collect()
    ran = []

    def once(rows, *more):
        if len(ran) == 2:
            raise RuntimeError("killed")
        ran.append([r["sim"] for r in rows.select("sim").distinct().collect()])
        return whole(rows, *more)

    monkeypatch.setattr(study, "run_study", once)
    with pytest.raises(Exception, match="killed"):
        streaming.resumable_study(spark, units, "constrained_1to1", o, out, marks).awaitTermination(120)
    before = {r["sim"] for r in streaming.finished(spark, out).collect()}
    assert 0 < len(before) < 9
    monkeypatch.setattr(study, "run_study", whole)
    streaming.resumable_study(spark, units, "constrained_1to1", o, out, marks).awaitTermination(120)
    assert streaming.finished(spark, out).select(*want[0].__fields__).orderBy("sim").collect() == want
    # With a new checkpoint nothing is done twice.
    streaming.resumable_study(spark, units, "constrained_1to1", o, out, str(tmp_path / "other")).awaitTermination(120)
    assert streaming.finished(spark, out).select(*want[0].__fields__).orderBy("sim").collect() == want
    assert streaming.finished(spark, str(tmp_path / "none")) is None


def test_run_can_go_on(spark, tmp_path):
    sources.write_units(sources.generate(spark, 4, 4, 12), f"{tmp_path}/units", sims_a_file=2)
    for _ in range(2):
        a = ["run", "--datasets", f"{tmp_path}/units", "--method", "unconstrained_1to1", "--n-mcmc", "5", "--resume-dir", f"{tmp_path}/work", "--out-dir", f"{tmp_path}/results"]
        assert main(a, spark) == 0
    first, second = (sources.read_results(spark, f"{tmp_path}/results/unconstrained_1to1_beta1p0_{i}.csv").drop("file", "result_file", "_columns").orderBy("sim").collect() for i in (1, 2))
    assert first == second and len(first) == 4
