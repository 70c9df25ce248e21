"""Two samplers side by side on the same replications, and the trace of one.

Both samplers of a replication run in one task, from the same start, each with
its own numbers, so that their values at a step lie in one row.  A constrained
replication is one group (chains are sequential); without donor constraints
recipients are independent, and a large replication is several groups whose
sums are added.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import study
from pairloom.operators import chains as C
from pairloom.operators import draws as D
from pairloom.operators import matching as M
from pairloom.operators import summaries as S
from pairloom.plans.deal import deal_ranges
from pairloom.plans.storage import staged

#: Samplers that can be compared, by whether donors serve once.
CONSTRAINED, UNCONSTRAINED = ("mcmc", "gibbs"), ("mcmc", "monte_carlo")


def _constrained(placed: DataFrame, samplers: tuple[str, ...], k: int, o: study.Options) -> DataFrame:
    steps = {"mcmc": lambda s, t: C.local_mh(s, t, o.beta, o.pstar)[0], "gibbs": lambda s, t: C.gibbs_sweep(s, t, o.beta)[0]}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"sim": int(key[0]), "iter": np.arange(1, o.n_iter + 1)}
        start = C.start_matching(pdf, "greedy", k, (int(key[0]), 1), o.of_pairs)
        for name in samplers:
            state = replace(start, cols=start.cols.copy())
            tau, far, moved = np.empty(o.n_iter), np.empty(o.n_iter), np.empty(o.n_iter, np.int64)
            for t in range(o.n_iter):
                moved[t] = steps[name](state, t + 1)
                tau[t], far[t] = state.tau, state.distance
            out |= {f"tau_{name}": tau, f"distance_{name}": far, f"moved_{name}": moved, f"rows_{name}": moved, "n_r": len(state.y_r)}
        return pd.DataFrame(out)

    names = ", ".join(f"tau_{s} double, distance_{s} double, moved_{s} long, rows_{s} long" for s in samplers)
    groups = deal_ranges(placed.select("sim", "g", "p", "x", "y"), "sim").groupBy("sim")
    return groups.applyInPandas(run, f"sim long, iter long, n_r long, {names}")


def _unconstrained(placed: DataFrame, samplers: tuple[str, ...], k: int, o: study.Options) -> DataFrame:
    def mcmc(pdf: pd.DataFrame, sim: int) -> tuple[np.ndarray, np.ndarray]:
        matched, moved = np.zeros(o.n_iter), np.zeros(o.n_iter, np.int64)
        for _, _, y_d, chain in C.chains_of_part(pdf, sim, o.n_iter, k, o.beta, o.of_pairs):
            for t, (sets, went) in enumerate(chain):
                matched[t] += y_d[sets].sum() / k
                moved[t] += went.sum()
        return matched, moved

    def monte_carlo(pdf: pd.DataFrame, sim: int) -> tuple[np.ndarray, np.ndarray]:
        x_r, x_d, _, y_d = C.sides(pdf)
        matched, places = np.zeros(o.n_iter), pdf.p[pdf.g == 1].to_numpy()
        first, spot = D.spots(x_r)
        together = np.argsort(spot, kind="stable")
        # Recipients of a spot come one after another and share its sums.
        for x, own in zip(x_r[first], np.split(together, np.cumsum(np.bincount(spot))[:-1]), strict=True):
            sums = D.set_sums(D.kernel(D.distances(x, x_d, o.of_pairs), o.beta), k)
            for p in places[own].tolist():
                matched += y_d[D.donors_of(sums, sim, p, o.n_iter, k)].sum(axis=1) / k
        return matched, np.zeros(o.n_iter, np.int64)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        out = {"sim": int(key[0]), "iter": np.arange(1, o.n_iter + 1), "n_r": int((pdf.g == 1).sum()), "own": float(pdf.y[pdf.g == 1].sum())}
        for name in samplers:
            out[f"matched_{name}"], out[f"rows_{name}"] = (mcmc if name == "mcmc" else monte_carlo)(pdf, int(key[0]))
        return pd.DataFrame(out)

    names = ", ".join(f"matched_{s} double, rows_{s} long" for s in samplers)
    parts = C.parts(placed).groupBy("sim", "part").applyInPandas(run, f"sim long, iter long, n_r long, own double, {names}")
    sums = [F.sum(c).alias(c) for c in parts.columns if c not in ("sim", "iter")]
    none = F.lit(None).cast("double")
    columns = []
    for s in samplers:
        tau = (F.col("own") - F.col(f"matched_{s}")) / F.col("n_r")
        columns += [tau.alias(f"tau_{s}"), none.alias(f"distance_{s}"), (F.col(f"rows_{s}") > 0).cast("long").alias(f"moved_{s}"), f"rows_{s}"]
    return parts.groupBy("sim", "iter").agg(*sums).select("sim", "iter", "n_r", *columns)


def series(units: DataFrame, constrained: bool, samplers: tuple[str, ...], k: int, options: study.Options | None = None) -> DataFrame:
    """(sim, iter, n_r) and, for each sampler, tau, distance (constrained ones), moved and rows of every step.

    moved is what was accepted (mcmc), how many slots changed (gibbs), or
    whether a recipient's set moved (unconstrained); rows counts the sets or
    slots that moved, an accepted local step as one.
    """
    o = options or study.Options()
    o.check()
    known = CONSTRAINED if constrained else UNCONSTRAINED
    if not samplers or set(samplers) - set(known):
        raise ValueError(f"samplers are of {known}")
    if o.distance == "mahalanobis_squared":
        units = M.whitened(units)
    placed = study.place_units(units, k)
    return (_constrained if constrained else _unconstrained)(placed, tuple(samplers), k, o)


def batch_error(values: np.ndarray) -> float:
    """Monte Carlo error of a mean by the means of about root n batches of root n values in a row; nan for under two batches."""
    size = int(np.sqrt(len(values)))
    n = len(values) // size
    return float(np.sqrt(values[: n * size].reshape(n, size).mean(axis=1).var(ddof=1) / n)) if n > 1 else float("nan")


def checkpoints(steps: DataFrame, samplers: tuple[str, ...], every: int) -> DataFrame:
    """A row for each sim and checkpoint (every ``every``-th step and the last): values and running means up to it.

    For each sampler: tau, running_tau, its error (batch means), distance and
    the rates of steps that moved and of rows that moved.  For two: the
    difference of running means and its error, from the batches of differences.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("iter")
        n = len(pdf)
        at = np.unique(np.append(np.arange(every, n + 1, every), n))
        out: dict[str, object] = {"sim": int(key[0]), "mcmc_iter": at}
        for s in samplers:
            tau, moved, rows = (pdf[f"{c}_{s}"].to_numpy() for c in ("tau", "moved", "rows"))
            out |= {
                f"tau_{s}": tau[at - 1], f"running_tau_{s}": np.cumsum(tau)[at - 1] / at, f"mc_error_{s}": [batch_error(tau[:t]) for t in at],
                f"distance_{s}": pdf[f"distance_{s}"].to_numpy()[at - 1], f"moved_rate_{s}": np.cumsum(moved > 0)[at - 1] / at,
                f"row_rate_{s}": np.cumsum(rows)[at - 1] / (at * pdf["n_r"].to_numpy()[0]),
            }
        if len(samplers) == 2:
            a, b = (pdf[f"tau_{s}"].to_numpy() for s in samplers)
            out |= {"tau_diff": np.cumsum(a - b)[at - 1] / at, "mc_error_diff": [batch_error((a - b)[:t]) for t in at]}
        return pd.DataFrame(out)

    per = ", ".join(f"tau_{s} double, running_tau_{s} double, mc_error_{s} double, distance_{s} double, moved_rate_{s} double, row_rate_{s} double" for s in samplers)
    more = ", tau_diff double, mc_error_diff double" if len(samplers) == 2 else ""
    return steps.groupBy("sim").applyInPandas(run, f"sim long, mcmc_iter long, {per}{more}")


def compared(units: DataFrame, constrained: bool, k: int, options: study.Options | None = None, every: int = 100) -> DataFrame:
    """Checkpoints of both samplers on every replication of ``units``."""
    both = CONSTRAINED if constrained else UNCONSTRAINED
    return checkpoints(series(units, constrained, both, k, options), both, every)


def comparison_summary(points: DataFrame, constrained: bool, true_tau: float = 1.0) -> DataFrame:
    """A row for each sampler and checkpoint: mean, spread, quantiles and bias of running means over sims, and the mean difference.

    agree is the share of sims whose difference is within two of its errors.
    """
    both = CONSTRAINED if constrained else UNCONSTRAINED
    # Staged, as two aggregates read them, and each would run the samplers.
    points = staged(points)
    named = F.array(*[F.struct(F.lit(s).alias("sampler"), F.col(f"running_tau_{s}").alias("tau")) for s in both])
    long = points.select("sim", "mcmc_iter", F.explode(named).alias("of")).select("sim", "mcmc_iter", "of.*")
    within = F.when(~F.isnan("mc_error_diff"), (F.abs("tau_diff") <= 2 * F.col("mc_error_diff")).cast("double"))
    gaps = points.groupBy("mcmc_iter").agg(F.avg("tau_diff").alias("mean_tau_diff"), F.max(F.abs("tau_diff")).alias("max_abs_tau_diff"), F.avg(within).alias("agree"))
    return S.checkpoint_summary(long, ["sampler", "mcmc_iter"], "sim", true_tau).join(gaps, "mcmc_iter", "left")
