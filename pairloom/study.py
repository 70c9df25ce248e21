"""Studies end to end: units in, one result row a replication out.

A study is one pass: units are dealt out by replication (those of methods
without donor constraints by parts of its recipients), a task runs the sampler
once and gives a row of sums for each draw, and Spark turns these into effects,
variances and pooled results.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import finite, ratio
from pairloom.operators import chains as C
from pairloom.operators import draws as D
from pairloom.operators import estimators as E
from pairloom.operators import matching as M
from pairloom.plans.deal import deal_ranges

DISTANCES = ("l1", "l2", "mahalanobis_squared")


@dataclass(frozen=True)
class Options:
    """What a study takes; k counts for methods with several donors a recipient."""

    n_iter: int = 1000
    beta: float = 1.0
    k: int = 2
    pstar: float = 0.5
    true_tau: float = 1.0
    distance: str = "l2"
    #: Adds the seconds of each phase and their shares.
    profile: bool = False

    def check(self) -> None:
        if self.n_iter < 2 or self.k < 1 or not 0 <= self.pstar <= 1 or not np.isfinite(self.beta):
            raise ValueError("n_iter >= 2, k >= 1, 0 <= pstar <= 1 and a finite beta are asked for")
        if self.distance not in DISTANCES:
            raise ValueError(f"distance is one of {DISTANCES}")

    @property
    def of_pairs(self) -> str:
        """The distance of prepared covariates."""
        return "l2_squared" if self.distance == "mahalanobis_squared" else self.distance


def place_units(units: DataFrame, k: int = 1) -> DataFrame:
    """Units (sim, unit, g, x, y) with their place p in their group, the sizes n_r and n_d, and y about the sim's mean.

    A sim that can't be matched raises: groups other than 0 and 1, values that
    are not finite, fewer than two recipients, or too few donors.
    """
    whole = finite(F.col("y")) & F.forall("x", lambda v: finite(v)) & F.col("x").isNotNull()
    sizes = units.groupBy("sim").agg(
        F.count_if(F.col("g") == 1).alias("n_r"), F.count_if(F.col("g") == 0).alias("n_d"), F.avg("y").alias("_mean"),
        F.count_if(~F.coalesce(F.col("g").isin(0, 1), F.lit(False))).alias("_odd"), F.count_if(~whole).alias("_bad"),
    )
    few = (F.col("n_r") < 2) | (F.col("n_d") < F.greatest(F.col("n_r") * k, F.lit(1)))
    told = (
        F.when(F.col("_odd") > 0, " has groups other than 0 and 1").when(F.col("_bad") > 0, " has values that are not finite").when(few, " has too few recipients or donors")
    )
    # The check hangs on the mean, as every outcome needs it.
    checked = F.when(told.isNotNull(), F.raise_error(F.concat(F.lit("sim "), F.col("sim").cast("string"), told)).cast("double")).otherwise(F.col("_mean"))
    place = F.row_number().over(Window.partitionBy("sim", "g").orderBy("unit")).cast("long")
    sizes = sizes.withColumn("_mean", checked).select("sim", "n_r", "n_d", "_mean")
    return units.join(sizes, "sim").withColumns({"p": place, "y": F.col("y") - F.col("_mean")}).drop("_mean")


class Clock:
    """Seconds by phase."""

    def __init__(self) -> None:
        self.spent, self.last = dict.fromkeys(PHASES, 0.0), time.perf_counter()

    def lap(self, phase: str) -> None:
        now = time.perf_counter()
        self.spent[phase] += now - self.last
        self.last = now

    def columns(self, n: int) -> dict[str, np.ndarray]:
        """The seconds in the first row of n."""
        first = np.zeros(n)
        first[:1] = 1
        return {f"time_{phase}": seconds * first for phase, seconds in self.spent.items()}


PHASES = ("setup", "mcmc_sampling", "mcmc_estimation")
DRAW_ROWS = "sim long, iter long, n long, m long, st double, stt double, sc double, scc double, stc double, sdd double, accepted long, " + ", ".join(
    f"time_{p} double" for p in PHASES
)


def chain_sums(placed: DataFrame, step: C.Step, k: int, o: Options) -> DataFrame:
    """A row for each step of a constrained chain from the greedy matching, a chain a sim."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clock = Clock()
        state = C.start_matching(pdf, "greedy", k, (int(key[0]), 1), o.of_pairs, track=False)
        sums, accepted = D.Sums(o.n_iter), np.empty(o.n_iter, int)
        ahead = max(1, min(o.n_iter, D.CELLS // state.cols.size))
        cols = np.empty((ahead, *state.cols.shape), np.int64)
        clock.lap("setup")
        for begin in range(0, o.n_iter, ahead):
            end = min(begin + ahead, o.n_iter)
            for t in range(begin, end):
                accepted[t] = step(state, t + 1)[0]
                cols[t - begin] = state.cols
            clock.lap("mcmc_sampling")
            sums.add(slice(begin, end), state.y_r, state.y_d[cols[: end - begin]], first=begin == 0)
            clock.lap("mcmc_estimation")
        return sums.rows(sim=int(key[0]), accepted=accepted, **clock.columns(o.n_iter))

    return deal_ranges(placed.select("sim", "g", "p", "x", "y"), "sim").groupBy("sim").applyInPandas(run, DRAW_ROWS)


#: What a part's recipients do: places, outcomes, donors' covariates and outcomes in, sums and accepted steps kept up.
PartDraws = Callable[[pd.DataFrame, int, D.Sums, np.ndarray, Clock, int, Options], None]


def _recipients_one_by_one(pick: Callable[[np.ndarray, int, int, int, int], np.ndarray]) -> PartDraws:
    def run(pdf: pd.DataFrame, sim: int, sums: D.Sums, accepted: np.ndarray, clock: Clock, k: int, o: Options) -> None:
        pdf = pdf.sort_values("p")
        x_r, x_d, y_r, y_d = C.sides(pdf)
        for r, p in enumerate(pdf.p[pdf.g == 1].to_list()):
            alpha = D.kernel(D.distances(x_r[r], x_d, o.of_pairs), o.beta)
            clock.lap("setup")
            chosen = pick(alpha, sim, p, o.n_iter, k)
            clock.lap("mcmc_sampling")
            sums.add(slice(None), y_r[r : r + 1], y_d[chosen].reshape(o.n_iter, 1, -1))
            clock.lap("mcmc_estimation")

    return run


def _chains_side_by_side(pdf: pd.DataFrame, sim: int, sums: D.Sums, accepted: np.ndarray, clock: Clock, k: int, o: Options) -> None:
    for places, y_r, y_d, steps in C.chains_of_part(pdf, sim, o.n_iter, k, o.beta, o.of_pairs):
        ahead = max(1, min(o.n_iter, D.CELLS // (len(places) * k)))
        sets = np.empty((ahead, len(places), k), np.int64)
        clock.lap("setup")
        for t, (now, moved) in enumerate(steps):
            sets[t % ahead] = now
            accepted[t] |= bool(moved.any())
            if t % ahead == ahead - 1 or t == o.n_iter - 1:
                clock.lap("mcmc_sampling")
                held = t % ahead + 1
                sums.add(slice(t + 1 - held, t + 1), y_r, y_d[sets[:held]], first=t < ahead)
                clock.lap("mcmc_estimation")


def part_sums(placed: DataFrame, draw: PartDraws, k: int, o: Options) -> DataFrame:
    """A row for each draw of a method without donor constraints; parts of a sim's recipients are added up."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clock, sums, accepted = Clock(), D.Sums(o.n_iter), np.zeros(o.n_iter, int)
        draw(pdf, int(key[0]), sums, accepted, clock, k, o)
        return sums.rows(sim=int(key[0]), accepted=accepted, **clock.columns(o.n_iter))

    parts = C.parts(placed).groupBy("sim", "part").applyInPandas(run, DRAW_ROWS)
    added = [F.sum(c).alias(c) for c in (*D.SUMS, *(f"time_{p}" for p in PHASES))]
    return parts.groupBy("sim", "iter").agg(*added, F.max("accepted").alias("accepted"))


Sampler = Callable[[DataFrame, int, Options], DataFrame]


@dataclass(frozen=True)
class Method:
    """How a method draws, whether a recipient has one donor, and what it reports besides the pooled effect."""

    sampler: Sampler
    one_donor: bool = False
    within: str = "ols_var"
    variances: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    #: Whether a draw is one for each recipient.
    draws_by_recipient: bool = True
    difference: bool = field(default=True)


def _of_parts(draw: PartDraws) -> Sampler:
    return lambda units, k, o: part_sums(units, draw, k, o)


def _of_chain(step: Callable[[C.Matching, int, Options], tuple[int, str]]) -> Sampler:
    return lambda units, k, o: chain_sums(units, lambda s, t: step(s, t, o), k, o)


def _local(s: C.Matching, t: int, o: Options) -> tuple[int, str]:
    return C.local_mh(s, t, o.beta, o.pstar)


def _gibbs(s: C.Matching, t: int, o: Options) -> tuple[int, str]:
    return C.gibbs_sweep(s, t, o.beta)


#: Methods by name; ``register`` adds others.
METHODS: dict[str, Method] = {
    "unconstrained_1to1": Method(_of_parts(_recipients_one_by_one(lambda a, sim, p, n, k: D.one_donor(a, sim, p, n))), True, variances=("paired",)),
    "unconstrained_1tok": Method(_of_parts(_chains_side_by_side), variances=("paired",), counts=("acceptance",)),
    "unconstrained_1tok_mc": Method(_of_parts(_recipients_one_by_one(D.k_donors)), variances=("paired",)),
    "constrained_1to1": Method(_of_chain(_local), True, variances=("paired", "clus"), counts=("acceptance",), draws_by_recipient=False),
    "constrained_1to1_gibbs": Method(_of_chain(_gibbs), True, variances=("paired", "clus"), counts=("change",)),
    "constrained_1tok": Method(_of_chain(_local), within="wls_var", variances=("clus",), counts=("acceptance",), draws_by_recipient=False, difference=False),
    "constrained_1tok_gibbs": Method(_of_chain(_gibbs), within="wls_var", variances=("clus",), counts=("change",), difference=False),
}


def register(name: str, method: Method) -> None:
    """A further method for run_study; a name can't be taken twice."""
    if name in METHODS:
        raise ValueError(f"{name} is there already")
    METHODS[name] = method


#: Columns of effects; the cluster value is a standard error that is pooled as a variance.
_VARIANCE = {"paired": "paired_var", "clus": "cluster_se"}


def run_study(units: DataFrame, method: str, options: Options | None = None) -> DataFrame:
    """A row for each sim: pooled effect, variances, interval and counts of the named method."""
    o = options or Options()
    o.check()
    if method not in METHODS:
        raise ValueError(f"method is one of {sorted(METHODS)}")
    how = METHODS[method]
    k = 1 if how.one_donor else o.k
    if o.distance == "mahalanobis_squared":
        units = M.whitened(units)
    sums = how.sampler(place_units(units, k), k, o)
    timed = [f"time_{p}" for p in PHASES] if o.profile else []
    effects = E.effects_of_sums(sums, "sim", "iter", "accepted", "n", *timed)
    counts = {
        "acceptance": [F.sum("accepted").alias("acceptance_count")],
        "change": [F.sum("accepted").alias("change_count"), F.count_if(F.col("accepted") > 0).alias("changed_iteration_count")],
    }
    more = [c for kind in how.counts for c in counts[kind]] + [F.sum(c).alias(c) for c in timed] + ([F.avg("est").alias("estdiff")] if how.difference else [])
    rows = E.pool(effects, ["sim"], how.within, F.first("n").alias("_n"), *more, **{kind: _VARIANCE[kind] for kind in how.variances})
    names = {"within_var": "wiVar", "between_var": "bwVar", "total_var": "miVar"}
    names |= {f"{a}_{kind}": f"{b}{kind}" for kind in how.variances for a, b in (("within", "wiVar"), ("total", "miVar"))}
    rows = E.add_interval(rows.withColumnsRenamed(names), o.true_tau, "miVar")
    if o.profile:
        rows = _profiled(rows, F.lit(o.n_iter) * (F.col("_n") if how.draws_by_recipient else F.lit(1)))
    constants: dict[str, Column] = {"method": F.lit(method), "beta": F.lit(float(o.beta)), "n_mcmc": F.lit(o.n_iter), "k": F.lit(k), "pstar": F.lit(float(o.pstar))}
    return rows.drop("_n").withColumns(constants)


def _profiled(rows: DataFrame, n_draws: Column) -> DataFrame:
    """Totals and shares of the seconds of each phase, and the number of sampling draws."""
    sampling, estimation = F.col("time_mcmc_sampling"), F.col("time_mcmc_estimation")
    rows = rows.withColumns({"time_mcmc_total": sampling + estimation, "time_method_total": F.col("time_setup") + sampling + estimation, "n_sampling_draws": n_draws.cast("long")})
    method = F.col("time_method_total")
    return rows.withColumns(
        {
            "time_per_sampling_draw": sampling / F.col("n_sampling_draws"),
            "share_sampling_in_mcmc": ratio(sampling, F.col("time_mcmc_total")),
            "share_sampling_in_method": ratio(sampling, method),
            "share_estimation_in_method": ratio(estimation, method),
            "share_mcmc_in_method": ratio(F.col("time_mcmc_total"), method),
        }
    )


def acceptance_rate(rows: DataFrame) -> DataFrame:
    """Accepted steps over steps; null where there are none."""
    return rows.withColumn("acceptance_rate", ratio(F.col("acceptance_count"), F.col("n_mcmc")))
