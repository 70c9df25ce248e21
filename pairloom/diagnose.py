"""Convergence diagnostics end to end: a grid of settings, several chains of each from different starts, and their summaries.

Settings and chains are groups of one job; traces become summaries as DataFrames.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import chains as C
from pairloom.operators import diagnostics as D
from pairloom.plans.deal import deal
from pairloom.sources import get_or_create, run_folder
from pairloom.sources.datasets import supply
from pairloom.study import place_units


@dataclass(frozen=True)
class Setting:
    """A sampler on a data set; ``block`` is for the block sampler alone."""

    method: str = "constrained_1tok"
    data_model: str = "linear"
    n_r: int = 300
    k: int = 5
    rho: float = 2.0
    beta: float = 5.0
    pstar: float = 0.5
    block: int | None = None

    def __post_init__(self) -> None:
        if self.method not in STEPS:
            raise ValueError(f"method is one of {sorted(STEPS)}")
        if not 0 <= self.pstar <= 1 or self.n_r < 2 or self.k < 1:
            raise ValueError("0 <= pstar <= 1, n_r >= 2 and k >= 1 are asked for")
        if (self.method == "constrained_1tok_block") != (self.block is not None) or (self.block or 1) < 1:
            raise ValueError("a block size of at least 1 goes with the block sampler, and with it alone")
        supply(self.n_r, self.k, self.rho)

    @property
    def name(self) -> str:
        parts = {"model": self.data_model, "nr": self.n_r, "k": self.k, "rho": self.rho, "beta": self.beta, "pstar": self.pstar} | ({"block": self.block} if self.block else {})
        return "_".join([self.method, *(f"{a}-{str(b).replace('.', 'p').replace('-', 'm')}" for a, b in parts.items())])


Stepper = Callable[[C.Matching, int, Setting], tuple[int, str]]
#: Samplers by name; ``register`` adds others.
STEPS: dict[str, Stepper] = {
    "constrained_1tok": lambda s, t, x: C.local_mh(s, t, x.beta, x.pstar),
    "constrained_1tok_block": lambda s, t, x: C.block_mh(s, t, x.beta, x.block or 1),
    "constrained_1tok_gibbs": lambda s, t, x: C.gibbs_slot(s, t, x.beta),
}


def register(name: str, step: Stepper) -> None:
    if name in STEPS:
        raise ValueError(f"{name} is there already")
    STEPS[name] = step


def grid(method: str, blocks: Sequence[int] = (2,), **values: Sequence) -> list[Setting]:
    """All settings of the given values, each once; the block sampler runs with every block size."""
    values = {name: dict.fromkeys(v) for name, v in values.items()} | ({"block": dict.fromkeys(blocks)} if method == "constrained_1tok_block" else {})
    return [Setting(method, **dict(zip(values, chosen, strict=True))) for chosen in itertools.product(*values.values())]


def close_rhos(settings: Sequence[Setting], cutoff: float = 1.05) -> list[float]:
    """Supply ratios so near 1 that samplers have few donors to move to."""
    return sorted({x.rho for x in settings if x.rho <= cutoff})


SETTING_COLUMNS = "setting_id string, method string, data_model string, n_r long, n_d long, k long, rho double, beta double, pstar double, block long, n_chains long, n_sweeps double, thin long, seed long, shift double, true_tau double"
ROWS = (
    "setting_id string, chain long, start string, proposal long, accepted long, move_type string, accepted_count long, tau double, d_total double, "
    "balance_l2 double, hamming long, fraction_retained double, sampler_seconds double, wall_seconds double"
)


def traces(
    spark: SparkSession, settings: Sequence[Setting], data_folder: str, n_chains: int = 4, n_sweeps: float = 20, thin: int = 1, seed: int = 1, shift: float = 0.1,
    true_tau: float = 1.0, starts: Sequence[str] = C.STARTS,
) -> DataFrame:
    """A row for steps 0, every ``thin``-th and the last of each chain, with its setting's columns.

    A sweep is as many proposals as there are slots.  Chain i has the i-th kind
    of start; chains beyond the kinds start at random, each by its own numbers.
    """
    if not settings or n_chains < 1 or n_sweeps <= 0 or thin < 1 or not starts:
        raise ValueError("settings, at least one chain, n_sweeps > 0 and thin >= 1 are asked for")
    by_id = {x.name: x for x in settings}
    kinds = [starts[i] if i < len(starts) else "random" for i in range(n_chains)]
    sets: dict[tuple, list[str]] = {}
    for name, x in by_id.items():
        sets.setdefault((x.data_model, x.n_r, x.k, x.rho), []).append(name)
    parts = []
    for (model, n_r, k, rho), names in sets.items():
        units = place_units(get_or_create(spark, data_folder, n_r, k, rho, model=model, seed=seed, shift=shift, true_tau=true_tau), k)
        parts.append(units.select("g", "p", "x", "y", F.explode(F.array(*map(F.lit, names))).alias("setting_id")))
    units = parts[0]
    for more in parts[1:]:
        units = units.union(more)
    units = units.withColumn("chain", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_chains).cast("long"))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, chain = by_id[key[0]], int(key[1])
        state = C.start_matching(pdf, kinds[chain - 1], x.k, (seed, chain))
        rows = C.trace_of(state, lambda s, t: STEPS[x.method](s, t, x), math.ceil(n_sweeps * x.n_r * x.k), thin)
        return rows.assign(setting_id=x.name, chain=chain, start=kinds[chain - 1])[[c.split()[0] for c in ROWS.split(", ")]]

    rows = deal(units, "setting_id", "chain").groupBy("setting_id", "chain").applyInPandas(run, ROWS)
    told = [(n, x.method, x.data_model, x.n_r, supply(x.n_r, x.k, x.rho), x.k, float(x.rho), float(x.beta), float(x.pstar), x.block, n_chains, float(n_sweeps), thin, seed, float(shift), float(true_tau)) for n, x in by_id.items()]
    return derived(rows.join(F.broadcast(spark.createDataFrame(told, SETTING_COLUMNS)), "setting_id"))


def derived(rows: DataFrame) -> DataFrame:
    """sweep, running acceptance (0 before the first step) and log target of trace rows with n_r, k and beta; i counts the rows' proposals."""
    t = F.col("proposal")
    return rows.withColumns(
        {
            "sweep": t / (F.col("n_r") * F.col("k")),
            "running_acceptance": F.when(t > 0, F.col("accepted_count") / t).otherwise(0.0),
            "log_target": -F.col("beta") * F.col("d_total"),
            "i": t,
        }
    )


def summaries(trace: DataFrame, max_lag: int = 200) -> tuple[DataFrame, DataFrame]:
    """The trace summary and the chain summary, both with the settings' columns."""
    names = [c.split()[0] for c in SETTING_COLUMNS.split(", ")]
    settings = trace.select(*names).distinct()
    by = lambda found: found.drop("n_chains").join(F.broadcast(settings), "setting_id")
    return by(D.trace_summary(trace, ["setting_id"], max_lag=max_lag)), by(D.chain_summary(trace, ["setting_id"]))


def write_run(trace: DataFrame, folder: str, label: str = "run", max_lag: int = 200) -> str:
    """Writes trace, summary and chain_summary to a folder of their own under ``folder``, split by setting; its path.

    The trace is written first and read again, so no chain runs twice.
    """
    spark = trace.sparkSession
    path = run_folder(spark, folder, label)
    trace.write.partitionBy("setting_id").parquet(f"{path}/trace")
    for name, rows in zip(("summary", "chain_summary"), summaries(spark.read.schema(trace.schema).parquet(f"{path}/trace"), max_lag), strict=True):
        rows.write.partitionBy("setting_id").parquet(f"{path}/{name}")
    return path


def plot_data(trace: DataFrame, max_lag: int = 200) -> tuple[DataFrame, DataFrame]:
    """What plots of a run show: running means of each variable by proposal, and autocorrelations by lag."""
    long = trace.unpivot(["setting_id", "chain", "i"], list(D.VARIABLES), "variable", "v")
    chain = ("setting_id", "variable", "chain")
    return D.running_mean(long, *chain), D.autocorrelation(long, max_lag, *chain)


def as_row(setting: Setting) -> dict:
    return asdict(setting) | {"setting_id": setting.name}
