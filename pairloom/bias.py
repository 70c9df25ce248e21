"""Bias of the estimate as replications grow: drawn replications of several sizes, matched, and summed up by size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import study
from pairloom.operators import chains as C
from pairloom.operators import matching as M
from pairloom.operators import summaries as S
from pairloom.plans.storage import staged
from pairloom.sources import draw_outcomes

#: Replications of each size; fixed values.
SIZES = {100: 300, 200: 300, 300: 250, 500: 200, 750: 150, 1000: 120, 1500: 80, 2000: 60, 3000: 40, 5000: 20, 7500: 10, 10000: 10}


def _checked(sizes: dict[int, int], recipient_frac: float, k: int) -> list[tuple[int, int, int]]:
    """(n, replications, recipients) by size; recipients are the whole part of their share."""
    rows = [(n, reps, int(recipient_frac * n)) for n, reps in sorted(sizes.items())]
    for n, reps, n_r in rows:
        if reps < 1 or n_r < 2 or n - n_r <= k:
            raise ValueError(f"size {n} with {reps} replications: at least one of them, two recipients, and more donors than {k} are asked for")
    return rows


def _stepwise(key: Column, steps: list[tuple[int, Column]]) -> Column:
    """The value of the last step that begins at or before ``key``."""
    out = F.lit(None)
    for begin, value in steps:
        out = F.when(key >= begin, value).otherwise(out)
    return out


def ragged(spark: SparkSession, sizes: dict[int, int], recipient_frac: float = 0.3, mu: float = 0.1, true_tau: float = 1.0, seed: int = 12345, k: int = 2) -> DataFrame:
    """Units (sim, unit, g, x, y, n) of replications of different sizes; sims are numbered by size, smaller first.

    Sizes times replications are summed up; a row's place among these sums
    tells its size, and from that follow its replication and its unit.  So rows
    come in even parts whatever the sizes.
    """
    rows = _checked(sizes, recipient_frac, k)
    places, begin, sim = [], 0, 1
    for n, reps, n_r in rows:
        places.append((begin, F.struct(F.lit(begin).cast("long").alias("at"), F.lit(sim).cast("long").alias("sim"), F.lit(n).cast("long").alias("n"), F.lit(n_r).cast("long").alias("n_r"))))
        begin, sim = begin + n * reps, sim + reps
    of = spark.range(begin).select("id", _stepwise(F.col("id"), places).alias("of"))
    past = F.col("id") - F.col("of.at")
    keys = of.select((F.col("of.sim") + F.floor(past / F.col("of.n"))).alias("sim"), (past % F.col("of.n") + 1).alias("unit"), F.col("of.n").alias("n"), F.col("of.n_r").alias("_n_r"))
    units = draw_outcomes(keys.withColumn("g", (F.col("unit") <= F.col("_n_r")).cast("int")), mu, true_tau, "linear", seed)
    return units.select("sim", "unit", "g", "x", "y", "n")


def dealt_by_cost(parted: DataFrame, n_iter: int) -> DataFrame:
    """Rows of parts (sim, part, n, n_r) with ``task``, so that tasks get parts of like cost, the dearest ones first.

    A part's cost is its distances and steps: its recipients times (donors and
    steps).  Parts are few beside their rows; they are put in order once, and
    dealt out like cards.
    """
    spark = parted.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    mine = F.least(F.lit(C.RECIPIENTS), F.col("n_r") - F.col("part") * C.RECIPIENTS)
    parts = parted.select("sim", "part", (mine * (F.col("n") - F.col("n_r") + n_iter)).alias("cost")).distinct()
    # Ranges of falling cost are even in number, so places in order follow from them without one task that has all parts.
    ordered = parts.repartitionByRange(tasks, F.desc("cost"), "sim", "part").sortWithinPartitions(F.desc("cost"), "sim", "part")
    turn = F.monotonically_increasing_id()
    dealt = ordered.withColumn("_at", turn).withColumn("task", F.pmod(F.shiftright("_at", 33) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(tasks)).cast("int"))
    return parted.join(dealt.select("sim", "part", "task"), ["sim", "part"]).repartitionById(tasks, F.col("task"))


def replications(units: DataFrame, options: study.Options) -> DataFrame:
    """(sim, n, tau, x_gap): means over the steps of each recipient's chain of k-sets; the gap is that of covariates, recipients less donors."""
    o = options
    o.check()
    if o.distance == "mahalanobis_squared":
        units = M.whitened(units)
    # Staged, as both the parts' costs and their rows come from it.
    placed = staged(study.place_units(units, o.k).withColumn("n", F.col("n_r") + F.col("n_d")))
    mine = F.when(F.col("g") == 1, F.array(F.floor((F.col("p") - 1) / C.RECIPIENTS))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_r") - 1) / C.RECIPIENTS)))
    parted = placed.select("sim", "n", "n_r", "g", "p", "x", "y", F.explode(mine).alias("part"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        x_r, x_d, y_r, _ = C.sides(pdf)
        z_d, sums = x_d.mean(axis=1), np.zeros(2)
        for _, _, y_d, steps in C.chains_of_part(pdf, int(key[1]), o.n_iter, o.k, o.beta, o.of_pairs):
            for sets, _ in steps:
                sums += y_d[sets].sum(), z_d[sets].sum()
        matched = sums / (o.n_iter * o.k)
        own = y_r.sum() - matched[0], x_r.mean(axis=1).sum() - matched[1]
        return pd.DataFrame({"sim": [int(key[1])], "n": [int(pdf.n.iloc[0])], "own": [len(y_r)], "tau": [own[0]], "x_gap": [own[1]]})

    # The groups' keys begin with the task, which is what rows are dealt by.
    sums = dealt_by_cost(parted, o.n_iter).groupBy("task", "sim", "part").applyInPandas(run, "sim long, n long, own long, tau double, x_gap double")
    return sums.groupBy("sim", "n").agg((F.sum("tau") / F.sum("own")).alias("tau"), (F.sum("x_gap") / F.sum("own")).alias("x_gap"))


def bias_by_size(spark: SparkSession, sizes: dict[int, int], options: study.Options | None = None, recipient_frac: float = 0.3, mu: float = 0.1, seed: int = 12345) -> DataFrame:
    """A row for each size: replications, mean effect, bias, its absolute value and Monte Carlo error, and the mean covariate gap."""
    o = options or study.Options(n_iter=300)
    rows = replications(ragged(spark, sizes, recipient_frac, mu, o.true_tau, seed, o.k), o)
    return S.replication_summary(rows, ["n"], o.true_tau)
