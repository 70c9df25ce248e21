"""Convergence of chains: running means, autocorrelation, effective sample size, split R-hat.

Input is a long table (keys..., chain, i, v) with i counting from 1 in each chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pairloom.functions import finite, ratio
from pairloom.plans.storage import staged

#: What 0 may come out as, as a share of what was added up.
ROUNDING = 1e-12
#: Values of a chain that are transformed at once.
BLOCK = 1 << 18


def running_mean(trace: DataFrame, *chain: str) -> DataFrame:
    own = Window.partitionBy(*chain).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return trace.withColumn("running", F.avg("v").over(own))


def thinned(trace: DataFrame, thin: int, *chain: str) -> DataFrame:
    """Rows whose i is a multiple of ``thin``, and each chain's last."""
    last = F.max("i").over(Window.partitionBy(*chain))
    return trace.where(finite(F.col("v"))).withColumn("_last", last).where((F.col("i") % thin == 0) | (F.col("i") == F.col("_last"))).drop("_last")


def _lag_sums(values: np.ndarray, before: int, max_lag: int) -> np.ndarray:
    """For lags from 0: the sum of each value from place ``before`` on times the one so many places earlier.

    The product of the zero-padded Fourier transforms, so n log n.
    """
    own = values[before:]
    size = 1 << (len(values) + len(own)).bit_length()
    products = np.fft.irfft(np.fft.rfft(own, size) * np.conj(np.fft.rfft(values, size)), size)
    return products[np.arange(min(max_lag, len(values) - 1) + 1) - before]


def autocorrelation(trace: DataFrame, max_lag: int, *chain: str) -> DataFrame:
    """(chain..., lag, n, rho): biased, centred, divided by lag 0; a constant chain has 1, 0, 0, ...

    A chain is cut into blocks of BLOCK values, each with the max_lag values
    before it; a block's sums of products by lag come from Fourier transforms in
    one task, and are added by lag.  So rows are values, and a task's memory is
    that of a block however long the chain.
    """
    block = max(BLOCK, 2 * max_lag)
    by = Window.partitionBy(*chain)
    kept = trace.where(finite(F.col("v"))).select(*chain, "i", "v")
    # Values that differ by rounding alone are constant; their differences would correlate somehow.
    low, high = F.min("v").over(by), F.max("v").over(by)
    constant = high - low <= ROUNDING * F.greatest(F.abs(low), F.abs(high))
    placed = kept.withColumns({"_v": F.when(constant, 0.0).otherwise(F.col("v") - F.avg("v").over(by)), "_at": F.row_number().over(by.orderBy("i")) - 1})
    own = F.floor(F.col("_at") / block)
    blocks = F.when(F.col("_at") % block >= block - max_lag, F.array(own, own + 1)).otherwise(F.array(own))
    rows = placed.select(*chain, F.col("_at").cast("long").alias("_at"), "_v", F.explode(blocks).alias("_block"))
    fields = [f for f in rows.schema.fields if f.name in chain]
    schema = StructType([*fields, StructField("lag", LongType()), StructField("s", DoubleType()), StructField("m", LongType())])

    def sums(group: pa.Table) -> pa.Table:
        group = group.sort_by("_at")
        before = int(np.count_nonzero(group["_at"].to_numpy() // block < group["_block"][0].as_py()))
        found = _lag_sums(group["_v"].to_numpy(), before, max_lag) if before < len(group) else np.zeros(0)
        keys = group.select(list(chain)).take(pa.array(np.zeros(len(found), np.int64)))
        for name, values in {"lag": np.arange(len(found)), "s": found, "m": np.full(len(found), len(group) - before)}.items():
            keys = keys.append_column(name, pa.array(values))
        return keys

    parts = rows.groupBy(*chain, "_block").applyInArrow(sums, schema).groupBy(*chain, "lag").agg(F.sum("s").alias("s"), F.sum("m").alias("n"))
    s0 = F.first("s").over(by.orderBy("lag"))
    rho = F.when(s0 > 0, F.col("s") / s0).otherwise(F.when(F.col("lag") == 0, 1.0).otherwise(0.0))
    return parts.select(*chain, "lag", "n", rho.alias("rho"))


def iact(acf: DataFrame, *chain: str) -> DataFrame:
    """Integrated autocorrelation time: 1 + 2 * the sum of rho up to the first that is not positive (beyond rounding); 1 at least."""
    stop = F.min(F.when((F.col("lag") > 0) & (F.col("rho") <= ROUNDING), F.col("lag"))).over(Window.partitionBy(*chain))
    used = (F.col("lag") > 0) & (F.col("_stop").isNull() | (F.col("lag") < F.col("_stop")))
    return (
        acf.withColumn("_stop", stop)
        .groupBy(*chain)
        .agg(F.first("n").alias("n"), F.greatest(F.lit(1.0), 1 + 2 * F.coalesce(F.sum(F.when(used, F.col("rho"))), F.lit(0.0))).alias("iact"))
    )


def ess(trace: DataFrame, max_lag: int, *chain: str) -> DataFrame:
    """n, iact, ess = n / iact and mcse = sd / sqrt(ess) of each chain; ess and mcse are null for under two values."""
    spread = trace.where(finite(F.col("v"))).groupBy(*chain).agg(F.stddev_samp("v").alias("sd"), F.avg("v").alias("mean"))
    rows = iact(autocorrelation(trace, max_lag, *chain), *chain).join(spread, list(chain))
    size = F.when(F.col("n") > 1, F.col("n") / F.col("iact"))
    return rows.select(*chain, "n", "iact", size.alias("ess"), (F.col("sd") / F.sqrt(size)).alias("mcse"), "mean", "sd")


def split_rhat(trace: DataFrame, group: str | list[str], chain: str) -> DataFrame:
    """Split R-hat of the chains of each group; null for under two chains of four values, or without spread.

    Chains are cut to the even length of the shortest and halved.  Lengths are
    counted by chain first, so values are only ever ordered within their chain.
    """
    by = [group] if isinstance(group, str) else list(group)
    sizes = trace.groupBy(*by, chain).agg(F.count("*").alias("_n"), F.count_if(finite(F.col("v"))).alias("_m")).where("_n >= 4 AND _m > 0")
    half = sizes.groupBy(*by).agg(F.floor(F.min("_m") / 2).alias("_h"))
    kept = trace.where(finite(F.col("v"))).join(sizes.select(*by, chain).join(half, by), [*by, chain])
    place = F.row_number().over(Window.partitionBy(*by, chain).orderBy("i"))
    rows = kept.withColumn("_i", place).where(F.col("_i") <= 2 * F.col("_h"))
    halves = rows.groupBy(*by, chain, F.when(F.col("_i") <= F.col("_h"), 0).otherwise(1).alias("half")).agg(
        F.avg("v").alias("mu"), F.var_samp("v").alias("s2"), F.first("_h").cast("double").alias("h")
    )
    w, b, h = F.avg("s2"), F.first("h") * F.var_samp("mu"), F.first("h")
    value = F.sqrt(((h - 1) / h * w + b / h) / w)
    return halves.groupBy(*by).agg((F.count("*") / 2).cast("long").alias("n_chains"), F.when((w > 0) & (h >= 2) & (F.count("*") >= 4), value).alias("rhat"))


#: What is monitored of a chain.
VARIABLES = ("tau", "d_total", "log_target", "balance_l2")


def trace_summary(trace: DataFrame, keys: list[str], variables: tuple[str, ...] = VARIABLES, max_lag: int = 200) -> DataFrame:
    """A row for each setting (``keys``) and variable: R-hat, and means over its chains.

    ``trace`` has the keys, chain, i, the variables and, for effective sizes a
    second of sampling, sampler_seconds.  It is staged, so that what makes it, a
    sampler perhaps, runs once, and seconds belong to the values beside them.
    """
    trace = staged(trace.select(*keys, "chain", "i", *variables, *[c for c in ("sampler_seconds",) if c in trace.columns]))
    long = trace.unpivot([*keys, "chain", "i"], list(variables), "variable", "v")
    sizes = ess(long, max_lag, *keys, "variable", "chain")
    more = []
    if "sampler_seconds" in trace.columns:
        spent = trace.groupBy(*keys, "chain").agg(F.max("sampler_seconds").alias("_s"))
        sizes = sizes.join(spent, [*keys, "chain"])
        more = [F.avg(F.when(F.col("_s") > 0, F.col("ess") / F.col("_s"))).alias("mean_ess_per_sampler_sec")]
    means = sizes.groupBy(*keys, "variable").agg(
        F.avg("ess").alias("mean_ess"), F.min("ess").alias("min_ess"), F.avg("iact").alias("mean_iact"), F.avg("mcse").alias("mean_mcse"),
        F.avg("mean").alias("mean_value"), F.avg("sd").alias("mean_chain_sd"), *more,
    )
    return means.join(split_rhat(long, [*keys, "variable"], "chain").withColumnRenamed("rhat", "rhat_split"), [*keys, "variable"], "left")


def chain_summary(trace: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each setting and chain: rows and proposals, rates, times and the last values; times a unit are null for none."""
    last = F.max_by(F.struct("start", "sweep", "running_acceptance", *VARIABLES, "fraction_retained"), "proposal")
    rows = trace.groupBy(*keys, "chain").agg(
        last.alias("_last"), F.count("*").alias("n_saved"), F.max("proposal").alias("n_proposals"),
        F.max("sampler_seconds").alias("sampler_seconds"), F.max("wall_seconds").alias("wall_seconds"),
    )
    at = lambda name: F.col(f"_last.{name}")
    return rows.select(
        *keys, "chain", at("start"), "n_saved", "n_proposals", at("sweep").alias("final_sweep"), "sampler_seconds", "wall_seconds",
        at("running_acceptance").alias("acceptance_rate"), ratio(F.col("sampler_seconds"), F.col("n_proposals")).alias("time_per_proposal"),
        ratio(F.col("sampler_seconds"), at("sweep")).alias("time_per_sweep"), *[at(v).alias(f"final_{v}") for v in (*VARIABLES, "fraction_retained")],
    )
