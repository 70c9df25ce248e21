"""Effects and variances of matched sets, in closed form, and their pooling.

Input has a row for each matched slot: the keys of the draw, rp, ry and dy.
All are two partial aggregates: by recipient, then by draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import finite


def effects(matches: DataFrame, *draw: str) -> DataFrame:
    """By draw: est (mean difference = OLS and WLS slope), ols_var, wls_var, cluster_se and paired_var.

    With n recipients of k donors each: the OLS variance pools both groups'
    squares over n + nk - 2; the WLS one weights donors by 1/k, over the same
    degrees of freedom; the cluster value is a standard error (recipient sets
    are clusters, no small-sample factor); the paired variance is that of
    recipient minus mean of its donors, over n.
    """
    sets = matches.groupBy(*draw, "rp").agg(
        F.first("ry").alias("t"), F.sum("dy").alias("c"), F.sum(F.col("dy") * F.col("dy")).alias("cc"), F.count("*").alias("k")
    )
    sums = sets.groupBy(*draw).agg(
        F.count("*").alias("n"),
        F.sum("k").alias("m"),
        F.avg("t").alias("tbar"),
        (F.sum("c") / F.sum("k")).alias("cbar"),
        F.var_samp("t").alias("tv"),
        F.sum("cc").alias("cc"),
        F.var_samp(F.col("t") - F.col("c") / F.col("k")).alias("pv"),
        # Clusters: moments of t / n - c / m, centred below.
        F.sum(F.col("t") * F.col("t")).alias("stt"),
        F.sum(F.col("t") * F.col("c")).alias("stc"),
        F.sum(F.col("c") * F.col("c")).alias("scc"),
        F.sum("t").alias("st"),
        F.sum("c").alias("sc"),
        F.first("k").alias("k"),
    )
    n, m, k = F.col("n"), F.col("m"), F.col("k")
    t_squares = F.col("tv") * (n - 1)
    c_squares = F.col("cc") - m * F.col("cbar") * F.col("cbar")
    # sum over r of ((t - tbar)/n - (c - k cbar)/m)^2
    tt = F.col("stt") - n * F.col("tbar") * F.col("tbar")
    tc = F.col("stc") - F.col("tbar") * F.col("sc")
    ccs = F.col("scc") - n * (k * F.col("cbar")) * (k * F.col("cbar"))
    cluster = tt / (n * n) - 2 * tc / (n * m) + ccs / (m * m)
    return sums.select(
        *draw,
        (F.col("tbar") - F.col("cbar")).alias("est"),
        ((t_squares + c_squares) / (n + m - 2) * (1 / n + 1 / m)).alias("ols_var"),
        ((t_squares + c_squares / k) / (n + m - 2) * (2 / n)).alias("wls_var"),
        F.sqrt(cluster).alias("cluster_se"),
        (F.col("pv") / n).alias("paired_var"),
    )


def effects_of_sums(sums: DataFrame, *keep: str) -> DataFrame:
    """The same effects from sums of draws (``draws.SUMS``), with the columns ``keep``; k donors for each recipient."""
    n, m, k = F.col("n"), F.col("m"), F.col("m") / F.col("n")
    t_squares = F.col("stt") - F.col("st") * F.col("st") / n
    c_squares = F.col("sdd") - F.col("sc") * F.col("sc") / m
    tc = F.col("stc") - F.col("st") * F.col("sc") / n
    ccs = F.col("scc") - F.col("sc") * F.col("sc") / n
    # Sums of squares are not negative; rounding may say so of those that are 0.
    cluster = F.greatest(t_squares / (n * n) - 2 * tc / (n * m) + ccs / (m * m), F.lit(0.0))
    return sums.select(
        *keep,
        (F.col("st") / n - F.col("sc") / m).alias("est"),
        ((t_squares + c_squares) / (n + m - 2) * (1 / n + 1 / m)).alias("ols_var"),
        ((t_squares + c_squares / k) / (n + m - 2) * (2 / n)).alias("wls_var"),
        F.sqrt(cluster).alias("cluster_se"),
        (F.greatest(t_squares - 2 * tc / k + ccs / (k * k), F.lit(0.0)) / (n - 1) / n).alias("paired_var"),
    )


def pool(draws: DataFrame, keys: list[str], within: str, *more: Column, **others: str) -> DataFrame:
    """Multiple-imputation pooling by ``keys``: est, median, within, between and total variance (null for one draw).

    ``others`` (name=column) are further variances, pooled in the same pass as
    within_name and total_name; ``more`` are further aggregates of it.
    """
    m = F.count("*")
    between = F.var_samp("est")
    variances = {"": within} | {f"_{name}": column for name, column in others.items()}
    pooled = []
    for name, column in variances.items():
        kind = name.removeprefix("_")
        tags = (f"within_{kind}", f"total_{kind}") if kind else ("within_var", "total_var")
        pooled += [F.avg(column).alias(tags[0]), (F.avg(column) + (1 + 1 / m) * between).alias(tags[1])]
    return draws.groupBy(*keys).agg(F.avg("est").alias("est"), F.median("est").alias("est_med"), between.alias("between_var"), *pooled, *more)


def add_interval(rows: DataFrame, true_tau: float, variance: str = "total_var") -> DataFrame:
    """``ll``, ``ul`` = est -+ 1.96 sd and ``covers_true``; null unless the variance is finite and not negative."""
    ok = finite(F.col(variance)) & (F.col(variance) >= 0)
    half = 1.96 * F.sqrt(F.when(ok, F.col(variance)))
    out = rows.withColumns({"ll": F.col("est") - half, "ul": F.col("est") + half})
    return out.withColumn("covers_true", F.when(F.col("ll").isNotNull(), ((F.col("ll") <= true_tau) & (true_tau <= F.col("ul"))).cast("int")))
