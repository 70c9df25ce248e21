"""Recipient-donor pairs, distances, kernels and draws without donor constraints.

Everything is keyed by sim, so the pair join is an equi-join within replications
and every window and aggregate after it reuses that key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pairloom.functions import uniform
from pairloom.plans.storage import staged

RECIPIENT = ("sim", "rp")
#: Pairs of a replication that go to one join task.
PAIRS_A_TASK = 4_000_000
#: Donors of a recipient that are in one row.
BLOCK_DONORS = 1024


def covariate_columns(units: DataFrame, dims: int | None = None) -> list[Column]:
    """The covariates: x1, x2, ... or the entries of an array x (as many as the first row has, if ``dims`` doesn't say)."""
    if "x" not in units.columns:
        return [F.col(c) for c in units.columns if c[0] == "x" and c[1:].isdigit()]
    if dims is None:
        row = units.select(F.size("x").alias("n")).first()
        dims = row["n"] if row else 0
    return [F.col("x")[i] for i in range(dims)]


def _side(units: DataFrame, g: int, prefix: str) -> DataFrame:
    xs = [c for c in units.columns if c[0] == "x" and (c == "x" or c[1:].isdigit())]
    return units.where(F.col("g") == g).select(
        "sim", F.col("p").alias(f"{prefix}p"), F.col("y").alias(f"{prefix}y"), *[F.col(c).alias(f"{prefix}{c}") for c in xs], "_parts"
    )


def distance(kind: str, recipient: list[Column], donor: list[Column]) -> Column:
    """l1, l2 or l2_squared between covariates; one expression, so it is compiled with its plan."""
    gaps = [a - b for a, b in zip(recipient, donor, strict=True)]
    total = lambda parts: sum(parts[1:], parts[0])
    if kind == "l1":
        return total([F.abs(x) for x in gaps])
    if kind not in ("l2", "l2_squared"):
        raise ValueError("a distance is l1, l2 or l2_squared")
    squares = total([x * x for x in gaps])
    return squares if kind == "l2_squared" else F.sqrt(squares)


def sized(units: DataFrame) -> DataFrame:
    """Units with the numbers n_r and n_d of recipients and donors of their sim."""
    if {"n_r", "n_d"} <= set(units.columns):
        return units
    sizes = units.groupBy("sim").agg(F.count_if(F.col("g") == 1).alias("n_r"), F.count_if(F.col("g") == 0).alias("n_d"))
    return units.join(sizes, "sim")


def salted_join(recipients: DataFrame, donors: DataFrame, salts: int | str, *spread: str) -> DataFrame:
    """All recipients with all donors of their sim.  Donors are dealt over ``salts`` parts of each sim (a number, or a
    column that both sides have) by a hash of ``spread`` and recipients go to every part, so that one large replication
    is many join tasks."""
    if salts == 1:
        return recipients.join(donors, "sim")
    n = F.col(salts) if isinstance(salts, str) else F.lit(salts)
    parts = recipients.withColumn("_salt", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
    dealt = donors.withColumn("_salt", F.pmod(F.hash(*spread), n.cast("int")))
    if isinstance(salts, str):
        dealt = dealt.drop(salts)
    return parts.join(dealt, ["sim", "_salt"]).drop("_salt")


def pair_units(units: DataFrame, kind: str = "l2", salts: int | None = None, dims: int | None = None) -> DataFrame:
    """Every recipient with every donor of its sim: (sim, rp, dp, ry, dy, their covariates, dist).

    Without ``salts`` each replication is as many join tasks as its pairs ask for.
    """
    if salts is None:
        units = sized(units).withColumn("_parts", F.ceil(F.col("n_r") * F.col("n_d") / PAIRS_A_TASK))
    else:
        units = units.withColumn("_parts", F.lit(salts))
    pairs = salted_join(_side(units, 1, "r"), _side(units, 0, "d"), "_parts", "dp").drop("_parts")
    n = len(covariate_columns(units, dims))
    named = lambda side: [F.col(f"{side}x")[i] if "x" in units.columns else F.col(f"{side}x{i + 1}") for i in range(n)]
    return pairs.withColumn("dist", distance(kind, named("r"), named("d")))


@F.pandas_udf(ArrayType(DoubleType()))
def _half_inverse(covariances: pd.Series) -> pd.Series:
    """For each covariance matrix (row after row) a matrix H with H H' its pseudo-inverse, row after row."""

    def half(flat: np.ndarray) -> np.ndarray:
        n = int(round(len(flat) ** 0.5))
        values, vectors = np.linalg.eigh(np.asarray(flat, float).reshape(n, n))
        some = values > 1e-15 * n * max(values.max(), 0.0)
        return (vectors * np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)).ravel()

    return pd.Series([half(c) for c in covariances])


def whitened(units: DataFrame, dims: int | None = None) -> DataFrame:
    """Units whose covariates are turned so that squared L2 distance is squared Mahalanobis distance.

    The covariance is that of the sim's recipients and donors together, and its
    pseudo-inverse is used, so covariates may depend on each other.
    """
    xs = covariate_columns(units, dims)
    n = len(xs)
    cov = units.groupBy("sim").agg(F.array(*[F.covar_samp(a, b) for a in xs for b in xs]).alias("_c"))
    cov = cov.select("sim", _half_inverse("_c").alias("_h"))
    turned = [sum((xs[i] * F.col("_h")[i * n + j] for i in range(n)), F.lit(0.0)) for j in range(n)]
    kept = [c for c in units.columns if not (c[0] == "x" and (c == "x" or c[1:].isdigit()))]
    return units.join(cov, "sim").select(*kept, F.array(*turned).alias("x"))


def squared_mahalanobis(units: DataFrame, salts: int | None = None, dims: int | None = None) -> DataFrame:
    """Pairs whose dist is the squared Mahalanobis distance under the sim's pooled sample covariance."""
    dims = len(covariate_columns(units, dims))
    return pair_units(whitened(units, dims), "l2_squared", salts, dims)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest donors of each recipient (slot 1 is nearest; equal distances by place)."""
    slot = F.row_number().over(Window.partitionBy(*RECIPIENT).orderBy("dist", "dp"))
    return pairs.withColumn("slot", slot).where(F.col("slot") <= k)


def kernel(pairs: DataFrame, beta: float | Column = 1.0, *more: str) -> DataFrame:
    """``alpha`` proportional to (dist + smallest dist of the recipient) ** -beta, worked out in logs.

    A recipient with a donor at distance 0 has no such weights: its rows raise.
    ``more`` names further columns that, with sim and rp, tell recipients apart.
    """
    own = Window.partitionBy(*RECIPIENT, *more)
    shifted = F.col("dist") + F.min("dist").over(own)
    checked = F.when(shifted > 0, shifted).otherwise(F.raise_error(F.lit("a donor at distance 0 has no weight")).cast("double"))
    beta = beta if isinstance(beta, Column) else F.lit(float(beta))
    rows = pairs.withColumn("_lw", -beta * F.log(checked))
    rows = rows.withColumn("_e", F.exp(F.col("_lw") - F.max("_lw").over(own)))
    return rows.withColumn("alpha", F.col("_e") / F.sum("_e").over(own)).drop("_lw", "_e")


def cumulate(weighted: DataFrame) -> DataFrame:
    """``cdf`` of alpha by donor place; the last is 1."""
    own = Window.partitionBy(*RECIPIENT)
    upto = own.orderBy("dp").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("dp").over(own)
    return weighted.withColumn("cdf", F.when(F.col("dp") == last, 1.0).otherwise(F.sum("alpha").over(upto)))


def _reached(items: str, field: str, target: Column, low: Column | None = None) -> Column:
    """How many leading items of an array, at least ``low``, have a ``field`` below the target; the field rises.  By halving."""
    low = F.lit(0) if low is None else low
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(items) + F.lit(1.0))).cast("int") + 1)

    def halve(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        middle = F.floor((lo + hi) / 2).cast("int")
        less = (lo < hi) & (F.element_at(items, F.least(middle + 1, F.size(items)))[field] < target)
        return F.struct(F.when(less, middle + 1).otherwise(lo).alias("lo"), F.when((lo < hi) & ~less, middle).otherwise(hi).alias("hi"))

    return F.aggregate(steps, F.struct(low.cast("int").alias("lo"), F.size(items).alias("hi")), halve)["lo"]


def draw_one(cumulated: DataFrame, n_draws: int, tag: str = "u1") -> DataFrame:
    """A donor for each recipient and draw: the first whose cdf reaches the draw's uniform number.

    A recipient's cdf is one array, searched for each draw, so rows are
    recipients times draws and never times donors.
    """
    lists = cumulated.groupBy(*RECIPIENT).agg(
        F.first("ry").alias("ry"), F.array_sort(F.collect_list(F.struct("dp", "cdf", "dy"))).alias("donors")
    )
    rows = lists.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    rows = rows.withColumn("u", uniform(tag, F.col("sim"), F.col("rp"), F.col("iter")))
    chosen = F.element_at("donors", _reached("donors", "cdf", F.col("u")) + 1)
    return rows.select("sim", "rp", F.col("iter").cast("long").alias("iter"), chosen["dp"].alias("dp"), "ry", chosen["dy"].alias("dy"))


def draw_one_in_blocks(pairs: DataFrame, n_draws: int, beta: float = 1.0, block: int = BLOCK_DONORS, tag: str = "u1") -> DataFrame:
    """What draw_one gives of the kernel's weights, for recipients with more donors than one task should hold.

    A recipient's donors are in blocks of ``block`` places.  A draw first picks a
    block, by the blocks' summed weights, and then a donor by the weights within
    that block, with what is left of its number.  So a row has a block of donors,
    or a weight for each block, and never all donors.
    """
    near = pairs.groupBy(*RECIPIENT).agg(F.min("dist").alias("_least"), F.first("ry").alias("ry"))
    # The nearest donor has the largest weight, which is 1 here, so no further pass looks for it.  At distance 0 no weight is a number.
    weight = F.when(F.col("_least") > 0, F.exp(-beta * F.log((F.col("dist") + F.col("_least")) / (2 * F.col("_least"))))).otherwise(float("nan"))
    rows = pairs.drop("ry").join(near, list(RECIPIENT)).withColumns({"_w": weight, "_block": F.floor((F.col("dp") - 1) / block)})
    blocks = staged(
        rows.groupBy(*RECIPIENT, "_block").agg(F.first("ry").alias("ry"), F.sum("_w").alias("_sum"), F.array_sort(F.collect_list(F.struct("dp", "_w", "dy"))).alias("_donors"))
    )
    upto = F.sum("_sum").over(Window.partitionBy(*RECIPIENT).orderBy("_block"))
    ends = blocks.select(*RECIPIENT, "ry", "_block", (upto - F.col("_sum")).alias("before"), upto.alias("cdf"))
    lists = ends.groupBy(*RECIPIENT).agg(F.first("ry").alias("ry"), F.max("cdf").alias("_total"), F.array_sort(F.collect_list(F.struct("_block", "cdf", "before"))).alias("_blocks"))
    draws = lists.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    draws = draws.withColumn("_target", uniform(tag, F.col("sim"), F.col("rp"), F.col("iter")) * F.col("_total"))
    at = F.element_at("_blocks", F.least(_reached("_blocks", "cdf", F.col("_target")) + 1, F.size("_blocks")))
    picked = draws.select(*RECIPIENT, "ry", "iter", at["_block"].alias("_block"), (F.col("_target") - at["before"]).alias("_left"))
    empty = F.array().cast("array<double>")
    sums = F.aggregate("_donors", empty, lambda done, d: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + d["_w"])))
    within = blocks.select(*RECIPIENT, "_block", F.arrays_zip(F.col("_donors.dp").alias("dp"), F.col("_donors.dy").alias("dy"), sums.alias("cdf")).alias("_donors"))
    found = picked.join(within, [*RECIPIENT, "_block"])
    donor = F.element_at("_donors", F.least(_reached("_donors", "cdf", F.col("_left")) + 1, F.size("_donors")))
    return found.select("sim", "rp", F.col("iter").cast("long").alias("iter"), donor["dp"].alias("dp"), "ry", donor["dy"].alias("dy"))


def draw_many(weighted: DataFrame, n_draws: int, k: int = 2) -> DataFrame:
    """Exact draws of k different donors (d1, ..., dk with outcomes y1, ..., yk), with weight the product of alpha / (1 - alpha).

    e_r of a donor is the weight of all sets of r donors from it on; it follows
    from e_(r-1) by a sum from behind.  With r donors to go, one uniform number
    picks the next one by its weight times e_(r-1) of the donor after it.
    """
    ordered = Window.partitionBy(*RECIPIENT).orderBy("dp")
    upto, since = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(0, Window.unboundedFollowing)
    rows = weighted.withColumn("w", F.col("alpha") / (1 - F.col("alpha"))).withColumn("after0", F.lit(1.0))
    for r in range(1, k + 1):
        each = F.col("w") * F.col(f"after{r - 1}")
        rows = rows.withColumns({f"c{r}": F.sum(each).over(upto), f"e{r}": F.sum(each).over(since)})
        rows = rows.withColumn(f"after{r}", F.lead(f"e{r}", 1, 0.0).over(ordered))
    lists = rows.groupBy(*RECIPIENT).agg(
        F.first("ry").alias("ry"), F.max(f"c{k}").alias("total"),
        F.array_sort(F.collect_list(F.struct("dp", "dy", *[f"c{r}" for r in range(1, k + 1)], *[f"after{r}" for r in range(1, k)]))).alias("donors"),
    )
    rows = lists.withColumn("iter", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_draws).cast("long"))))
    last, passed, total = F.lit(0), F.lit(0.0), F.col("total")
    for i in range(1, k + 1):
        r = k - i + 1
        target = passed + uniform(f"k{i}", F.col("sim"), F.col("rp"), F.col("iter")) * total
        at = F.least(_reached("donors", f"c{r}", target, last) + 1, F.size("donors") - (r - 1))
        rows = rows.withColumn(f"_at{i}", at).withColumn(f"_one{i}", F.element_at("donors", F.col(f"_at{i}")))
        if r > 1:
            last, passed, total = F.col(f"_at{i}"), F.col(f"_one{i}.c{r - 1}"), F.col(f"_one{i}.after{r - 1}")
    names = [F.col(f"_one{i}.{field}").alias(f"{name}{i}") for field, name in (("dp", "d"), ("dy", "y")) for i in range(1, k + 1)]
    return rows.select("sim", "rp", "iter", "ry", *names)
