"""The greedy matching of replications of any size, in rounds.

Slot by slot, each recipient in order takes its nearest free donor: that is one
turn for each recipient and slot.  It is also the one matching in which no turn
would rather have a donor that a later turn holds, so turns needn't wait for
each other: all turns without a donor ask at once, a donor goes to the earliest
that has asked so far, and whoever loses one asks again.

A turn asks for the donors of its list, the nearest ones by the metric join.
Turns are dealt by ranges of their number into parts of a bounded number of list
rows; a part settles its own turns in order, and the parts' proposals meet in an
aggregate by donor.  The first part with open turns is settled by each round, so
there are at most as many rounds as parts, beside those in which lists end.
Tables of turns, donors and lists meet by shuffles: broadcast, each would pass
the driver in every round.
A list that ends is made anew from the donors that the earliest such turn of
the replication may still get: all others reject every one of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.chains import covariates
from pairloom.operators.metric import nearest_join
from pairloom.plans.storage import written

#: Donors of a turn's first list, and of lists that are made anew at most; list rows of a part.
LIST, LONGEST, ROWS = 32, 1024, 1_000_000


def _settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Each turn of a part, in order, takes the first donor of its list that no earlier turn of the part has."""
    pdf = pdf.sort_values(["turn", "place"])
    taken: dict[int, int] = {}
    last = None
    for turn, dp in zip(pdf.turn.tolist(), pdf.dp.tolist(), strict=True):
        if turn != last and dp not in taken:
            taken[dp] = last = turn
    return pd.DataFrame({"sim": int(key[0]), "dp": list(taken.keys()), "turn": list(taken.values())}, dtype="int64")


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that never becomes a broadcast, however small the right side is."""
    return left.join(right.hint("merge"), on, how)


def _open(turns: DataFrame, lists: DataFrame, held: DataFrame) -> DataFrame:
    """The list rows of turns whose donor is free or held by a later turn."""
    rows = _meet(_meet(turns, lists, ["sim", "turn"]), held.withColumnRenamed("turn", "holder"), ["sim", "dp"], "left")
    return rows.where(F.col("holder").isNull() | (F.col("holder") > F.col("turn"))).select("sim", "turn", "place", "dp")


def _lists(turns: DataFrame, recipients: DataFrame, donors: DataFrame, length: int, metric: str) -> DataFrame:
    """(sim, turn, place, dp): the nearest ``length`` donors of each turn's recipient."""
    asking = _meet(recipients, turns.select("sim", "rid").distinct(), ["sim", "rid"], "left_semi")
    near = nearest_join(asking, donors, length, metric).select("sim", "rid", F.col("slot").alias("place"), F.col("did").alias("dp"))
    return written(_meet(turns, near, ["sim", "rid"]).select("sim", "turn", "place", "dp"), "greedy")


def greedy_in_rounds(units: DataFrame, k: int = 1, metric: str = "l2", length: int = LIST, rows: int = ROWS) -> DataFrame:
    """(sim, rp, slot, dp): the greedy matching with k donors a recipient, places from 1.

    Equals ``chains.matchings(units, "greedy", k)``: of donors equally near the
    one of the lowest place.  (Distances of eight or more dimensions are summed
    in another order there, so donors that differ in the last bit may be taken
    for one another.)  Replications without recipients give no row; one with too
    few donors raises.
    """
    if k < 1 or length < 1 or rows < 1:
        raise ValueError("k, length and rows are at least 1")
    units = written(covariates(units).select("sim", "g", "p", "x"), "greedy")
    recipients = units.where("g = 1").select("sim", F.col("p").alias("rid"), "x")
    donors = units.where("g = 0").select("sim", F.col("p").alias("did"), "x")
    sizes = units.groupBy("sim").agg(F.count_if(F.col("g") == 1).alias("n_r"), F.count_if(F.col("g") == 0).alias("n_d"))
    short = sizes.where(F.col("n_r") * k > F.col("n_d")).first()
    if short:
        raise ValueError(f"sim {short['sim']}: {short['n_r']} recipients need {short['n_r'] * k} donors, there are {short['n_d']}")
    slot = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("slot")
    turns = recipients.join(sizes, "sim").select("sim", "rid", "n_r", slot)
    turns = written(turns.withColumn("turn", (F.col("slot") - 1) * F.col("n_r") + F.col("rid")).drop("n_r"), "greedy")
    lists = _lists(turns, recipients, donors, length, metric)
    held = units.sparkSession.createDataFrame([], "sim long, dp long, turn long")
    while True:
        free = written(_meet(turns, held, ["sim", "turn"], "left_anti"), "greedy")
        if free.isEmpty():
            break
        asked = written(_open(free.select("sim", "turn"), lists, held), "greedy")
        stuck = written(_meet(free, asked, ["sim", "turn"], "left_anti"), "greedy")
        if not stuck.isEmpty():
            length = min(2 * length, max(length, LONGEST))
            first = stuck.groupBy("sim").agg(F.min("turn").alias("first"))
            left = _meet(donors.join(first, "sim"), held.select("sim", F.col("dp").alias("did"), F.col("turn").alias("holder")), ["sim", "did"], "left")
            anew = _lists(stuck, recipients, left.where(F.col("holder").isNull() | (F.col("holder") > F.col("first"))).select("sim", "did", "x"), length, metric)
            lists = written(_meet(lists, stuck, ["sim", "turn"], "left_anti").unionByName(anew), "greedy")
            asked = asked.unionByName(_open(stuck.select("sim", "turn"), anew, held))
        part = F.floor(F.col("turn") / max(1, rows // length)).alias("part")
        proposed = asked.select("*", part).groupBy("sim", "part").applyInPandas(_settle, "sim long, dp long, turn long")
        held = written(held.unionByName(proposed).groupBy("sim", "dp").agg(F.min("turn").alias("turn")), "greedy")
    return _meet(held, turns, ["sim", "turn"]).select("sim", F.col("rid").alias("rp"), "slot", "dp")
