"""The greedy matching in rounds against the sequential one."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import chains as C
from pairloom.operators import rounds


def _units(spark, sizes, seed=0, places=None):
    rng = np.random.default_rng(seed)
    rows = []
    for sim, (n_r, n_d) in enumerate(sizes):
        for g, n in ((1, n_r), (0, n_d)):
            x = np.round(rng.normal(size=(n, 2)), 1) if places is None else rng.integers(0, places, (n, 2)).astype(float)
            rows += [(sim, g, p + 1, [float(v) for v in x[p]], float(rng.normal())) for p in range(n)]
    return spark.createDataFrame(rows, "sim long, g long, p long, x array<double>, y double").repartition(5)


def _rows(df):
    return sorted(map(tuple, df.select("sim", "rp", "slot", "dp").collect()))


@pytest.mark.parametrize(("k", "places", "sizes"), [(2, None, [(10, 20), (1, 3)]), (1, 1, [(8, 12)])])
def test_rounds_are_the_sequential_matching(spark, k, places, sizes):
    """With ties, a replication whose donors are all used, and (one place) every recipient after the same donors; lists end and parts meet."""
    units = _units(spark, sizes, places=places)
    assert _rows(rounds.greedy_in_rounds(units, k, length=6, rows=40)) == _rows(C.matchings(units, "greedy", k))


def test_rounds_with_odd_replications(spark):
    with pytest.raises(ValueError, match="sim 0: 3 recipients need 6 donors, there are 5"):
        rounds.greedy_in_rounds(_units(spark, [(3, 5)]), 2)
    assert rounds.greedy_in_rounds(_units(spark, [(0, 4)])).isEmpty()
    assert rounds.greedy_in_rounds(_units(spark, [(2, 4)]).where(F.lit(False))).isEmpty()


def test_no_round_sends_its_tables_through_the_driver(spark, monkeypatch):
    """Tables of turns, donors and lists are never broadcast; one row a replication may be."""
    plans, own = [], rounds.written
    monkeypatch.setattr(rounds, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, name))
    found = rounds.greedy_in_rounds(_units(spark, [(10, 20), (4, 9)]), 2, length=6, rows=40)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [j for p in plans for j in re.findall(r"Broadcast\w*Join \[[^\]]*,[^\]]*\]", p)]
