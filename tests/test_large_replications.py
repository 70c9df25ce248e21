"""Queries whose replications are too large for all pairs to be shuffled or held, and rows that weights can't tell apart."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pairloom.functions import rounded
from pairloom.operators import by_recipient as R
from pairloom.operators import chains as C
from pairloom.operators import draws
from pairloom.operators import matching as M
from pairloom.operators import metric
from pairloom.operators.paths import BETAS
from pairloom.queries import QUERIES, SQL


def _no_pairs(*_, **__):
    raise AssertionError("all pairs are formed")


@pytest.mark.parametrize("name", ["cluster_se", "ols_slope_var", "paired_var", "wls_slope_var", "estdiff", "knn_tau", "outcome_gather", "x_gap", "balance_l2", "unmatched_anti"])
def test_nearest_donors_form_no_pairs(spark, same_as_sql, monkeypatch, name):
    monkeypatch.setattr(M, "pair_units", _no_pairs)
    same_as_sql(QUERIES[name](spark, str(DATA)), SQL[name])


@pytest.mark.parametrize("name", ["donor_rank", "alpha_kernel", "log_kernel_beta_grid", "cdf_prefix", "inverse_cdf_draw", "mc_u1tok_draws", "mc_u1tok_draws_of_three", "beta_path", "beta_path_drawn"])
def test_weights_and_ranks_shuffle_no_pairs(spark, same_as_sql, monkeypatch, name):
    monkeypatch.setattr(M, "pair_units", _no_pairs)
    monkeypatch.setattr(R, "CELLS", 20)
    monkeypatch.setattr(R, "ROWS", 30)
    same_as_sql(QUERIES[name](spark, str(DATA)), SQL[name])


@pytest.fixture(scope="module")
def met(tmp_path_factory):
    """Tables of sf0.01 in which a recipient and two donors of nation 3 share a place, and DuckDB over them."""
    folder, con = tmp_path_factory.mktemp("met"), duckdb.connect()
    own = "c_nationkey = 3 AND (c_mktsegment = 'BUILDING') = {} ORDER BY c_custkey LIMIT {}"
    for p in Path("/root/testdata/sf0.01").glob("*.parquet"):
        con.execute(f"CREATE TABLE {p.stem} AS FROM '{p}'")
    con.execute(f"CREATE TABLE three AS (SELECT c_custkey FROM customer WHERE {own.format('true', 1)}) UNION ALL (SELECT c_custkey FROM customer WHERE {own.format('false', '2 OFFSET 3')})")
    con.execute("UPDATE customer SET c_acctbal = 1234.5 WHERE c_custkey IN (FROM three)")
    con.execute("DELETE FROM orders WHERE o_custkey IN (FROM three)")
    for name in ("customer", "orders"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize(
    "name",
    ["alpha_kernel", "beta_path", "best_beta", "bias_by_n", "bias_by_rep", "cdf_prefix", "inverse_cdf_draw", "inverse_cdf_in_blocks", "mc_u1tok_draws", "mc_u1tok_draws_of_three", "mh_u1tok", "compare_u1tok", "compare_u1tok_summary", "log_kernel_beta_grid", "run_unconstrained_1tok", "study_u1to1"],
)
def test_a_donor_at_distance_zero_gives_what_sql_gives(spark, met, name):
    folder, con = met
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got) == len(want)
    cell = lambda v: "null" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda x: sorted(tuple(map(cell, r)) for r in x[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Tables of sf0.01 three times over: customers with shifted keys, orders with the keys they had; so later copies have no orders, and in nation 3 both sides share a place there."""
    folder, con = tmp_path_factory.mktemp("copied"), duckdb.connect()
    for name, key, n in (("customer", "c_custkey", 1500), ("orders", "o_orderkey", 15000)):
        con.execute(f"CREATE TABLE {name} AS SELECT t.* REPLACE ({key} + i * {n} AS {key}) FROM '/root/testdata/sf0.01/{name}.parquet' t, (SELECT unnest(range(3)) AS i)")
    own = "c_custkey < 1500 AND c_nationkey = 3 AND (c_mktsegment = 'BUILDING') = {} ORDER BY c_custkey LIMIT 1"
    con.execute(f"CREATE TABLE two AS (SELECT c_custkey AS k FROM customer WHERE {own.format('true')}) UNION ALL (SELECT c_custkey FROM customer WHERE {own.format('false')})")
    con.execute("UPDATE customer SET c_acctbal = 1234.5 WHERE c_custkey % 1500 IN (SELECT k FROM two)")
    for name in ("customer", "orders"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["beta_path", "best_beta", "bias_by_n", "compare_u1tok", "bias_by_rep", "cdf_prefix", "compare_u1tok_summary"])
def test_copies_of_customers_without_their_orders_give_what_sql_gives(spark, copied, name):
    test_a_donor_at_distance_zero_gives_what_sql_gives(spark, copied, name)


def test_penalty_paths_work_out_a_spot_once():
    """Donors with the same covariates are one column, in order of their first donors; covariates beyond dims tell none apart."""
    rng = np.random.default_rng(8)
    x = [[0.0, 1.0, 7.0], [2.0, 1.0, 7.0], [-0.0, 1.0, 8.0], [2.0, 0.5, 7.0]]
    spots = [int(i) for i in np.append([3, 0, 1, 2], rng.integers(0, 4, 56))]
    rows = [{"sim": 5, "g": 1, "p": i + 1, "x": rng.normal(size=3).tolist(), "y": 0.0} for i in range(6)]
    rows += [{"sim": 5, "g": 0, "p": i + 1, "x": x[at], "y": float(i)} for i, at in enumerate(spots)]
    (block,), (whole,) = (list(R._blocks(pa.Table.from_pylist(rows), 2, by_spot)) for by_spot in (True, False))
    assert block.dist.shape == (6, 3) and whole.dist.shape == (6, 60)
    assert (block.dist[:, block.spot] == whole.dist).all() and block.spot.tolist() == [{3: 0, 0: 1, 1: 2, 2: 1}[at] for at in spots]


def test_penalty_paths_of_shared_spots_are_those_of_all_pairs(spark):
    """Copies of donors, with outcomes and a gap of their own, and nearest spots that tie."""
    rng = np.random.default_rng(9)
    x_r, x_d = rng.integers(0, 4, (7, 3)) + 0.5, rng.integers(0, 4, (40, 3)).astype(float)
    y_r, y_d = rng.normal(size=7), rng.normal(size=40)
    rows = [(1, g, i + 1, 7, v.tolist(), float(w)) for g, x, y in ((1, x_r, y_r), (0, x_d, y_d)) for i, (v, w) in enumerate(zip(x, y, strict=True))]
    units = spark.createDataFrame(rows, "sim long, g int, p long, n_r long, x array<double>, y double")
    found = {r["beta"]: r for r in R.beta_path(units, (0.0, 2.0, 50.0, np.inf), 2, gap=lambda x: x[:, 2]).collect()}
    far = np.sqrt(((x_r[:, None, :2] - x_d[None, :, :2]) ** 2).sum(axis=2))
    for beta, row in found.items():
        near = np.eye(40)[far.argmin(axis=1)]
        w = near if np.isinf(beta) else ((far + far.min(axis=1, keepdims=True)) / far.min(axis=1, keepdims=True)) ** -beta
        w = w / w.sum(axis=1, keepdims=True)
        assert np.isclose(row["tau"], (y_r - w @ y_d).mean()) and np.isclose(row["gap"], (x_r[:, 2] - w @ x_d[:, 2]).mean())
    assert sorted(found) == [0.0, 2.0, 50.0, np.inf]


def test_recipients_of_a_spot_share_weights_and_order(monkeypatch):
    """Chains are those of each recipient's own row, in chunks that split spots; a spot's weights are worked out once a chunk."""
    rng = np.random.default_rng(10)
    x_r, x_d = rng.integers(0, 2, (24, 2)) + 0.5, rng.integers(0, 5, (50, 2)).astype(float)
    rows = [{"g": g, "p": i + 1, "x": v, "y": float(i)} for g, x in ((1, x_r), (0, x_d)) for i, v in enumerate(x)]
    weighed, own = [], draws.kernel
    monkeypatch.setattr(draws, "kernel", lambda dist, beta: weighed.append(len(dist)) or own(dist, beta))
    monkeypatch.setattr(draws, "CELLS", 50 * 9)
    found = {}
    for places, y_r, _, steps in C.chains_of_part(pd.DataFrame(rows), 3, 6, 2, 1.0, "l2"):
        assert (y_r == places - 1).all()
        sets = [(s.copy(), m) for s, m in steps]
        found |= {p: [(s[i].tolist(), bool(m[i])) for s, m in sets] for i, p in enumerate(places.tolist())}
    assert sorted(found) == list(range(1, 25)) and sum(weighed) <= 4 + 2
    far = draws.distances(x_r[:, None, :], x_d[None], "l2")
    for p, chain in found.items():
        want = draws.k_set_chains(far[p - 1 : p], 1.0, 3, np.array([p]), 6, 2)
        assert chain == [(s[0].tolist(), bool(m[0])) for s, m in want]


def test_distance_spread_of_parts(spark, monkeypatch):
    """Parts of both sides meet; a replication without donors gives no row."""
    monkeypatch.setattr(metric, "ROWS", 7)
    monkeypatch.setattr(metric, "CELLS", 30)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=(33, 3))
    frame = lambda rows, key: spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(rows)] + [(2 if key == "rid" else 3, 0, [0.0] * 3)], f"sim long, {key} long, x array<double>")
    found = {r["rid"]: r for r in metric.distance_spread(frame(x, "rid"), frame(y, "did")).collect()}
    far = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert sorted(found) == list(range(20))
    for i, r in found.items():
        assert r["sim"] == 1 and r["n_pairs"] == 33
        assert np.allclose([r["mean_dist"], r["min_dist"], r["max_dist"]], [far[i].mean(), far[i].min(), far[i].max()])


def test_visits_are_made_by_few_recipients(spark, monkeypatch):
    """No task makes the visits of all recipients of a replication."""
    sizes = []
    monkeypatch.setattr(metric, "VISITORS", 10)
    own = metric._parted
    monkeypatch.setattr(metric, "_parted", lambda rows, key, size=None: sizes.append((key, size)) or own(rows, key, size))
    points = lambda n, key: spark.createDataFrame([(1, i, [float(i * i % 17), float(i)]) for i in range(n)], f"sim long, {key} long, x array<double>")
    found = metric.nearest_join(points(50, "rid"), points(60, "did"), 2)
    assert ("rid", 10) in sizes and found.count() == 100


def test_distances_by_columns_are_those_by_rows():
    rng = np.random.default_rng(4)
    for dims in (1, 2, 4, 9):
        x, y = rng.normal(size=(5, dims)), rng.normal(size=(40, dims))
        some = rng.permutation(40)[:13]
        for kind in ("l1", "l2", "l2_squared"):
            got, want = C.Distances(x, y, kind), draws.distances(x[:, None, :], y[None, :, :], kind)
            for r in range(5):
                assert (got[r, :] == want[r]).all() and (got[r, some] == want[r, some]).all() and got[r, 3] == want[r, 3]


def _states(x_r, x_d, kind, k):
    """The same start with distances as a matrix and as a large replication has them."""
    rng = np.random.default_rng(1)
    y_r, y_d = rng.normal(size=len(x_r)), rng.normal(size=len(x_d))
    for dist in (draws.distances(x_r[:, None, :], x_d[None, :, :], "l2"), C.Distances(x_r, x_d, "l2")):
        shared = C.Shared(dist, x_d) if isinstance(dist, C.Distances) else None
        yield C.Matching(dist, y_r, y_d, x_r, x_d, C.greedy(dist, k, kind == "high_distance", shared), (5, 1), True, shared)


@pytest.mark.parametrize(("k", "n_d", "places"), [(1, 60, 3), (2, 60, 4), (2, 40, 3), (2, 60, 0), (3, 400, 5)])
@pytest.mark.parametrize("kind", ["greedy", "high_distance"])
def test_donors_that_share_a_place_are_matched_and_drawn_as_by_a_matrix(k, n_d, places, kind):
    """Few places with ties between them, all donors in use (40), and no two donors in one place (0); moves of other samplers between sweeps."""
    rng = np.random.default_rng(k + places)
    point = lambda n: rng.integers(-places, places, (n, 2)) / 2 if places else rng.normal(size=(n, 2))
    x_r, x_d = point(20), point(n_d)
    one, other = _states(x_r, x_d, kind, k)
    assert (one.cols == other.cols).all()
    for t in range(1, 6):
        steps = [C.gibbs_sweep(s, t, 1.5) + C.gibbs_slot(s, 100 + t, 0.0) + C.local_mh(s, 200 + t, 0.1, 0.3) for s in (one, other)]
        steps += [[C.block_mh(s, 300 + t, 0.1, 2) for s in (one, other)]] if len(one.free) else []
        assert steps[0] == steps[1] and (one.cols == other.cols).all() and (one.free == other.free).all()
        C.perturb(one, 5), C.perturb(other, 5)
    assert (one.cols == other.cols).all() and np.isclose(one.distance, other.distance)


@pytest.mark.parametrize("step", [lambda s, t: C.gibbs_sweep(s, t, 1.0), lambda s, t: C.block_mh(s, t, 1.0, 2)])
def test_turns_and_draws_of_a_large_replication_work_out_places(monkeypatch, step):
    """No turn of a start and no draw works out the distances of all donors, if donors share places."""
    worked, own = [], C.Distances.__getitem__
    monkeypatch.setattr(C.Distances, "__getitem__", lambda self, at: worked.append(np.size(found := own(self, at))) or found)
    monkeypatch.setattr(draws, "CELLS", 100)
    rng = np.random.default_rng(2)
    rows = [{"g": int(i < 30), "p": i + 1 if i < 30 else i - 29, "x": x, "y": 0.0} for i, x in enumerate(rng.integers(0, 4, (530, 2)).astype(float))]
    state = C.start_matching(pd.DataFrame(rows), "greedy", 2, (1, 1))
    C.trace_of(state, step, 3)
    assert max(worked) <= 16


def test_the_first_of_many_numbers_are_those_of_all_in_order():
    rng = np.random.default_rng(6)
    for n, of in ((5, 5), (40, 3), (1, 1), (200, 7)):
        numbers = rng.integers(0, n, n) / n
        assert C._first(numbers, of) == sorted(range(n), key=lambda i: (numbers[i], i))[:of]


def test_a_perturbed_start_keeps_up_no_sums(monkeypatch):
    """Its edits are ten for each slot; the sums are worked out when it is done."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(draws, "CELLS", 10)
    rows = [{"g": int(i < 6), "p": i + 1 if i < 6 else i - 5, "x": rng.normal(size=2), "y": float(i)} for i in range(26)]
    tracked, own = [], C.perturb
    monkeypatch.setattr(C, "perturb", lambda state, edits: tracked.append((state.track, edits)) or own(state, edits))
    state = C.start_matching(pd.DataFrame(rows), "perturbed_greedy", 2, (3, 1))
    assert tracked == [(False, 120)] and state.track and np.isclose(state.distance, sum(state.dist[r, row].sum() for r, row in enumerate(state.cols)))


def test_cumulated_weights_are_rounded_in_their_task(spark, met):
    """Spark rounds by a decimal for each cell, longer than the weights take; its plan has no rounding of pairs."""
    plan = QUERIES["cdf_prefix"](spark, met[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "round(" not in plan


def test_numbers_are_rounded_as_in_sql():
    """Halves of the last digit, which a decimal takes up and a double may have below them; halves that a double has; NaN."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.random(5000), (rng.integers(0, 10**8, 5000) + 0.5) / 1e8, np.arange(512) / 512, [0.0, 1.0, np.nan]])
    for digits in (2, 8):
        want = duckdb.sql(f"SELECT round(x, {digits}) AS x FROM (SELECT unnest(?) AS x)", params=[x.tolist()]).fetchnumpy()["x"]
        assert np.array_equal(rounded(x, digits), want, equal_nan=True)


@pytest.mark.parametrize("cells", [30, 250_000])
def test_draws_by_blocks_shuffle_no_pairs(spark, same_as_sql, monkeypatch, cells):
    monkeypatch.setattr(M, "pair_units", _no_pairs)
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "MANY", 3)
    same_as_sql(QUERIES["inverse_cdf_in_blocks"](spark, str(DATA)), SQL["inverse_cdf_in_blocks"])


def test_recipients_of_a_spot_are_one_row_of_distances(monkeypatch):
    """Also where a spot's recipients are several blocks."""
    monkeypatch.setattr(R, "MANY", 5)
    rng = np.random.default_rng(12)
    x_r, x_d = rng.integers(0, 2, (24, 2)) + 0.5, rng.normal(size=(9, 2))
    rows = [{"sim": 5, "g": g, "p": i + 1, "x": v.tolist(), "y": float(i)} for g, x in ((1, x_r), (0, x_d)) for i, v in enumerate(x)]
    blocks, far, seen = list(R._blocks(pa.Table.from_pylist(rows), 2)), draws.distances(x_r[:, None], x_d[None], "l2"), []
    for block in blocks:
        assert block.dist.shape == (4, 9) and len(block.rp) <= 5 and (block.dist[block.row] == far[block.rp - 1]).all() and (block.y_r == block.rp - 1).all()
        seen += block.rp.tolist()
    assert sorted(seen) == list(range(1, 25))


@pytest.mark.parametrize(("pairs", "most"), [(R.ranks, 1.0), (lambda units: R.cumulated(units, digits=8), 1.5)], ids=["donor_rank", "cdf_prefix"])
def test_a_file_of_pairs_keeps_what_a_spot_shares_once(spark, tmp_path, pairs, most):
    """Bytes a row, over recipients of five spots: those of a spot stand in a row, donor after donor."""
    rng = np.random.default_rng(13)
    x_r, x_d = rng.integers(0, 5, 200) + 0.5, rng.normal(size=(1000, 2))
    rows = [(1, 1, i + 1, 200, [float(v), 0.5], 0.0) for i, v in enumerate(x_r)] + [(1, 0, i + 1, 200, v.tolist(), 0.0) for i, v in enumerate(x_d)]
    pairs(spark.createDataFrame(rows, "sim long, g int, p long, n_r long, x array<double>, y double")).coalesce(1).write.parquet(str(tmp_path / "pairs"))
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < most * 200_000


def test_penalty_paths_deal_out_spots(spark, monkeypatch):
    """Copies of units are dealt out once for each spot, and the path is that of the units."""
    dealt, own = [], C.parts
    monkeypatch.setattr(C, "parts", lambda units, *more: dealt.append(units.count()) or own(units, *more))
    rng = np.random.default_rng(14)
    x_r, x_d = rng.integers(0, 3, (30, 2)) + 0.5, rng.integers(0, 4, (70, 2)).astype(float)
    y_r, y_d = rng.normal(size=30), rng.normal(size=70)
    rows = [(1, g, i + 1, 30, v.tolist(), float(w)) for g, x, y in ((1, x_r, y_r), (0, x_d, y_d)) for i, (v, w) in enumerate(zip(x, y, strict=True))]
    units = spark.createDataFrame(rows, "sim long, g int, p long, n_r long, x array<double>, y double")
    found = {r["beta"]: r for r in R.beta_path(units, (0.0, 0.25, 3.0, 0.7, np.inf), gap=lambda x: x.sum(axis=1)).collect()}
    assert dealt == [len(np.unique(x_r, axis=0)) + len(np.unique(x_d, axis=0))]
    far = draws.distances(x_r[:, None], x_d[None], "l2")
    for beta, row in found.items():
        w = np.eye(70)[far.argmin(axis=1)] if np.isinf(beta) else (far + far.min(axis=1, keepdims=True)) ** -beta
        w = w / w.sum(axis=1, keepdims=True)
        assert np.isclose(row["tau"], (y_r - w @ y_d).mean()) and np.isclose(row["gap"], (x_r.sum(axis=1) - w @ x_d.sum(axis=1)).mean())


def test_weights_of_penalties_follow_from_each_other(monkeypatch):
    """The path's penalties take no exponential; others are worked out by themselves; a donor at distance 0 leaves NaN."""
    rng = np.random.default_rng(15)
    dist, totals = rng.random((5, 300)) + 1e-3, rng.normal(size=(300, 2))
    dist[3, 7] = 0.0
    assert all(a is not None for _, a, _ in R._powers([b for b in BETAS if b]))
    for betas in (BETAS, (0.3, 0.1, 7.0, 0.0, 2.5, 1e-3)):
        least = dist.min(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.stack([np.exp(-b * np.log((dist + least) / (2 * least))) @ totals for b in betas])
        got = R._weighed(dist, betas, totals)
        assert np.isnan(got[:, 3]).all() and np.allclose(np.delete(got, 3, axis=1), np.delete(want, 3, axis=1), rtol=1e-10, atol=1e-12)


def test_chains_hold_the_places_that_they_see(monkeypatch):
    """A spot's recipients are weighed at once, however many, and chains of few steps are those that hold all donors in order."""
    rng = np.random.default_rng(16)
    x_r, x_d = rng.integers(0, 2, (24, 2)) + 0.5, rng.integers(0, 5, (11, 2)).astype(float)
    rows = [{"g": g, "p": i + 1, "x": v, "y": float(i)} for g, x in ((1, x_r), (0, x_d)) for i, v in enumerate(x)]
    weighed, own, found = [], draws.kernel, []
    monkeypatch.setattr(draws, "kernel", lambda dist, beta: weighed.append(len(dist)) or own(dist, beta))
    for cells in (24 * 8 * 30, 11 * 9):
        monkeypatch.setattr(draws, "CELLS", cells)
        chunks = C.chains_of_part(pd.DataFrame(rows), 3, 30, 2, 1.0, "l2")
        found.append(dict(sorted((p, [(s[i].tolist(), bool(m[i])) for s, m in kept]) for places, _, _, steps in chunks for kept in [[(s.copy(), m) for s, m in steps]] for i, p in enumerate(places.tolist()))))
        assert cells == 11 * 9 or weighed == [4]
    assert found[0] == found[1] and len(found[0]) == 24


def test_the_place_of_a_value_is_where_it_stands_first():
    rng = np.random.default_rng(17)
    seen = rng.integers(0, 6, (9, 40))
    assert draws._first_seen(seen).tolist() == [[seen[:, c].tolist().index(v) for c, v in enumerate(row)] for row in seen.tolist()]


@pytest.mark.parametrize(("renewed", "least_sum"), [(3, 1e-3), (10**6, 1e-3), (4096, 20.0)])
def test_sums_that_are_kept_up_draw_as_a_matrix(monkeypatch, renewed, least_sum):
    """Sums made anew often or never, and sums that are too small for some rows; once a table is there, draws and moves work out no distances."""
    monkeypatch.setattr(C, "RENEWED", renewed)
    monkeypatch.setattr(C, "LEAST_SUM", least_sum)
    rng = np.random.default_rng(18)
    x_r, x_d = rng.integers(-3, 3, (20, 2)) / 2, rng.integers(-4, 4, (90, 2)) / 2
    one, other = _states(x_r, x_d, "greedy", 2)
    assert other.shared.table.shape == (len(np.unique(x_r, axis=0)), other.shared.n)
    worked, own = [], C.Distances.__getitem__
    monkeypatch.setattr(C.Distances, "__getitem__", lambda self, at: worked.append(at) or own(self, at))
    for t in range(1, 8):
        assert C.gibbs_sweep(one, t, 1.5) == C.gibbs_sweep(other, t, 1.5) and (one.cols == other.cols).all() and (one.free == other.free).all()
    assert not worked and np.isclose(one.distance, other.distance)


def test_few_replications_are_dealt_to_a_task_each(spark):
    from pairloom.plans.deal import deal_ranges

    rows = spark.range(11 * 40).select((F.col("id") % 11).alias("sim"))
    held = deal_ranges(rows, "sim").select("sim", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(held) == 11 and len({r["task"] for r in held}) == 11


def test_samplers_with_one_start_are_those_alone(spark):
    """The start of a constrained comparison is worked out once a replication, and neither sampler moves the other's."""
    from pairloom import compare, study

    rng = np.random.default_rng(19)
    rows = [{"sim": 4, "g": int(i < 5), "p": i + 1 if i < 5 else i - 4, "x": rng.normal(size=2).tolist(), "y": float(i)} for i in range(25)]
    frame, o = spark.createDataFrame(rows, "sim long, g int, p long, x array<double>, y double"), study.Options(n_iter=6)
    both = compare._constrained(frame, ("mcmc", "gibbs"), 2, o).orderBy("iter").toPandas()
    for name in ("mcmc", "gibbs"):
        alone = compare._constrained(frame, (name,), 2, o).orderBy("iter").toPandas()
        assert (both[f"tau_{name}"] == alone[f"tau_{name}"]).all() and (both[f"distance_{name}"] == alone[f"distance_{name}"]).all()
