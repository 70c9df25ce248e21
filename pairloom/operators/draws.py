"""Draws and running sums inside one task: a part of a replication's recipients with all its donors.

Recipients without donor constraints are independent, so a part works through
its own one after another; what it holds is a row of donors and a row of draws.
What leaves it is one row of sums a draw, whatever the number of recipients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from pairloom.functions import uniforms

#: Sums over matched sets of one draw, outcomes centred: recipients' t, set sums c of their donors' d.
SUMS = ("n", "m", "st", "stt", "sc", "scc", "stc", "sdd")
#: Cells of a matrix that a task holds at a time.
CELLS = 4_000_000


class Sums:
    """The sums of each draw, added up over recipients."""

    def __init__(self, n_draws: int) -> None:
        self.n = self.m = 0
        self.st = self.stt = 0.0
        self.sc, self.scc, self.stc, self.sdd = np.zeros((4, n_draws))

    def add(self, draws: slice, t: np.ndarray, dy: np.ndarray, first: bool = True) -> None:
        """Donors' outcomes ``dy`` (draws, recipients, donors of each) of recipients with outcomes ``t``; ``first`` if these are new."""
        c = dy.sum(axis=2)
        self.sc[draws] += c.sum(axis=1)
        self.scc[draws] += (c * c).sum(axis=1)
        self.stc[draws] += c @ t
        self.sdd[draws] += (dy * dy).sum(axis=(1, 2))
        if first:
            self.n += len(t)
            self.m += dy.shape[1] * dy.shape[2]
            self.st += float(t.sum())
            self.stt += float((t * t).sum())

    def rows(self, **more: object) -> pd.DataFrame:
        return pd.DataFrame({"iter": np.arange(1, len(self.sc) + 1), **{name: getattr(self, name) for name in SUMS}, **more})


def distances(x: np.ndarray, others: np.ndarray, kind: str) -> np.ndarray:
    """Distances of one unit to others, or of pairs: l1, l2, or l2_squared."""
    gap = x - others
    if kind == "l1":
        return np.abs(gap).sum(axis=-1)
    squares = (gap * gap).sum(axis=-1)
    return squares if kind == "l2_squared" else np.sqrt(squares)


def spots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units with the same covariates share a spot: the first unit of each spot, in order, and the spot of each unit."""
    # Adding 0 makes -0.0 the same as 0.0.
    _, first, of = np.unique(x + 0.0, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    return first[order], number[of.ravel()]


def kernel(dist: np.ndarray, beta: float) -> np.ndarray:
    """Weights proportional to (dist + least dist) ** -beta along the last axis, that add up to 1; with a donor at distance 0 all are NaN, as in SQL."""
    shifted = dist + dist.min(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = -beta * np.log(shifted)
        e = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def odds(alpha: np.ndarray) -> np.ndarray:
    if (alpha == 1).any():
        raise ValueError("one donor has all the weight, so sets of several have none")
    return alpha / (1 - alpha)


def one_donor(alpha: np.ndarray, sim: int, rp: int, n_draws: int) -> np.ndarray:
    """Donor of each draw: the first whose cumulative weight reaches the draw's number."""
    cdf = np.cumsum(alpha)
    cdf[-1] = 1.0
    return np.searchsorted(cdf, uniforms(f"u1|{sim}|{rp}|", range(1, n_draws + 1)))


def set_sums(alpha: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """after and upto, by the number r of donors to go.

    after[r][j] is the weight of all sets of r donors from j on.  With r donors
    to go, the next is j with weight odds[j] * after[r - 1][j + 1]; upto[r] sums
    these.
    """
    w, n = odds(alpha), len(alpha)
    if n < k:
        raise ValueError("a recipient needs a donor for each slot")
    after, upto = [np.ones(n + 1)], [np.zeros(0)]
    for _ in range(k):
        each = w * after[-1][1:]
        upto.append(np.cumsum(each))
        after.append(np.append(np.cumsum(each[::-1])[::-1], 0.0))
    return after, upto


def k_donors(alpha: np.ndarray, sim: int, rp: int, n_draws: int, k: int) -> np.ndarray:
    """(draws, k): exact draws of k different donors with weight the product of their odds."""
    return donors_of(set_sums(alpha, k), sim, rp, n_draws, k)


def donors_of(sums: tuple[list[np.ndarray], list[np.ndarray]], sim: int, rp: int, n_draws: int, k: int) -> np.ndarray:
    """What k_donors gives, from the sums that recipients with the same weights share."""
    after, upto = sums
    n = len(after[0]) - 1
    begin, out = np.zeros(n_draws, np.int64), np.empty((n_draws, k), np.int64)
    for place in range(k):
        r = k - place
        passed = np.where(begin > 0, upto[r][begin - 1], 0.0)
        target = passed + uniforms(f"k{place + 1}|{sim}|{rp}|", range(1, n_draws + 1)) * after[r][begin]
        out[:, place] = np.clip(np.searchsorted(upto[r], target), begin, n - r)
        begin = out[:, place] + 1
    return out


def k_set_chains(dist: np.ndarray, beta: float, sim: int, places: np.ndarray, n_iter: int, k: int, row: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A chain of k-sets for each place: the donors (recipients, k) after each step, and who moved.

    ``row`` is each recipient's row of ``dist``, if recipients share rows.

    A set begins as the k nearest.  A step offers one member's place to one
    donor outside, taken by the ratio of their odds.  A chain of few steps sees
    its first k places and those that it offers; it holds these and no others.
    """
    n, n_d = len(places), dist.shape[1]
    row = np.arange(n) if row is None else row
    if n_d <= k:
        raise ValueError("a recipient needs more donors than slots")
    w = odds(kernel(dist, beta))
    order = np.argsort(dist, axis=1, kind="stable")
    rows, ahead = np.arange(n), max(1, min(n_iter, CELLS // (8 * n)))
    few = ahead == n_iter
    if not few:
        held = order[row].T
        odds_held = w[row, held]
    for begin in range(1, n_iter + 1, ahead):
        steps = range(begin, min(begin + ahead, n_iter + 1))
        draw = lambda tag: np.stack([uniforms(f"{sim}|{p}|", steps, f"|{tag}") for p in places.tolist()], axis=1)
        outs, ins, u = (draw("i") * k).astype(np.int64), k + (draw("j") * (n_d - k)).astype(np.int64), draw("u")
        if few:
            seen = np.concatenate([np.repeat(np.arange(k)[:, None], n, axis=1), ins])
            held = order[row, seen]
            odds_held, ins = w[row, held], _first_seen(seen)[k:]
        for s in range(len(steps)):
            i, j = outs[s], ins[s]
            old, new, w_old, w_new = held[i, rows], held[j, rows], odds_held[i, rows], odds_held[j, rows]
            # Odds that are NaN count as 1, as the least of 1 and NaN is 1 in SQL.
            moved = u[s] < np.fmin(1.0, w_new / w_old)
            held[i, rows], held[j, rows] = np.where(moved, new, old), np.where(moved, old, new)
            odds_held[i, rows], odds_held[j, rows] = np.where(moved, w_new, w_old), np.where(moved, w_old, w_new)
            yield held[:k].T, moved


def _first_seen(seen: np.ndarray) -> np.ndarray:
    """For each cell the number of the row in which its value first stands in its column."""
    order = np.argsort(seen, axis=0, kind="stable")
    values, count = np.take_along_axis(seen, order, axis=0), np.arange(len(seen))[:, None]
    new = np.concatenate([np.ones((1, seen.shape[1]), bool), values[1:] != values[:-1]])
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.take_along_axis(order, np.maximum.accumulate(np.where(new, count, 0), axis=0), axis=0), axis=0)
    return out
