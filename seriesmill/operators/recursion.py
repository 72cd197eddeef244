"""The one part SQL expressions cannot vectorise: the moving-average recursion.

A residual depends on the residuals before it, so it must be computed in
order.  These helpers run on a batch of blocks at once: a numpy loop over time
steps, vectorised over blocks (and trial coefficients).

A block does not know the residuals at its start.  But everything is linear in
them, so a block reports (a) its sequences for a zero start and for each unit
start as a small cross-product matrix and (b) where each ends; chaining those
reports along a series gives the exact sums as if it had been read in one go.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

BATCH = 256
# shares of the full step tried first, and if none of them helps
BOLD, CAUTIOUS = (1.0, 0.5), (0.25, 0.125, 0.0625, 0.03125)


def model_vector(p: int, q: int, mu: float, coef) -> list[float]:
    """A model as plain numbers: p, q, centre, then AR and MA coefficients."""
    return [float(p), float(q), float(mu), *[float(c) for c in coef]]


def recurse(u: np.ndarray, theta: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``e_t = u_t − Σ θ_j e_{t−j}`` per column, behind its q start values (oldest first)."""
    q = len(theta)
    e = np.concatenate([start, u])
    for row in range(q, len(e)):
        for j in range(q):
            e[row] -= theta[j] * e[row - 1 - j]
    return e


def sequences(y, length, skip, phi, theta, slopes=True):
    """Basis sequences of a batch of blocks, their cross-products and their ends.

    ``y`` is (p + L, blocks): p earlier values, then the block; ``skip`` leading
    rows are conditioned on.  Order of the basis: residual from a zero start,
    residual from each unit start; with ``slopes`` the derivatives by each AR
    coefficient and each MA coefficient from a zero start, then the MA
    derivatives caused by each unit start.
    """
    p, q = len(phi), len(theta)
    steps, count = y.shape[0] - p, y.shape[1]
    row = np.arange(steps)[:, None]
    scored = (row >= skip) & (row < length)
    zero = np.zeros((q, count))

    def ago(i):
        return np.where(scored, y[p - i:p - i + steps], 0.0)

    u = ago(0)
    for i in range(p):
        u = u - phi[i] * ago(i + 1)
    basis = [recurse(u, theta, zero)]
    for lag in range(q):
        unit = zero.copy()
        unit[q - 1 - lag] = 1.0
        basis.append(recurse(np.zeros_like(u), theta, unit))
    if slopes:
        residuals = basis[:1 + q]
        basis = basis + [recurse(-ago(i + 1), theta, zero) for i in range(p)]

        def by_ma(e):
            return [recurse(-e[q - j:q - j + steps], theta, zero) for j in range(1, q + 1)]

        basis += by_ma(residuals[0])
        basis += [d for j in zip(*[by_ma(g) for g in residuals[1:]]) for d in j]
    stack = np.stack(basis)
    inside = np.where(scored, stack[:, q:], 0.0).transpose(2, 0, 1)
    cross = inside @ inside.transpose(0, 2, 1)
    at = q + length[None, :] - 1 - np.arange(q)[:, None]
    ends = stack[:, at, np.arange(count)[None, :]].transpose(2, 0, 1)
    return cross, ends


def score(tasks, slopes=True):
    """Reports for ``(values, history, skip, model)`` tasks, as flat lists.

    ``values`` holds ``history`` earlier values (NaN if none) and the block.
    """
    groups = defaultdict(list)
    for place, (_, _, _, model) in enumerate(tasks):
        groups[int(model[0]), int(model[1])].append(place)
    out = [None] * len(tasks)
    with np.errstate(all="ignore"):
        for (p, q), places in groups.items():
            for lo in range(0, len(places), BATCH):
                part = places[lo:lo + BATCH]
                length = np.array([len(tasks[i][0]) - tasks[i][1] for i in part])
                y = np.zeros((p + length.max(), len(part)))
                for c, i in enumerate(part):
                    values, history, _, model = tasks[i]
                    y[:p + length[c], c] = values[history - p:] - model[2]
                coef = np.array([tasks[i][3][3:3 + p + q] for i in part]).reshape(len(part), p + q).T
                skip = np.array([min(tasks[i][2], n) for i, n in zip(part, length)])
                cross, ends = sequences(np.nan_to_num(y), length, skip, coef[:p], coef[p:], slopes)
                for c, i in enumerate(part):
                    out[i] = np.concatenate([cross[c].ravel(), ends[c].ravel()])
    return out


def chain(reports, p: int, q: int, slopes=True, before=None):
    """Exact sums over a series, or a stretch of it, from its blocks' reports in time order.

    ``before`` holds the residual lags before the first block, zero at the start
    of a series.  Returns the cross-products of residual and derivatives, the
    residual lags at the start of each block and those after the last one.
    """
    width = 1 + q + (p + q + q * q if slopes else 0)
    rows = 1 + (p + q if slopes else 0)
    total = np.zeros((rows, rows))
    state = np.zeros((rows, q))
    if before is not None:
        state[0] = before
    starts = []
    with np.errstate(all="ignore"):
        for flat in reports:
            cross = np.asarray(flat[:width * width]).reshape(width, width)
            ends = np.asarray(flat[width * width:]).reshape(width, q)
            mix = np.zeros((rows, width))
            mix[:, 1:1 + q] = state
            mix[0, 0] = 1.0
            for i in range(rows - 1):
                mix[1 + i, 1 + q + i] = 1.0
            if slopes:
                for j in range(q):
                    at = 1 + q + p + q + j * q
                    mix[1 + p + j, at:at + q] = state[0]
            starts.append(state[0])
            total += mix @ cross @ mix.T
            state = mix @ ends
    return total, starts, state[0]


def merge(first, second, p: int, q: int, slopes=True):
    """The report of two neighbouring blocks taken as one; merging is associative.

    Every sequence of the first block goes on in the second as a combination of
    the second's sequences: its own kind, plus what the values at the seam set
    off.  ``carry`` holds these combinations.
    """
    width = 1 + q + (p + q + q * q if slopes else 0)
    one, two = np.asarray(first, float), np.asarray(second, float)
    ends = one[width * width:].reshape(width, q)
    carry = np.zeros((width, width))
    carry[0, 0] = 1.0
    carry[:, 1:1 + q] = ends
    if slopes:
        for i in range(p + q):
            carry[1 + q + i, 1 + q + i] = 1.0
        for j in range(q):
            # the residual at the seam also drives the derivatives by MA coefficients
            at = 1 + q + p + q + j * q
            carry[1 + q + p + j, at:at + q] = ends[0]
            for lag in range(q):
                carry[at + lag, at:at + q] = ends[1 + lag]
    with np.errstate(all="ignore"):
        cross = one[:width * width].reshape(width, width) + (
            carry @ two[:width * width].reshape(width, width) @ carry.T)
        return np.concatenate([cross.ravel(), (carry @ two[width * width:].reshape(width, q)).ravel()])


def merged(reports, p: int, q: int, slopes=True):
    """One report for many neighbouring blocks."""
    total = reports[0]
    for report in reports[1:]:
        total = merge(total, report, p, q, slopes)
    return total


def stable(coef, p: int, q: int) -> bool:
    """Stationary AR part and invertible MA part, by step-down recursion."""
    for part in (np.asarray(coef[:p], float), -np.asarray(coef[p:p + q], float)):
        while len(part):
            k = part[-1]
            if not abs(k) < 1.0:
                return False
            part = (part[:-1] + k * part[:-1][::-1]) / (1 - k * k)
    return True


def steady(coef, p: int, q: int):
    """Shrink coefficients geometrically, lag by lag, until the model is stable."""
    coef = np.asarray(coef, float)
    powers = np.concatenate([np.arange(1, p + 1), np.arange(1, q + 1)])
    if not np.all(np.isfinite(coef)):
        return np.zeros(p + q)
    while not stable(coef, p, q):
        coef = coef * 0.95**powers
    return coef


def full_step(total):
    """Gauss–Newton step from the cross-products; None for a singular system."""
    try:
        move = -np.linalg.solve(total[1:, 1:], total[1:, 0])
    except np.linalg.LinAlgError:
        return None
    return move if np.all(np.isfinite(move)) else None


def points(coef, move, shares, p: int, q: int):
    """The stable points at the given shares of the step."""
    trials = [coef + share * move for share in shares]
    return [c for c in trials if stable(c, p, q)]


def best(trials, totals, coef, total):
    """The trial with the least sum of squares, or the point held so far."""
    for c, w in zip(trials, totals):
        if np.all(np.isfinite(w)) and (total is None or w[0, 0] < total[0, 0]):
            coef, total = c, w
    return coef, total


ROUNDS = 30
TOLERANCE = 1e-7


def search_step(trials, totals, coef, total, p: int, q: int):
    """One round: keep the best trial, propose new ones; no trials when done.

    Returns coefficients, cross-products, length of the next full step, trials.
    """
    held = total
    coef, total = best(trials, totals, coef, total)
    move = None if total is None else full_step(total)
    if move is None:
        return coef, total, np.inf, []
    size = float(np.max(np.abs(move), initial=0.0))
    if size < TOLERANCE:
        return coef, total, size, []
    if total is not held:
        more = points(coef, move, BOLD, p, q) or points(coef, move, CAUTIOUS, p, q)
    elif max(np.max(np.abs(c - coef)) for c in trials) > 0.3 * size:
        more = points(coef, move, CAUTIOUS, p, q)
    else:
        more = []
    return coef, total, size, more


def refine(tasks, rounds: int = ROUNDS):
    """Least squares for series that fit one block: ``(coef, cross-products, step)`` each."""
    held = []
    for values, history, skip, model in tasks:
        p, q = int(model[0]), int(model[1])
        coef = steady(model[3:3 + p + q], p, q)
        held.append([coef, None, np.inf, [coef]])
    for _ in range(rounds):
        live = [i for i, h in enumerate(held) if h[3]]
        if not live:
            break
        reports = iter(score([
            (*tasks[i][:3], model_vector(*tasks[i][3][:3], c)) for i in live for c in held[i][3]]))
        for i in live:
            p, q = int(tasks[i][3][0]), int(tasks[i][3][1])
            coef, total, _, trials = held[i]
            totals = [chain([next(reports)], p, q)[0] for _ in trials]
            held[i] = list(search_step(trials, totals, coef, total, p, q))
    return [h[:3] for h in held]
