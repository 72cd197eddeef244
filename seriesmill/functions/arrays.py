"""Vectors and small matrices in SQL expressions.

Every helper takes and returns the text of a Spark SQL expression, to be used
with ``F.expr``; a matrix is an ``array<array<double>>``.  They work within one
row and serve the one-row-per-series tables left after an aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

_numbers = count()


def fresh() -> str:
    """A lambda variable no enclosing expression uses."""
    return f"v{next(_numbers)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it many times in ``body``.

    The optimizer merges neighbouring projections; a column read inside a
    lambda would otherwise be recomputed for every array element.
    """
    v = fresh()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def each(a: str, body: Callable[[str], str]) -> str:
    v = fresh()
    return f"transform({a}, {v} -> {body(v)})"


def each_at(a: str, body: Callable[[str, str], str]) -> str:
    """``each`` with the 0-based index as second argument."""
    v, i = fresh(), fresh()
    return f"transform({a}, ({v}, {i}) -> {body(v, i)})"


def fold(a: str, start: str, step: Callable[[str, str], str]) -> str:
    s, v = fresh(), fresh()
    return f"aggregate({a}, {start}, ({s}, {v}) -> {step(s, v)})"


def pairwise(a: str, b: str, body: Callable[[str, str], str]) -> str:
    u, v = fresh(), fresh()
    return f"zip_with({a}, {b}, ({u}, {v}) -> {body(u, v)})"


def doubles(values: Iterable[float]) -> str:
    """A literal ``array<double>``; an empty list keeps its element type."""
    return f"cast(array({', '.join(f'{float(v)!r}D' for v in values)}) as array<double>)"


def count_up(n: str | int) -> str:
    """``[0, 1, …, n-1]``; empty for n = 0 (``sequence`` would count down)."""
    return f"slice(sequence(0, greatest({n}, 1) - 1), 1, {n})"


def total(a: str) -> str:
    return fold(a, "0D", lambda s, v: f"{s} + {v}")


def dot(a: str, b: str) -> str:
    """Sum of products; NULL when the lengths differ."""
    return total(pairwise(a, b, lambda u, v: f"{u} * {v}"))


def mat_vec(m: str, v: str) -> str:
    return each(m, lambda row: dot(row, v))


def solve_spd(a: str, rhs: str) -> str:
    """Solve ``a · y = rhs`` for a symmetric positive definite matrix.

    Gauss–Jordan elimination without pivoting.  NULL when a pivot vanishes
    against its own diagonal, that is for a singular system.
    """
    def solve(m0: str) -> str:
        def eliminate(m: str, j: str) -> str:
            pivot = f"get(get({m}, {j}), {j})"
            safe = f"if({pivot} > abs(get(get({m0}, {j}), {j})) * 1e-13D, {pivot}, null)"
            return let(
                let(safe, lambda s: each(f"get({m}, {j})", lambda v: f"{v} / {s}")),
                lambda lead: each_at(m, lambda row, i: (
                    f"if({i} = {j}, {lead}, "
                    + pairwise(row, lead, lambda u, v: f"{u} - get({row}, {j}) * {v}") + ")")))

        reduced = fold(count_up(f"size({m0})"), m0, eliminate)
        v = fresh()
        return let(
            each(reduced, lambda row: f"get({row}, size({m0}))"),
            lambda y: f"if(exists({y}, {v} -> {v} is null or isnan({v})), null, {y})")

    return let(pairwise(a, rhs, lambda row, r: f"concat({row}, array({r}))"), solve)
