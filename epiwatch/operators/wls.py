"""Weighted least squares per series, one row a series.

Solves ``min sum w (y - X b)^2`` for every series at once. One aggregate on the
series keys lists the rows of each, whose number the calendar bounds (weeks x
years); the rest are expressions on that row: weighted modified Gram-Schmidt
with pivoting. Each column carries its combination of the given ones. In turn
the longest column left is taken off the others and off the residual, and its
share goes to the solution. A column of which no more than ``tol`` of its own
square is left depends on the others: its combination is a direction in which
the solution is free, and the solution's part along these directions is taken
off, which gives the minimum-norm solution, as ``numpy.linalg.lstsq`` does.
Rows with weight 0 (the future weeks) get their prediction ``x . b``.

The plan is one exchange on the series keys: no window, no Python, no second
evaluation of the series. Sums of products (normal equations) would spare the
list of rows but square the condition number: on nine neighbouring weeks they
miss the least-squares fit by more than its own size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_TOL = 1e-24


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` stands for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (da, db) -> da * db), 0D, (ds, dv) -> ds + dv)"


def _without(v: str, u: str) -> str:
    """SQL of the vector ``v`` less its part along the unit vector ``u``."""
    return _let("wp", _dot(v, u), f"zip_with({v}, {u}, (wv, wu) -> wv - wp * wu)")


def _orthogonalised(k: int, tol: float) -> str:
    """SQL of (c, p, r, b): the columns ``_c`` (z: values, t: combination) made
    orthogonal, the places of those used, the residual and the solution."""
    left = f"array_max(transform(sequence(0, {k - 1}), j -> named_struct('d', if(array_contains(s.p, j), -1D, {_dot('s.c[j].z', 's.c[j].z')}), 'j', j)))"
    less = _let("f", f"{_dot('v.z', 'c.z')} / m.d", "named_struct('z', zip_with(c.z, v.z, (x, y) -> x - f * y), 't', zip_with(c.t, v.t, (x, y) -> x - f * y))")
    others = f"transform(s.c, (c, j) -> if(j = m.j OR array_contains(s.p, j), c, {less}))"
    used = _let("g", f"{_dot('v.z', 's.r')} / m.d", f"named_struct('c', {others}, 'p', array_append(s.p, m.j), "
                "'r', zip_with(s.r, v.z, (x, y) -> x - g * y), 'b', zip_with(s.b, v.t, (x, y) -> x + g * y))")
    step = _let("m", left, f"if(m.d > {tol!r}D, {_let('v', 's.c[m.j]', used)}, s)")
    zeros = ", ".join(["0D"] * k)
    start = f"named_struct('c', _c, 'p', cast(array() AS array<int>), 'r', _r, 'b', array({zeros}))"
    return f"aggregate(sequence(1, {k}), {start}, (s, n) -> {step})"


def wls_fit(df: DataFrame, part: Sequence[str], xs: Sequence[str], y: str = "y",
            w: str = "w", tol: float = RANK_TOL) -> DataFrame:
    """The other columns of ``df`` with ``fit`` (fitted or predicted value) and
    ``deficient`` (whether columns depend on each other in this series).

    Rows with a weight of 0 or null do not train, whatever their ``y``; in a
    series without training rows ``fit`` is NaN.
    """
    k = len(xs)
    every = f"sequence(0, {k - 1})"
    keys = [_q(c) for c in part]
    keep = [c for c in df.columns if c not in (*xs, y, w)]
    rest = [_q(c) for c in keep if c not in part]
    weight = f"coalesce(CAST({_q(w)} AS DOUBLE), 0D)"
    x = ", ".join(f"CAST({_q(c)} AS DOUBLE)" for c in xs)
    rows = df.selectExpr(*keys, f"struct({weight} AS w, array({x}) AS x, if({weight} > 0, CAST({_q(y)} AS DOUBLE), 0D) AS y, "
                                f"struct({', '.join([*rest, '1 AS _one'])}) AS rest) AS _row")
    # Sorted, so that sums do not depend on the order in which rows arrive.
    series = rows.groupBy(*part).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    series = series.selectExpr("*", "filter(_rows, r -> r.w > 0) AS _train")
    series = series.selectExpr(*keys, "_rows", "size(_train) AS _n", "transform(_train, r -> sqrt(r.w) * r.y) AS _r",
                               f"transform({every}, j -> transform(_train, r -> sqrt(r.w) * r.x[j])) AS _z")
    series = series.selectExpr("*", f"transform(_z, z -> {_let('o', _dot('z', 'z'), 'if(o > 0, sqrt(o), 1D)')}) AS _l")
    unit = f"named_struct('z', transform(_z[j], v -> v / _l[j]), 't', transform({every}, i -> if(i = j, 1D / _l[j], 0D)))"
    series = series.selectExpr(*keys, "_rows", "_n", "_r", f"transform({every}, j -> {unit}) AS _c")
    series = series.selectExpr(*keys, "_rows", "_n", f"{_orthogonalised(k, tol)} AS _s")

    free = f"transform(filter({every}, j -> NOT array_contains(_s.p, j)), j -> _s.c[j].t)"
    upright = f"aggregate(basis, v, (z, u) -> {_without('z', 'u')})"
    of_length_1 = _let("o", upright, _let("l", f"sqrt({_dot('o', 'o')})", "transform(o, ov -> ov / l)"))
    basis = f"aggregate({free}, cast(array() AS array<array<double>>), (basis, v) -> array_append(basis, {of_length_1}))"
    series = series.selectExpr(*keys, "_rows", "_n", f"size(_s.p) < {k} AS deficient", "_s.b AS _b", f"{basis} AS _basis")
    series = series.selectExpr(*keys, "_rows", "_n", "deficient", f"aggregate(_basis, _b, (z, u) -> {_without('z', 'u')}) AS _b")
    out = series.selectExpr(*keys, "deficient", "_n", "_b", "explode(_rows) AS _row")
    columns = [_q(c) if c in part else f"_row.rest.{_q(c)} AS {_q(c)}" for c in keep]
    return out.selectExpr(*columns, f"if(_n = 0, double('NaN'), {_dot('_row.x', '_b')}) AS fit", "deficient")
