"""Block-local x-update solvers (numpy), run inside Spark grouped maps.

Each block i solves one strongly convex subproblem

    x_i = argmin_x  f_i(x) + rho/2 * ||x - v_i||^2,     v_i = z - y_i / rho,

warm-started at its previous x_i.  The block arrives as one Arrow table (a grouped
map over the block's rows, which Spark keeps in place between passes); these helpers
turn it into a dense matrix or a CSR triple without a Python loop over rows, then
run a small vectorised solver.  Nothing here talks to Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# ---------------------------------------------------------------- block packing


#: stored values of sparse rows that a product takes at a time, so that its intermediate vectors stay in the processor's cache
RUN_VALUES = 1 << 16


@dataclass
class CSR:
    """Row-compressed sparse block: rows[k], rising, is the row of the k-th stored value."""

    n: int
    p: int
    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    @cached_property
    def lens(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=self.n)

    @cached_property
    def runs(self) -> list[tuple[np.ndarray, int, int, np.ndarray]]:
        """Rows with stored values in runs of about RUN_VALUES of these: the rows, where their values begin and end, and where
        each row's begin within."""
        rows = np.flatnonzero(self.lens)
        ends = np.cumsum(self.lens[rows])
        starts = ends - self.lens[rows]
        many = max(RUN_VALUES, 4 * self.p)
        cuts = [0, *(np.flatnonzero(np.diff(starts // many)) + 1).tolist(), len(rows)] if len(rows) else []
        return [(rows[i:j], int(starts[i]), int(ends[j - 1]), starts[i:j] - starts[i]) for i, j in zip(cuts, cuts[1:])]

    def matvec(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for rows, lo, hi, starts in self.runs:
            out[rows] = np.add.reduceat(self.vals[lo:hi] * w[self.cols[lo:hi]], starts)
        return out

    def rmatvec(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.p)
        for rows, lo, hi, _ in self.runs:
            out += np.bincount(self.cols[lo:hi], weights=self.vals[lo:hi] * np.repeat(r[rows], self.lens[rows]), minlength=self.p)
        return out


def _list_parts(col: pa.ChunkedArray | pa.Array):
    """Offsets and flat values of a list column, combined into one chunk."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    offsets = col.offsets.to_numpy(zero_copy_only=False)
    flat = col.values.to_numpy(zero_copy_only=False)
    start = offsets[0]
    return offsets - start, flat[start: offsets[-1]]


def dense_block(table: pa.Table, features: str = "features", p: int | None = None) -> np.ndarray:
    """Stack an ``array<double>`` column into an n x p matrix."""
    n = table.num_rows
    if n == 0:
        return np.zeros((0, p or 0))
    offsets, flat = _list_parts(table.column(features))
    width = int(offsets[1] - offsets[0])
    if not np.all(np.diff(offsets) == width):
        raise ValueError("dense rows of unequal length in one block")
    if p is not None and width != p:
        raise ValueError(f"dense rows have {width} values, model has {p}")
    return np.asarray(flat, dtype=np.float64).reshape(n, width)


def sparse_block(table: pa.Table, p: int, indices: str = "indices", values: str = "values") -> CSR:
    """CSR view of ``indices array<int>`` / ``values array<double>`` columns."""
    n = table.num_rows
    if n == 0:
        return CSR(0, p, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    offsets, cols = _list_parts(table.column(indices))
    _, vals = _list_parts(table.column(values))
    rows = np.repeat(np.arange(n), np.diff(offsets))
    cols = np.asarray(cols, dtype=np.int64)
    if cols.size and (cols.min() < 0 or cols.max() >= p):
        raise ValueError(f"feature index outside [0, {p})")
    return CSR(n, p, rows, cols, np.asarray(vals, dtype=np.float64))


def features_kind(columns: list[str]) -> str:
    """"dense" (``features``) or "sparse" (``indices`` and ``values``) rows."""
    if "features" in columns:
        return "dense"
    if {"indices", "values"} <= set(columns):
        return "sparse"
    raise ValueError("rows need `features` (dense) or `indices`+`values` (sparse)")


def row_columns(kind: str) -> list[str]:
    return ["block_id", "label", "features"] if kind == "dense" else ["block_id", "label", "indices", "values"]


def list_column(v: np.ndarray) -> pa.Array:
    """One list<double> holding ``v``, without a copy through Python objects."""
    v = np.ascontiguousarray(v, dtype=np.float64).ravel()
    return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))


def labels_of(table: pa.Table, label: str = "label") -> np.ndarray:
    return pc.cast(table.column(label), pa.float64()).to_numpy()


class _Dense:
    """Adapter so dense and CSR blocks share matvec / rmatvec."""

    def __init__(self, X: np.ndarray):
        self.X = X
        self.n, self.p = X.shape

    def matvec(self, w):
        return self.X @ w

    def rmatvec(self, r):
        return self.X.T @ r


def as_operator(X):
    return _Dense(X) if isinstance(X, np.ndarray) else X


# ---------------------------------------------------------------- losses


def log1pexp(t: np.ndarray) -> np.ndarray:
    """log(1 + e^t) without overflow."""
    return np.where(t > 0, t + np.log1p(np.exp(-np.abs(t))), np.log1p(np.exp(-np.abs(t))))


def sigmoid(t: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(t))
    return np.where(t >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


#: rows of a dense matrix that a loss is evaluated on at a time, so that its intermediate vectors stay in the processor's cache
LOSS_ROWS = 1 << 14


class Summed:
    """w -> (value, gradient) of a loss summed over rows; ``part(scores, labels) -> (value, its derivatives by the scores)``.

    A dense matrix is taken by runs of rows.  Sparse rows are one run, and their scores at the last point are kept: along a line
    they are linear in the step (``line``), so a trial step costs a number per row, not per stored value."""

    def __init__(self, X, ypm: np.ndarray, part: Callable):
        self.A, self.ypm, self.part, self.sparse = as_operator(X), ypm, part, not isinstance(X, np.ndarray)
        self.runs = [(self.A, ypm)] if self.sparse else \
            [(_Dense(X[lo:lo + LOSS_ROWS]), ypm[lo:lo + LOSS_ROWS]) for lo in range(0, self.A.n, LOSS_ROWS)]
        self.held: tuple[np.ndarray | None, np.ndarray | None] = (None, None)

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        f, g = 0.0, np.zeros(self.A.p)
        for rows, y in self.runs:
            scores = rows.matvec(w)
            value, slope = self.part(scores, y)
            f += value
            g += rows.rmatvec(slope)
            if self.sparse:
                self.held = w, scores
        return f, g

    def line(self, x: np.ndarray, d: np.ndarray) -> Callable:
        """t -> (value at x + t d, slope along d, (new point) -> gradient there)."""
        at = self.held[1] if self.held[0] is x else self.A.matvec(x)
        along = self.A.matvec(d)

        def trial(t: float):
            scores = at + t * along
            f, slope = self.part(scores, self.ypm)

            def gradient(new: np.ndarray) -> np.ndarray:
                self.held = new, scores
                return self.A.rmatvec(slope)

            return f, float(slope @ along), gradient

        return trial


#: factors between 1 and 2 whose product stays finite
FACTORS = 512


def sum_log1p(e: np.ndarray) -> float:
    """Sum of log(1 + e) for 0 <= e <= 1, by one logarithm of every FACTORS factors."""
    many = len(e) // FACTORS
    factors = 1.0 + e
    products = factors[:many * FACTORS].reshape(FACTORS, many).prod(axis=0)
    return float(np.sum(np.log(products)) + np.log(factors[many * FACTORS:].prod()))


def logistic_sum(X, ypm: np.ndarray):
    """f(w) = sum log(1 + exp(-y w.x)) and its gradient; y in {-1, +1}."""

    def part(scores, y):
        m = y * scores
        e = np.exp(-np.abs(m))  # log(1 + exp(-m)) and sigmoid(-m) from one exponential, which cannot overflow
        f = sum_log1p(e) - float(np.sum(np.minimum(m, 0.0)))
        return f, -y * np.where(m >= 0, e, 1.0) / (1.0 + e)

    return Summed(X, ypm, part)


def logistic_curvature(X, ypm: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Second derivative of each row's loss by its margin."""
    e = np.exp(-np.abs(as_operator(X).matvec(w)))
    return e / np.square(1.0 + e)


def squared_hinge_sum(X, ypm: np.ndarray, cee: float):
    """f(w) = C * sum max(1 - y w.x, 0)^2 and gradient 2C sum_{active} (w.x - y) x."""

    def part(scores, y):
        h = np.maximum(1.0 - y * scores, 0.0)
        return cee * float(h @ h), 2.0 * cee * np.where(h > 0, scores - y, 0.0)

    return Summed(X, ypm, part)


def squared_hinge_curvature(X, ypm: np.ndarray, cee: float, w: np.ndarray) -> np.ndarray:
    """Second derivative of each row's loss by its margin."""
    return np.where(ypm * as_operator(X).matvec(w) < 1.0, 2.0 * cee, 0.0)


#: an L-BFGS run begins with the inverse Hessian up to this width, with the inverse of its diagonal beyond
METRIC_P = 32


def inverse_curvature(X, curvature: np.ndarray, rho: float) -> Callable[[np.ndarray], np.ndarray]:
    """d -> H0 d, H0 the inverse of X^T diag(curvature) X + rho I, or of its diagonal beyond METRIC_P features."""
    A = as_operator(X)
    if A.p > METRIC_P:
        if isinstance(X, np.ndarray):
            diagonal = sum((curvature[lo:lo + LOSS_ROWS] @ np.square(X[lo:lo + LOSS_ROWS]) for lo in range(0, A.n, LOSS_ROWS)), np.zeros(A.p))
        else:
            diagonal = np.bincount(X.cols, weights=np.square(X.vals) * curvature[X.rows], minlength=A.p)
        scale = 1.0 / (diagonal + rho)
        return lambda d: scale * d
    H = rho * np.eye(A.p)
    if isinstance(X, np.ndarray):
        for lo in range(0, A.n, LOSS_ROWS):
            H += (X[lo:lo + LOSS_ROWS].T * curvature[lo:lo + LOSS_ROWS]) @ X[lo:lo + LOSS_ROWS]
    else:
        H += gram_of(scaled_rows(X, np.sqrt(curvature)))
    inverse = np.linalg.inv(H)
    return lambda d: inverse @ d


class with_prox:
    """Add the augmented-Lagrangian term rho/2 ||w - v||^2 to (value, gradient) ``fg``."""

    def __init__(self, fg, v: np.ndarray, rho: float):
        self.fg, self.v, self.rho = fg, v, rho

    def __call__(self, w):
        f, g = self.fg(w)
        d = w - self.v
        return f + 0.5 * self.rho * float(d @ d), g + self.rho * d

    def line(self, x: np.ndarray, d: np.ndarray) -> Callable:
        """t -> ((t, value, slope) at x + t d, function of nothing that gives the point there: (t, x + t d, value, gradient))."""
        if not getattr(self.fg, "sparse", False):
            return _line(self, x, d)
        loss = self.fg.line(x, d)

        def trial(t: float):
            new = x + t * d
            f, slope, gradient = loss(t)
            off = new - self.v
            f += 0.5 * self.rho * float(off @ off)
            return (t, f, slope + self.rho * float(off @ d)), lambda: (t, new, f, gradient(new) + self.rho * off)

        return trial


def _line(fg, x: np.ndarray, d: np.ndarray) -> Callable:
    """``with_prox.line`` of any (value, gradient)."""
    def trial(t: float):
        new = x + t * d
        f, g = fg(new)
        return (t, f, float(g @ d)), lambda: (t, new, f, g)

    return trial


# ---------------------------------------------------------------- solvers


#: sufficient decrease and curvature constants of the line search
DECREASE, CURVATURE = 1e-4, 0.9
#: part of a summed value that its rounding may hide
ROUNDING = 1e-15


def _between(a: tuple, b: tuple) -> float:
    """Minimiser of the cubic through two trial steps (step, value, slope), kept away from both ends."""
    (ta, fa, da), (tb, fb, db) = a, b
    low, high = min(ta, tb), max(ta, tb)
    margin = 0.1 * (high - low)
    d1 = da + db - 3.0 * (fa - fb) / (ta - tb)
    square = d1 * d1 - da * db
    if square >= 0.0:
        d2 = math.copysign(math.sqrt(square), tb - ta)
        bottom = db - da + 2.0 * d2
        if bottom != 0.0:
            t = tb - (tb - ta) * (db + d2 - d1) / bottom
            if math.isfinite(t):
                return min(max(t, low + margin), high - margin)
    return 0.5 * (low + high)


def strong_wolfe(fg, x: np.ndarray, d: np.ndarray, f0: float, slope0: float, step: float = 1.0, max_calls: int = 30):
    """(step, x, value, gradient) along a descent direction with f <= f0 + c1 step slope0 and
    |slope| <= c2 |slope0|: steps are lengthened until they bracket such a point, then the
    bracket is narrowed by cubic interpolation.  After ``max_calls`` the best point that
    decreases enough is taken (None if rounding leaves none)."""
    trial = fg.line(x, d) if hasattr(fg, "line") else _line(fg, x, d)
    start = (0.0, f0, slope0)
    low, high, best, least = start, None, None, math.inf
    t = step
    for _ in range(max_calls):
        at, point = trial(t)
        enough = at[1] <= f0 + DECREASE * t * slope0
        if enough and at[1] < least:
            best, least = point, at[1]
        if not enough or (low[0] > 0.0 and at[1] >= low[1]) or not math.isfinite(at[1]):
            high = at
        elif abs(at[2]) <= -CURVATURE * slope0:
            return point()
        else:
            if high is None:
                if at[2] >= 0.0:
                    high, low = low, at
                else:
                    low = at
            else:
                if at[2] * (high[0] - low[0]) >= 0.0:
                    high = low
                low = at
        if high is None:
            t = 2.0 * t
        elif not math.isfinite(high[1]):
            t = 0.5 * (low[0] + high[0])
        else:
            t = _between(low, high)
            if abs(high[0] - low[0]) * float(np.linalg.norm(d)) < 1e-14 * max(1.0, float(np.linalg.norm(x))):
                break
    return best() if best else None


def lbfgs(fg, x0: np.ndarray, max_iter: int = 10, history: int = 5, tol: float = 1e-4,
          metric: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Limited-memory BFGS with a strong-Wolfe line search, so that every step's pair has
    positive curvature and enters the history.

    ``metric`` is the inverse Hessian that the history corrects (default: a multiple of the identity); with it
    the first step has its natural length.  Where a step's decrease is below the rounding of the value, no line search can see it:
    the step is taken once if it shortens the gradient, and the run ends.  Otherwise it stops after ``max_iter`` steps, when the gradient norm falls below
    ``tol * max(1, |f|)``, or when the relative decrease of f falls below ``tol``.
    """
    x = np.array(x0, dtype=np.float64, copy=True)
    f, g = fg(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        size = float(np.linalg.norm(g))
        if size <= tol * max(1.0, abs(f)):
            break
        d = -g
        alphas = []
        for s, y, sy in reversed(pairs):
            a = float(s @ d) / sy
            alphas.append(a)
            d = d - a * y
        if metric is not None:
            d = metric(d)
        elif pairs:
            s, y, sy = pairs[-1]
            d = d * (sy / float(y @ y))
        for (s, y, sy), a in zip(pairs, reversed(alphas)):
            d = d + s * (a - float(y @ d) / sy)
        slope = float(g @ d)
        if slope >= 0.0:  # rounding spoilt the direction: start again from steepest descent
            pairs.clear()
            d, slope, metric = -g, -size * size, None
        if (metric is not None or pairs) and -slope <= ROUNDING * abs(f):
            _, g_new = fg(x + d)
            return x + d if float(np.linalg.norm(g_new)) < size else x
        found = strong_wolfe(fg, x, d, f, slope, 1.0 if pairs or metric is not None else 1.0 / max(size, 1e-12))
        if found is None:
            break
        _, x_new, f_new, g_new = found
        s, y = x_new - x, g_new - g
        sy = float(s @ y)
        if sy > 1e-300:
            pairs.append((s, y, sy))
            if len(pairs) > history:
                pairs.pop(0)
        improvement = (f - f_new) / max(abs(f_new), 1.0)
        x, f, g = x_new, f_new, g_new
        if improvement < tol * 1e-3:
            break
    return x


#: a Newton step is solved with the p x p Hessian up to this width, and by conjugate gradients on Hessian-vector products beyond
NEWTON_DIRECT_P = 256


class NotConverged(RuntimeError):
    """A block solver stopped at its iteration cap."""


def conjugate_gradients(product, rhs: np.ndarray, x0: np.ndarray, stop: float, max_iter: int) -> tuple[np.ndarray, bool]:
    """(x, whether the residual norm fell to ``stop``) of a symmetric positive definite system
    given by its matrix-vector product."""
    x = np.array(x0, dtype=np.float64, copy=True)
    r = rhs - product(x) if x.any() else rhs.copy()
    d, rr = r.copy(), float(r @ r)
    for _ in range(max_iter):
        if math.sqrt(rr) <= stop:
            return x, True
        Ad = product(d)
        step = rr / float(d @ Ad)
        x += step * d
        r -= step * Ad
        new = float(r @ r)
        d = r + (new / rr) * d
        rr = new
    return x, math.sqrt(rr) <= stop


def newton_logistic_mean(X, y01: np.ndarray, v: np.ndarray, rho: float, x0: np.ndarray, rows: int | None = None,
                         max_iter: int = 100, eps_abs: float = 1e-6, eps_rel: float = 1e-6,
                         direct_p: int = NEWTON_DIRECT_P) -> np.ndarray:
    """Damped Newton on (1/m) sum logloss + rho/2 ||x - v||^2, labels 0/1.

    m is ``rows``, the rows of the whole block when this is a part of one, else the rows given.
    Up to ``direct_p`` features a step solves with the Hessian's Cholesky factor.  Wider
    models never form it: a step is a truncated conjugate-gradient solve on products
    H d = X^T (w * (X d)) / m + rho d, the tighter the smaller the gradient is.  A step is halved
    until the value falls; the last one is below eps_abs sqrt(p) or eps_rel ||x||."""
    m = max(rows or len(y01), 1)
    summed = logistic_sum(X, 2.0 * y01 - 1.0)
    A = as_operator(X)

    def scaled(w):
        f, g = summed(w)
        return f / m, g / m

    fg = with_prox(scaled, v, rho)
    x = np.array(x0, dtype=np.float64, copy=True)
    f, g = fg(x)
    for _ in range(max_iter):
        mu = sigmoid(A.matvec(x))
        weight = mu * (1.0 - mu) / m
        if len(x) <= direct_p:
            H = gram_of(scaled_rows(X, np.sqrt(weight)))
            H[np.diag_indices_from(H)] += rho
            factor = np.linalg.cholesky(H)
            step = -np.linalg.solve(factor.T, np.linalg.solve(factor, g))
        else:
            size = float(np.linalg.norm(g))
            step, _ = conjugate_gradients(lambda d: A.rmatvec(weight * A.matvec(d)) + rho * d, -g, np.zeros_like(x),
                                          max(min(0.1, math.sqrt(size)), 1e-8) * size, 2 * len(x))
        t, slope = 1.0, float(g @ step)
        while True:
            new = x + t * step
            f_new, g_new = fg(new)
            if f_new <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t *= 0.5
        x, f, g = new, f_new, g_new
        size = t * float(np.linalg.norm(step))
        if size < eps_abs * math.sqrt(len(x)) or size < eps_rel * float(np.linalg.norm(x)):
            return x
    raise NotConverged(f"Newton's method took {max_iter} steps")


def scaled_rows(X, d: np.ndarray):
    """diag(d) X, keeping its form."""
    if isinstance(X, np.ndarray):
        return d[:, None] * X
    return CSR(X.n, X.p, X.rows, X.cols, X.vals * d[X.rows])


def least_squares_update(gram: np.ndarray, xty: np.ndarray, n: float, v: np.ndarray, rho: float) -> np.ndarray:
    """(X^T X / n + rho I)^-1 (X^T b / n + rho v) from a cached Gram and X^T b."""
    p = xty.shape[0]
    H = gram / n
    H[np.diag_indices(p)] += rho
    return np.linalg.solve(H, xty / n + rho * v)


# ---------------------------------------------------------------- packed blocks
#
# A task stacks its rows by block into one record per block: labels, a dense row-major
# matrix or the rows' lengths, indices and values, each as one binary value.  Every pass
# then ships a handful of big buffers per block instead of one Arrow list entry per row,
# and numpy reads them without copying.

PACK_SCHEMA = "block_id int, n int, label binary, x binary, lens binary, idx binary, val binary"

#: bytes of a stored dense value, of a stored sparse value (index and value), and of a row's label and length
DENSE_BYTES, SPARSE_BYTES, ROW_BYTES = 8, 12, 12


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``values`` as one binary value per run; ``ends`` counts values."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    data = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _piece_ends(ids: np.ndarray, load: np.ndarray, unit: float) -> np.ndarray:
    """Ends of runs of rows of one block whose loads add up to less than ``unit`` plus one row's."""
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    before = np.cumsum(load) - load
    within = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(ids))))
    group = np.floor(within / unit)
    return np.append(np.flatnonzero((np.diff(group) != 0) | new[1:]) + 1, len(ids))


def pack_rows(table: pa.Table, kind: str, p: int, piece: tuple[int, int] | None = None) -> pa.RecordBatch:
    """One record per block of ``table``: rows are ordered by block once, then every
    column is cut at the block borders (no loop over rows or blocks).  ``piece`` (rows, bytes)
    cuts a block's rows further into records of about that many rows and bytes at most; a
    longer row is a record of its own."""
    ids = table.column("block_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    table, ids = table.take(pa.array(order)), ids[order]
    if piece is None:
        ends = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids))
    else:
        stored = np.full(len(ids), p * DENSE_BYTES) if kind == "dense" else \
            pc.list_value_length(table.column("indices")).to_numpy().astype(np.int64) * SPARSE_BYTES
        ends = _piece_ends(ids, np.maximum(1 / piece[0], (stored + ROW_BYTES) / piece[1]), 0.5)
    y = labels_of(table)
    empty = pa.array([b""] * len(ends), pa.binary())
    x = lens = idx = val = empty
    if kind == "dense":
        x = _cut(dense_block(table, "features", p).ravel(), ends * p)
    else:
        block = sparse_block(table, p)
        per_row = np.bincount(block.rows, minlength=block.n).astype(np.int32)
        stored = np.concatenate([[0], np.cumsum(per_row)])[ends]
        lens, idx, val = _cut(per_row, ends), _cut(block.cols.astype(np.int32), stored), _cut(block.vals, stored)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[ends - 1], pa.int32()), pa.array(np.diff(ends, prepend=0), pa.int32()), _cut(y, ends), x, lens, idx, val],
        names=["block_id", "n", "label", "x", "lens", "idx", "val"])


#: a task stacks about this many bytes of rows before it works on them
BUFFER_BYTES = 32 << 20


def buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to tables of about BUFFER_BYTES, so memory stays bounded."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > BUFFER_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def unpack_block(table: pa.Table, kind: str, p: int):
    """(X, y) of one block from its packed records: dense ndarray or CSR."""
    def joined(name, dtype):
        """The values of all records: they lie one after the other in a column's chunk, and one chunk is not copied."""
        column = table.column(name)
        parts = []
        for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
            _, offsets, data = chunk.buffers()
            if data is None or not len(chunk):
                continue
            at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(dtype))
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    y = joined("label", np.float64)
    if kind == "dense":
        return joined("x", np.float64).reshape(len(y), p), y
    lens = joined("lens", np.int32)
    rows = np.repeat(np.arange(len(y)), lens)
    if len(y) * p <= 2 * len(rows):  # narrow rows with half of their values stored take less room as a matrix
        X = np.zeros((len(y), p))
        X[rows, joined("idx", np.int32)] = joined("val", np.float64)
        return X, y
    return CSR(len(y), p, rows, joined("idx", np.int32).astype(np.int64), joined("val", np.float64)), y


#: products of sparse rows held at a time by ``gram_of``
GRAM_PRODUCTS = 1 << 22


def gram_of(X) -> np.ndarray:
    """X^T X as p x p, dense or from stored values only (never a dense n x p copy).

    Sparse rows are ordered by their number of stored values and taken in runs of equal
    length k: such a run is an m x k matrix of values, whose k * k products per row are
    added at once.  A row costs the square of its own stored values, whatever the others have."""
    if isinstance(X, np.ndarray):
        return X.T @ X
    G = np.zeros(X.p * X.p)
    lens = np.bincount(X.rows, minlength=X.n)
    start = np.concatenate([[0], np.cumsum(lens)])[:-1]
    for k in np.unique(lens[lens > 0]):
        rows = np.flatnonzero(lens == k)
        if k * k > GRAM_PRODUCTS:  # long rows: column by column of the row
            for r in rows:
                cols, vals = X.cols[start[r]:start[r] + k], X.vals[start[r]:start[r] + k]
                for c, v in zip(cols, vals):
                    np.add.at(G, c * X.p + cols, v * vals)
            continue
        many = max(1, GRAM_PRODUCTS // int(k * k))
        for lo in range(0, len(rows), many):
            at = start[rows[lo:lo + many]][:, None] + np.arange(k)
            cols, vals = X.cols[at], X.vals[at]
            G += np.bincount((cols[:, :, None] * X.p + cols[:, None, :]).ravel(),
                             weights=(vals[:, :, None] * vals[:, None, :]).ravel(), minlength=X.p * X.p)
    return G.reshape(X.p, X.p)


def least_squares_cg(X, b: np.ndarray, v: np.ndarray, rho: float, x0: np.ndarray, rows: int | None = None,
                     tol: float = 1e-12, max_iter: int = 1000) -> np.ndarray:
    """The least-squares x-update without a Gram: conjugate gradients on
    (X^T X / n + rho I) x = X^T b / n + rho v, warm-started.  n is ``rows``, the rows of the
    whole block when this is a part of one, else the rows given."""
    A = as_operator(X)
    n = max(rows or len(b), 1)
    rhs = A.rmatvec(b) / n + rho * v
    size = max(float(np.linalg.norm(rhs)), 1e-300)
    x, done = conjugate_gradients(lambda d: A.rmatvec(A.matvec(d)) / n + rho * d, rhs, x0, tol * size, max_iter)
    if not done:  # the residual that rounding leaves is fine, a larger one is not
        left = float(np.linalg.norm(rhs - A.rmatvec(A.matvec(x)) / n - rho * x))
        if left > 1e-8 * size:
            raise NotConverged(f"conjugate gradients left a residual of {left / size:.1e} after {max_iter} steps")
    return x
