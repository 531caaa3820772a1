"""Vector column expressions (dot, axpy, copy, scale, norms) on array columns.

A sparse vector is carried as three columns or struct fields: ``size int``,
``indices array<int>`` (0-based, ascending) and ``values array<double>``; a dense
vector is ``array<double>``.  Everything here is a built-in higher-order function,
so it stays inside whole-stage codegen: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(arr: ColumnOrName) -> Column:
    """Sum of a double array (0.0 for an empty array)."""
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def sq_norm(arr: ColumnOrName) -> Column:
    """Squared Euclidean norm of a dense vector."""
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda acc, v: acc + v * v)


def _size_check(n1: Column, n2: Column, value: Column, what: str) -> Column:
    return F.when(n1 == n2, value).otherwise(
        F.raise_error(F.concat(F.lit(f"{what}: vector sizes differ ("), n1.cast("string"), F.lit(" vs "), n2.cast("string"), F.lit(")")))
    )


def dense_dot(a: ColumnOrName, b: ColumnOrName, check: bool = True) -> Column:
    """dense · dense; a size mismatch raises."""
    a, b = _c(a), _c(b)
    value = array_sum(F.zip_with(a, b, lambda x, y: x * y))
    return _size_check(F.size(a), F.size(b), value, "dense_dot") if check else value


def sparse_dot(indices: ColumnOrName, values: ColumnOrName, dense: ColumnOrName) -> Column:
    """sparse · dense: sum over the non-zeros of v_k * w[idx_k]; touches non-zeros only."""
    w = _c(dense)
    return array_sum(F.zip_with(_c(indices), _c(values), lambda i, v: v * F.element_at(w, i + 1)))


def sparse_sparse_dot(indices1: ColumnOrName, values1: ColumnOrName, indices2: ColumnOrName, values2: ColumnOrName) -> Column:
    """sparse · sparse by index match (indices unique within each vector)."""
    lookup = F.map_from_arrays(_c(indices2), _c(values2))
    return array_sum(
        F.zip_with(_c(indices1), _c(values1), lambda i, v: v * F.coalesce(F.element_at(lookup, i), F.lit(0.0)))
    )


def vector_dot(size1: ColumnOrName, indices1: ColumnOrName | None, values1: ColumnOrName,
               size2: ColumnOrName, indices2: ColumnOrName | None, values2: ColumnOrName) -> Column:
    """Dot of any two vector kinds; ``indices=None`` marks a dense operand.  Sizes must agree."""
    if indices1 is None and indices2 is None:
        value = dense_dot(values1, values2, check=False)
    elif indices1 is None:
        value = sparse_dot(indices2, values2, values1)
    elif indices2 is None:
        value = sparse_dot(indices1, values1, values2)
    else:
        value = sparse_sparse_dot(indices1, values1, indices2, values2)
    return _size_check(_c(size1), _c(size2), value, "dot")


def axpy_sparse(a: ColumnOrName, indices: ColumnOrName, values: ColumnOrName, y: ColumnOrName) -> Column:
    """y + a*x for sparse x and dense y (per row): only the slots in ``indices`` change."""
    a = _c(a) if not isinstance(a, (int, float)) else F.lit(float(a))
    lookup = F.map_from_arrays(_c(indices), _c(values))
    return F.transform(_c(y), lambda yv, k: yv + a * F.coalesce(F.element_at(lookup, k), F.lit(0.0)))


def sparse_to_dense(size: ColumnOrName, indices: ColumnOrName, values: ColumnOrName) -> Column:
    """Copy a sparse vector into a dense array of length ``size``, zero-filling the gaps."""
    lookup = F.map_from_arrays(_c(indices), _c(values))
    return F.transform(
        F.array_repeat(F.lit(0.0), _c(size)),
        lambda zero, k: F.coalesce(F.element_at(lookup, k), zero),
    )


def scale(a: ColumnOrName | float, x: ColumnOrName) -> Column:
    """a * x for a dense vector."""
    a = F.lit(float(a)) if isinstance(a, (int, float)) else _c(a)
    return F.transform(_c(x), lambda v: a * v)


def zeros(p: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), p if isinstance(p, Column) else F.lit(int(p)))
