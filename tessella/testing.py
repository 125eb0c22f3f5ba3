"""Assertions on tables, for tests of code that uses the engine."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def _rows(df: DataFrame, digits: int) -> list:
    norm = lambda v: None if v is None else ("nan" if math.isnan(v) else float(f"{v:.{digits}g}") + 0.0) if isinstance(v, float) else v
    return sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def assert_frame_equal(a: DataFrame, b: DataFrame, digits: int = 9, check_types: bool = True) -> None:
    """Equal as multisets of rows, columns matched by name."""
    assert sorted(a.columns) == sorted(b.columns), (a.columns, b.columns)
    if check_types:
        assert sorted(a.dtypes) == sorted(b.dtypes), (a.dtypes, b.dtypes)
    left, right = _rows(a, digits), _rows(b, digits)
    assert len(left) == len(right), (len(left), len(right))
    for x, y in zip(left, right, strict=True):
        assert x == y, (x, y)


def assert_series_equal(a, b, **how) -> None:
    assert_frame_equal(a.df, b.df, **how)


def assert_almost_equal(a: float, b: float, rtol: float = 1e-5, atol: float = 1e-8) -> None:
    assert abs(a - b) <= atol + rtol * abs(b), (a, b)
