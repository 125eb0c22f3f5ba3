"""Element-wise arithmetic with array-library edge rules, as Column builders.

Division by zero gives infinities or NaN, never NULL or an error; integer
floor division and modulo by zero give 0; float modulo takes the divisor's
sign. All are plain expressions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _d(x) -> Column:
    return col(x).cast("double")


def true_divide(a, b) -> Column:
    a, b = _d(a), _d(b)
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


def _div(a: Column, b: Column) -> Column:
    """Integer quotient, rounded towards zero."""
    return F.call_function("div", a, b)


def floor_divide(a, b) -> Column:
    """Integers: rounds down, 0 where b is 0."""
    a, b = col(a), col(b)
    q, r = _div(a, F.when(b != 0, b)), a % F.when(b != 0, b)
    return F.when(b == 0, 0).when((r != 0) & ((r < 0) != (b < 0)), q - 1).otherwise(q)


def mod(a, b) -> Column:
    """Integers: the remainder has the divisor's sign; 0 where b is 0."""
    a, b = col(a), col(b)
    safe = F.when(b != 0, b)
    r = a % safe
    return F.when(b == 0, 0).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def float_floor_divide(a, b) -> Column:
    q = true_divide(a, b)
    return F.when(F.isnan(q) | (F.abs(q) == INF), q).otherwise(F.floor(q).cast("double"))


def float_mod(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when(b == 0, F.lit(NAN)).otherwise(a - F.floor(a / F.when(b != 0, b)) * b)


def fmod(a, b) -> Column:
    """The remainder has the dividend's sign; NaN where b is 0."""
    a, b = _d(a), _d(b)
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b))


def divmod_(a, b) -> tuple[Column, Column]:
    return floor_divide(a, b), mod(a, b)


def power(a, b) -> Column:
    return F.pow(_d(a), _d(b))


def integer_power(a, n: int) -> Column:
    """Wrapping integer power with a fixed exponent, by squaring."""
    if n < 0:
        raise ValueError("integers to negative powers are not integers")
    out, base = F.lit(1).cast("long"), col(a).cast("long")
    while n:
        if n & 1:
            out = out * base
        base, n = base * base, n >> 1
    return out


def square(a) -> Column:
    return col(a) * col(a)


def sqrt(a) -> Column:
    return F.sqrt(_d(a))


def _log(fn, x, edge: float = 0.0) -> Column:
    """SQL logarithms give NULL off their domain; here the edge is -inf and what lies below NaN."""
    x = _d(x)
    return F.when(x == edge, F.lit(-INF)).when(x < edge, F.lit(NAN)).otherwise(fn(F.when((x > edge) | F.isnan(x), x)))


def log(x) -> Column:
    return _log(F.ln, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def log1p(x) -> Column:
    return _log(F.log1p, x, -1.0)


def exp(x) -> Column:
    return F.exp(_d(x))


def expm1(x) -> Column:
    return F.expm1(_d(x))


def absolute(x) -> Column:
    return F.abs(col(x))


def fabs(x) -> Column:
    return F.abs(_d(x))


def sign(x) -> Column:
    return F.signum(_d(x))


def round_even(x, decimals: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(_d(x), decimals)


def floor(x) -> Column:
    return F.floor(_d(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(_d(x)).cast("double")


def trunc(x) -> Column:
    x = _d(x)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def isnan(x) -> Column:
    return F.isnan(_d(x))


def isinf(x) -> Column:
    return F.abs(_d(x)) == INF


def isfinite(x) -> Column:
    return ~isnan(x) & ~isinf(x)


sin, cos, tan = (lambda x, f=f: f(_d(x)) for f in (F.sin, F.cos, F.tan))
arcsin, arccos, arctan = (lambda x, f=f: f(_d(x)) for f in (F.asin, F.acos, F.atan))
sinh, cosh, tanh = (lambda x, f=f: f(_d(x)) for f in (F.sinh, F.cosh, F.tanh))
arcsinh, arccosh, arctanh = (lambda x, f=f: f(_d(x)) for f in (F.asinh, F.acosh, F.atanh))


def arctan2(y, x) -> Column:
    return F.atan2(_d(y), _d(x))


def rad2deg(x) -> Column:
    return F.degrees(_d(x))


def deg2rad(x) -> Column:
    return F.radians(_d(x))


def hypot(a, b) -> Column:
    return F.hypot(_d(a), _d(b))


def nextafter(x, up: bool = True) -> Column:
    """The next double above (or below)."""
    x = _d(x)
    ulp = F.when(x == 0, F.lit(5e-324)).otherwise(F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 52), F.lit(5e-324)))
    half = F.abs(x) == F.pow(F.lit(2.0), F.floor(F.log2(F.when(x != 0, F.abs(x)))))
    toward_zero = (x > 0) != F.lit(up)
    step = F.when(toward_zero & half & (x != 0), ulp / 2).otherwise(ulp)
    return x + step if up else x - step


def xlogy(x, y) -> Column:
    """x * log(y), 0 where x is 0 (unless y is NaN)."""
    return F.when((_d(x) == 0) & ~isnan(y), 0.0).otherwise(_d(x) * log(y))


def minimum(a, b) -> Column:
    """NaN wins."""
    a, b = _d(a), _d(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def maximum(a, b) -> Column:
    return F.greatest(_d(a), _d(b))


def clip(x, low=None, high=None) -> Column:
    out = col(x)
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    if high is not None:
        out = F.when(~F.isnan(out.cast("double")) & (out > high), high).otherwise(out)
    return out


def where(condition: Column, a, b) -> Column:
    return F.when(condition, col(a)).otherwise(col(b))


def putmask(x, mask: Column, values) -> Column:
    return F.when(mask, col(values)).otherwise(col(x))


def fill_nan(x, value) -> Column:
    x = col(x)
    return F.when(x.isNull() | F.isnan(x.cast("double")), value).otherwise(x)


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = _d(a), _d(b)
    near = (a == b) | (F.abs(a - b) <= atol + rtol * F.abs(b))
    return F.when(F.isnan(a) & F.isnan(b), F.lit(equal_nan)).when(F.isnan(a) | F.isnan(b), False).otherwise(near)


def cast(x, kind: str, errors: str = "strict") -> Column:
    """errors: 'strict' keeps SQL's NULL, 'return_validity' is ``cast(...).isNotNull()``, 'ignore' gives NaN or 0."""
    out = col(x).try_cast(kind)
    return F.coalesce(out, F.lit(NAN if kind in ("double", "float") else 0).cast(kind)) if errors == "ignore" else out
