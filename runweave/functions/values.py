"""Column functions with the IEEE rules that run-length vectors follow: no nulls, no errors, NaN is unordered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _double(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _negative_zero(y: Column) -> Column:
    return y.cast("string") == "-0.0"


def divide(x: Column | float, y: Column | float) -> Column:
    """x / y: a signed infinity over zero, NaN for 0 / 0 and wherever NaN takes part."""
    x, y = _double(x), _double(y)
    nan = F.isnan(x) | F.isnan(y)
    inf = F.when((x < 0) != _negative_zero(y), F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(nan, F.lit(NAN)).when(y != 0, F.try_divide(x, y)).when(x != 0, inf).otherwise(F.lit(NAN))


#: How each comparison reads the difference of its sides: infinite or NaN sides compare as their difference does.
COMPARISONS: dict[str, Callable[[Column], Column]] = {
    "eq": lambda d: (d == 0) & ~F.isnan(d),
    "ne": lambda d: (d != 0) | F.isnan(d),
    "ge": lambda d: (d >= 0) & ~F.isnan(d),
    "gt": lambda d: (d > 0) & ~F.isnan(d),
    "le": lambda d: (d <= 0) & ~F.isnan(d),
    "lt": lambda d: (d < 0) & ~F.isnan(d),
}


def indicator(name: str, x: Column | float, y: Column | float) -> Column:
    """1.0 where the comparison holds, else 0.0."""
    return F.when(COMPARISONS[name](_double(x) - _double(y)), F.lit(1.0)).otherwise(F.lit(0.0))


def log_like(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A logarithm with -inf at zero and NaN below it, where Spark gives null."""
    return lambda v: F.when(v == 0, F.lit(-INF)).when((v < 0) | F.isnan(v), F.lit(NAN)).otherwise(f(v))


#: Elementwise functions by name.
UNARY: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "absolute": F.abs, "floor": lambda v: F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(F.floor(v).cast("double")),
    "ceil": lambda v: F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(F.ceil(v).cast("double")), "rint": F.rint, "sign": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "degrees": F.degrees, "radians": F.radians,
    "exp2": lambda v: F.pow(F.lit(2.0), v), "reciprocal": lambda v: divide(1.0, v), "trunc": lambda v: F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(F.signum(v) * F.floor(F.abs(v)).cast("double")), "square": lambda v: v * v, "negative": lambda v: -v, "log": log_like(F.log), "log2": log_like(F.log2), "log10": log_like(F.log10), "log1p": lambda v: log_like(F.log)(v + 1.0), "isnan": lambda v: F.isnan(v).cast("double"),
}


def finite(v: Column, nan: float = 0.0, posinf: float = 2147483647.0, neginf: float = -2147483648.0) -> Column:
    return F.when(F.isnan(v), F.lit(float(nan))).when(v == INF, F.lit(float(posinf))).when(v == -INF, F.lit(float(neginf))).otherwise(v)


def natural_key(name: Column) -> Column:
    """Sorts digits by their number and other runs by their letters: chr2 before chr10."""
    pieces = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(pieces, lambda p: F.struct(F.when(p.rlike(r"^\d"), F.lit("")).otherwise(p).alias("text"), F.when(p.rlike(r"^\d"), p.try_cast("decimal(38,0)")).alias("number")))
