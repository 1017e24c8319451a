"""Functions that queries may call; ``register`` adds more, Spark or pandas UDFs included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column, kind: str) -> Column:
    return F.sum(x.cast("long")) if kind == "int" else F.sum(x.cast("double"))


def _avg_trunc(x: Column, kind: str) -> Column:
    """Integer average cut off towards zero, as an engine with integer division gives it; the sum never overflows."""
    return _int_div(F.sum(x.cast("decimal(20,0)")), F.count(x))


def _int_div(a: Column, b: Column) -> Column:
    """Integral quotient, exact over all 64 bits."""
    return F.call_function("div", a, b)


#: name -> function of (column, kind of the column)
AGGREGATES: dict[str, Callable[[Column, str], Column]] = {
    "sum": _sum,
    "min": lambda x, kind: F.min(x),
    "max": lambda x, kind: F.max(x),
    "avg": lambda x, kind: F.avg(x.cast("double")),
    "avg_trunc": _avg_trunc,
    "count": lambda x, kind: F.count(x),
}
#: name -> (function of columns, function of the arguments' kinds giving the result's)
SCALARS: dict[str, tuple[Callable[..., Column], Callable[..., str]]] = {
    "nullif": (F.nullif, lambda *k: k[0]),
    "coalesce": (F.coalesce, lambda *k: k[0]),
    "abs": (F.abs, lambda *k: k[0]),
    "round": (lambda x, n=None: F.round(x, n if n is not None else F.lit(0)), lambda *k: k[0]),
    "lower": (F.lower, lambda *k: "str"),
    "upper": (F.upper, lambda *k: "str"),
    "length": (F.length, lambda *k: "int"),
    "regexp_like": (F.regexp_like, lambda *k: "bool"),
}


def register(name: str, function: Callable[..., Column], kind: str = "float", aggregate: bool = False) -> None:
    """Make a function callable in queries. Scalars take columns; aggregates take (column, kind)."""
    if aggregate:
        AGGREGATES[name.lower()] = function
    else:
        SCALARS[name.lower()] = (function, lambda *_: kind)
