"""Per-point transforms, arithmetic with constants, and combiners of aligned series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import BadArgument
from .registry import Function


def _divided(c: float) -> Column:
    if not c:
        raise BadArgument("divide by 0")
    return F.col("value") / float(c)


def functions() -> list[Function]:
    value = lambda: F.col("value")
    out = [
        Function("abs", "trans", "metric", (), "metric", lambda: F.abs(value()), help="absolute value"),
        Function("sqrt_scale", "trans", "metric", (), "metric", lambda: F.signum(value()) * F.sqrt(F.abs(value())), help="square root, with the sign kept"),
        Function("log10_scale", "trans", "metric", (), "metric", lambda: F.when(value() == 0, 0.0).otherwise(F.signum(value()) * F.log10(F.when(value() != 0, F.abs(value())))), help="logarithm of the absolute value, with the sign kept; 0 stays"),
        Function("min", "trans", "metric", ("float",), "metric", lambda c: F.least(value(), F.lit(float(c))), help="the lesser of value and constant"),
        Function("max", "trans", "metric", ("float",), "metric", lambda c: F.greatest(value(), F.lit(float(c))), help="the greater of value and constant"),
        Function("confidence", "trans", "metric", (), "metric", lambda: F.col("confidence"), help="the confidence as a value"),
        Function("derivate", "derivate", "metric", (), "metric", lambda: None, help="difference to the point before; the first equals the second"),
    ]
    for kind in ("integer", "float"):
        out += [
            Function("add", "trans", "metric", (kind,), "metric", lambda c: value() + float(c), help="add a constant"),
            Function("sub", "trans", "metric", (kind,), "metric", lambda c: value() - float(c), help="subtract a constant"),
            Function("mul", "trans", "metric", (kind,), "metric", lambda c: value() * float(c), help="multiply by a constant"),
            Function("divide", "trans", "metric", (kind,), "metric", _divided, help="divide by a constant other than 0"),
        ]
    return out


def _no_zero(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(x)


def _first_and_rest(two, more) -> Column:
    """The first input, in input order, against the others, as a hash aggregate.

    ``two`` takes the first and the last of two inputs, ``more`` the first of several;
    there the others' sum or product is that of all less the first, so its last
    digits may differ from a step-by-step evaluation. A null input makes it null.
    """
    first, last, n = F.min_by("value", "ord"), F.max_by("value", "ord"), F.count("*")
    return F.when(F.count("value") < n, F.lit(None)).when(n == 1, first).when(n == 2, two(first, last)).otherwise(more(first))


def combiners() -> list[Function]:
    """Aggregates over the inputs of one offset; all combine before the shuffle.

    sum, avg, min, max and product skip null inputs (as ``first_above`` may give).
    """
    make = {
        "sum": lambda: F.sum("value"),
        "avg": lambda: F.avg("value"),
        "min": lambda: F.min("value"),
        "max": lambda: F.max("value"),
        "product": lambda: F.product("value"),
        "diff": lambda: _first_and_rest(lambda a, b: a - b, lambda a: a - (F.sum("value") - a)),
        "quotient": lambda: _first_and_rest(lambda a, b: a / _no_zero(b), lambda a: a * _no_zero(a) / F.product(_no_zero(F.col("value")))),
    }
    return [Function(name, "comb", "metric", (), "metric", build, many=True, help=f"{name} of series, point by point") for name, build in make.items()]


def histogram_functions() -> list[Function]:
    """Histogram of each window, and its statistics; the lowering is in operators.histogram."""
    out = [Function("histogram", "hist", "metric", ("integer", "integer", "time"), "histogram", lambda top, digits: (top, digits), help="histogram up to a highest value, with 1 to 5 significant digits")]
    out += [Function(name, "stat", "histogram", (), "metric", lambda name=name: (name, None), help=f"{name} of each histogram") for name in ("min", "max", "mean", "median", "stddev")]
    return [*out, Function("percentile", "stat", "histogram", ("float",), "metric", lambda p: ("percentile", p), help="value at a percentage from 0 to 100 of each histogram")]
