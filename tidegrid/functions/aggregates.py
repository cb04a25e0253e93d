"""Window aggregates: Column builders over value, confidence and off, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Function

V, C, OFF = "value", "confidence", "off"


#: Less than the distance from a rank to the next share k / n above it, for any window that fits a task.
_ABOVE = 1e-12


def picked(p: float) -> Column:
    """The value at rank floor(n * p) of the window's values in ascending order, the last at most.

    That is the first value whose share of the window is over p. Values are counted
    before the shuffle, so a window holds its distinct values only.
    """
    return F.expr(f"percentile_disc({min(1.0, float(p) + _ABOVE)!r}D) WITHIN GROUP (ORDER BY {V})")


def _plain(fn):
    return lambda *_: fn(V)


def _count(column: str, above: bool):
    return lambda c: F.count_if(F.col(column) > c if above else F.col(column) < c).cast("double")


def _edge(pick, column: str, above: bool):
    def build(c: float) -> Column:
        hit = F.col(column) > c if above else F.col(column) < c
        return pick(F.when(hit, F.col(V)), F.when(hit, F.col(OFF)))

    return build


def _percentile(p) -> Column:
    return picked(p)


def functions() -> list[Function]:
    out = []

    def add(name: str, consts: tuple[str, ...], build, text: str) -> None:
        out.append(Function(name, "agg", "metric", (*consts, "time"), "metric", build, help=text))

    for name, fn in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max), ("variance", F.var_pop), ("stddev", F.stddev_pop)):
        add(name, (), _plain(fn), f"{name} of each window")
    add("median", (), lambda: picked(0.5), "middle value of each window")
    for kind in ("float", "integer"):
        add("percentile", (kind,), _percentile, "value at a rank from 0 to 1 of each window")
        for suffix, column in (("", V), ("_conf", C)):
            for side in ("above", "below"):
                add(f"count_{side}{suffix}", (kind,), _count(column, side == "above"), f"points whose {column} is {side} a constant")
                add(f"first_{side}{suffix}", (kind,), _edge(F.min_by, column, side == "above"), f"first value whose {column} is {side} a constant")
                add(f"last_{side}{suffix}", (kind,), _edge(F.max_by, column, side == "above"), f"last value whose {column} is {side} a constant")
    return out
