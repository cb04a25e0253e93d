"""Built-in functions."""

from . import aggregates, points
from .registry import Function, Registry


def builtin() -> Registry:
    return Registry([*aggregates.functions(), *points.functions(), *points.combiners(), *points.histogram_functions()])


__all__ = ["Function", "Registry", "builtin"]
