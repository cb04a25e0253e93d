"""Functions by name and argument types.

``kind`` says what a function does to series: ``agg`` makes one point of each window,
``trans`` maps points, ``comb`` makes one series of many, ``hist`` makes a histogram
of each window, ``stat`` reads one. ``data`` is the type of its series arguments;
``consts`` are the types of the constants that follow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..plans.errors import UnknownFunction


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    data: str
    consts: tuple[str, ...]
    returns: str
    build: Callable
    many: bool = False
    help: str = ""


class Registry:
    """Overloads by (name, types). User functions are added with ``add``."""

    def __init__(self, functions: list[Function] = ()):
        self._by: dict[tuple[str, tuple[str, ...], bool], Function] = {}
        for f in functions:
            self.add(f)

    def add(self, f: Function) -> None:
        self._by[f.name, (f.data, *f.consts), f.many] = f

    def find(self, name: str, types: tuple[str, ...]) -> Function:
        """The function of these argument types: a chain step first, else a combiner of one or more series."""
        if f := self._by.get((name, types, False)):
            return f
        if types and len(set(types)) == 1 and (f := self._by.get((name, types[:1], True))):
            return f
        raise UnknownFunction(name, types)

    def combiner(self, name: str) -> Function:
        """For GROUP BY … USING."""
        if f := self._by.get((name, ("metric",), True)):
            return f
        raise UnknownFunction(name, ("metric_list",))

    def __iter__(self):
        return iter(self._by.values())
