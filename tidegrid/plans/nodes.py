"""Syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Milliseconds of a time unit (fixed values).
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}

STAR = None  # a path part that matches any one part


@dataclass(frozen=True)
class Duration:
    count: int
    unit: str

    @property
    def ms(self) -> int:
        return self.count * UNITS[self.unit]


@dataclass(frozen=True)
class Tag:
    ns: str
    key: str


@dataclass(frozen=True)
class PathPart:
    """$N: part N (from 1) of a series' path."""

    number: int


@dataclass(frozen=True)
class TagTest:
    op: str  # = != exists
    tag: Tag
    value: str | None = None


@dataclass(frozen=True)
class Both:
    op: str  # and or
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class EventTest:
    op: str  # == >= =< > < ~=
    path: tuple[str | int, ...]
    value: object


@dataclass(frozen=True)
class Get:
    path: tuple[str | None, ...]
    bucket: str

    @property
    def glob(self) -> bool:
        return STAR in self.path


@dataclass(frozen=True)
class Lookup:
    collection: str
    path: tuple[str, ...] | None = None
    where: object = None


@dataclass(frozen=True)
class GroupBy:
    lookup: Lookup
    tags: tuple[Tag, ...]
    using: str


@dataclass(frozen=True)
class Shift:
    by: int | Duration
    of: object


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Events:
    bucket: str
    where: object = None


@dataclass(frozen=True)
class Named:
    of: object
    name: tuple | None = None
    metadata: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Ago:
    of: int | Duration


@dataclass(frozen=True)
class Date:
    text: str


NOW = "now"


@dataclass(frozen=True)
class Timeframe:
    kind: str  # last between after before
    args: tuple


@dataclass(frozen=True)
class Limit:
    kind: str  # top bottom
    count: int
    by: Call


@dataclass(frozen=True)
class Select:
    items: tuple
    timeframe: Timeframe
    aliases: tuple[tuple[str, object], ...] = field(default=())
    limit: Limit | None = None
