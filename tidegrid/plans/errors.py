"""Query errors and their messages."""

from __future__ import annotations


class QueryError(Exception):
    """Base of all errors a query can raise."""


class SyntaxFault(QueryError):
    def __init__(self, line: int, what: str):
        super().__init__(f"line {line}: {what}")
        self.line = line


class UndefinedVariable(QueryError):
    def __init__(self, name: str):
        super().__init__(f"variable '{name}' is not defined")


class UnknownFunction(QueryError):
    def __init__(self, name: str, types: tuple[str, ...]):
        super().__init__(f"no function {name}({', '.join(types)})")
        self.name, self.types = name, types


class NoSeries(QueryError):
    def __init__(self, selector: str):
        super().__init__(f"no series matches {selector}")


class NoResults(QueryError):
    def __init__(self):
        super().__init__("the query has no results")


class ResolutionConflict(QueryError):
    def __init__(self, name: str, found: list[int]):
        super().__init__(f"{name} combines series of different resolutions: {', '.join(map(str, found))} ms")


class UnknownBucket(QueryError):
    def __init__(self, name: str):
        super().__init__(f"no bucket or collection '{name}'")


class QueryTimeout(QueryError):
    def __init__(self, seconds: float):
        super().__init__(f"the query took more than {seconds:g} s")


class BadArgument(QueryError):
    pass
