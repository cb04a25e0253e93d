"""Event scans with path predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import nodes as n
from ..plans.errors import BadArgument
from ..sources.catalog import EventSource, millis


def json_path(path: tuple[str | int, ...]) -> str:
    for p in path:
        if isinstance(p, str) and "'" in p:
            raise BadArgument(f"a key with a quote can't be addressed: {p}")
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)


def test(source: EventSource, w) -> Column:
    """A predicate; a path that an event lacks, or of another type, meets no comparison."""
    if isinstance(w, n.Both):
        left, right = test(source, w.left), test(source, w.right)
        return left & right if w.op == "and" else left | right
    if isinstance(w, n.Not):
        return ~F.coalesce(test(source, w.of), F.lit(False))
    stored = len(w.path) == 1 and w.path[0] in source.columns
    if stored:  # a stored column is compared as it is, so the test can reach the scan
        found = F.col(source.columns[w.path[0]])
        text = dict(source.frame.dtypes)[source.columns[w.path[0]]] == "string"
        if isinstance(w.value, str) != text:
            found = found.cast("string") if isinstance(w.value, str) else found.try_cast("double")
    else:
        found = F.get_json_object(source.payload, json_path(w.path))
        if not isinstance(w.value, str):
            found = found.try_cast("double")
    if w.op == "~=":
        return found.rlike(w.value)
    value = F.lit(w.value)
    return {"==": found == value, ">=": found >= value, "=<": found <= value, ">": found > value, "<": found < value}[w.op]


def read(source: EventSource, where, start_ms: int, end_ms: int) -> DataFrame:
    """Events of [start, end): all stored columns and ``ts_ms``, each event once."""
    stamp = lambda ms: F.expr(f"timestampadd(MILLISECOND, {ms}L, timestamp_ntz'1970-01-01 00:00:00')")
    rows = source.frame.where((F.col(source.ts) >= stamp(start_ms)) & (F.col(source.ts) < stamp(end_ms)))
    if where is not None:
        rows = rows.where(test(source, where))
    return rows.withColumn("ts_ms", millis(source.ts))
