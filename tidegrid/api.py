"""Entry points: prepare, run, explain."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .functions import Registry, builtin
from .plans.binder import Item, Plan, bind
from .plans.errors import NoResults, QueryTimeout
from .plans.lower import Lowering
from .plans.parser import parse
from .sources.catalog import Catalog


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Prepared:
    """A query as lazy DataFrames.

    ``metrics``: (part_ord, place, name, metadata, series, off, ts_ms, value,
    confidence, resolution_ms); place is the rank where TOP or BOTTOM cut.
    ``events``: (SELECT position, item, rows) of each item of events.
    """

    plan: Plan
    metrics: DataFrame | None
    events: list[tuple[int, Item, DataFrame]]

    @property
    def start_ms(self) -> int:
        return self.plan.start_ms

    def explain(self, mode: str = "formatted") -> str:
        frames = ([self.metrics] if self.metrics is not None else []) + [e for _, _, e in self.events]
        return "\n".join(f._sc._jvm.PythonSQLUtils.explainString(f._jdf.queryExecution(), mode) for f in frames)


class Engine:
    """Runs queries over a catalog. The clock and the functions can be replaced."""

    def __init__(self, catalog: Catalog, functions: Registry | None = None, now_ms: int | None = None, slow_s: float = 5.0):
        self.catalog, self.functions, self.now_ms, self.slow_s = catalog, functions or builtin(), now_ms, slow_s

    def prepare(self, text: str, check: bool = True, block: int | None = None) -> Prepared:
        """Parse, bind and lower. ``check`` looks up whether selectors match anything; ``block`` sets the length that one task fills."""
        plan = bind(parse(text), self.functions, int(time.time() * 1000) if self.now_ms is None else self.now_ms)
        metrics, events = Lowering(self.catalog, plan, check, block).lowered()
        return Prepared(plan, metrics, events)

    @contextmanager
    def _limited(self, text: str, timeout_s: float | None) -> Iterator[None]:
        """Cancels the query's jobs after ``timeout_s``, and logs queries that took ``slow_s`` or more."""
        context, group, late = self.catalog.spark.sparkContext, str(uuid.uuid4()), threading.Event()

        def cancel() -> None:
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(timeout_s, cancel) if timeout_s is not None else None
        began = time.monotonic()
        context.setJobGroup(group, text[:200], interruptOnCancel=True)
        try:
            if timer:
                timer.start()
            yield
        except Exception as failed:
            if late.is_set():
                raise QueryTimeout(timeout_s) from failed
            raise
        finally:
            if timer:
                timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
            if (taken := time.monotonic() - began) >= self.slow_s:
                log.warning("slow query, %.1f s: %s", taken, text)

    def run(self, text: str, timeout_s: float | None = None) -> tuple[int, list[dict]]:
        """(start in ms, results) with results in SELECT or rank order; meant for results that fit the driver."""
        with self._limited(text, timeout_s):
            return self._run(text)

    def _run(self, text: str) -> tuple[int, list[dict]]:
        got = self.prepare(text)
        out: list[tuple[tuple, dict]] = []
        by: dict[tuple, dict] = {}
        if got.metrics is not None:
            for r in got.metrics.orderBy("part_ord", "place", "series", "off").toLocalIterator():
                key = (r.part_ord, r.series, r.name)
                if key not in by:
                    by[key] = {"name": r.name, "type": "metrics", "resolution": r.resolution_ms, "metadata": r.metadata, "data": []}
                    out.append(((0 if r.place is None else r.place, r.part_ord), by[key]))
                by[key]["data"].append((r.value, r.confidence))
        for i, item, rows in got.events:
            data = [r.asDict(recursive=True) for r in rows.orderBy("ts_ms").toLocalIterator()]
            name = ".".join(item.name) or item.default
            out.append(((0, i), {"name": name, "type": "events", "resolution": 1.0e-6, "metadata": {k: str(v) for k, v in item.metadata}, "data": data}))
        if not out:
            raise NoResults()
        return got.start_ms, [r for _, r in sorted(out, key=lambda x: x[0])]


def error_string(error: Exception) -> str:
    """Message of a failed query for people."""
    return str(error)
