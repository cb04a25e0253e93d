"""From a bound plan to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import combine, events, ranking, scan, steps
from ..operators.frame import Frame, Histograms
from ..sources.catalog import Catalog
from . import nodes as n
from .binder import Combined, Grouped, Item, Leaf, Plan, Step, span_ms
from .errors import BadArgument, NoResults
from .unparse import quoted


@dataclass
class Lowering:
    catalog: Catalog
    plan: Plan
    check: bool = True
    block: int | None = None

    def frames(self, of, tags: frozenset[n.Tag] = frozenset(), name_tags: frozenset[n.Tag] = frozenset()) -> list:
        """``tags`` are read by a name or metadata; those of a name have to exist."""
        if isinstance(of, Leaf):
            return scan.read(self.catalog, of.of, self.plan.start_ms, self.plan.end_ms, of.shift, name_tags if isinstance(of.of, n.Lookup) else (), bool(tags), self.check, self.block)
        if isinstance(of, Grouped):
            found = scan.read(self.catalog, of.lookup, self.plan.start_ms, self.plan.end_ms, of.shift, of.tags, True, self.check, self.block)
            return [combine.grouped(of.using, found, of.tags)]
        if isinstance(of, Combined):
            return [combine.combine(of.function, [f for x in of.of for f in self.frames(x, tags, name_tags)])]
        return [self.step(of, f) for f in self.frames(of.of, tags, name_tags)]

    def step(self, of: Step, f: Frame | Histograms):
        kind, consts = of.function.kind, of.consts
        if kind == "agg":
            return steps.window(f, of.function, consts[:-1], span_ms(consts[-1]))
        if kind == "trans":
            return steps.transform(f, of.function, consts)
        if kind == "derivate":
            return steps.derivate(f)
        if kind == "hist":
            top, digits = of.function.build(*consts[:2])
            return steps.histogram(f, top, digits, span_ms(consts[2]))
        return steps.statistic(f, *of.function.build(*consts))

    def lowered(self) -> tuple[DataFrame | None, list[tuple[int, Item, DataFrame]]]:
        """All metric items as one frame, and each item of events."""
        parts, found = [], []
        for i, item in enumerate(self.plan.items):
            if isinstance(item.of, n.Events):
                found.append((i, item, events.read(self.catalog.event_source(item.of.bucket), item.of.where, self.plan.start_ms, self.plan.end_ms)))
            else:
                parts += [ranking.Part(i, f) for f in self.frames(item.of, frozenset(item.tags), frozenset(item.name_tags))]
        if not parts and not found:
            raise NoResults()
        kept = None
        if self.plan.rank and parts:
            kept, stay = ranking.ranked(parts, self.plan.rank, len(found))
            found = found if stay else []
            found = found[: self.plan.rank.count] if kept is not None else found
        rows = [self.rows(p, i, kept) for i, p in enumerate(parts)]
        return (reduce(DataFrame.unionByName, rows) if rows else None), found

    def rows(self, part: ranking.Part, number: int, kept: DataFrame | None) -> DataFrame:
        item, f = self.plan.items[part.item], part.frame
        points = f.points
        if kept is not None:
            points = points.join(F.broadcast(kept.where(F.col("part") == number).select("sid", "place")), "sid")
        else:
            points = points.withColumn("place", F.lit(None).cast("int"))
        if any(isinstance(p, (n.PathPart, n.Tag)) for p in (*item.name, *(v for _, v in item.metadata))):
            points = points.join(f.series.select("sid", name_of(item).alias("name"), metadata_of(item).alias("metadata")), "sid")
        else:
            points = points.withColumns({"name": name_of(item), "metadata": metadata_of(item)})
        return points.select(
            F.lit(part.item).alias("part_ord"), "place", "name", "metadata", scan.label().alias("series"), "off",
            (F.lit(f.start_ms) + F.col("off") * F.lit(f.rms)).alias("ts_ms"), "value", "confidence", F.lit(f.rms).cast("long").alias("resolution_ms"),
        )


def _filled_in(p) -> Column:
    if isinstance(p, n.PathPart):
        if p.number < 1:
            raise BadArgument("parts count from $1")
        return F.get("path", F.lit(p.number - 1))
    return scan.tag(p)


def name_of(item: Item) -> Column:
    """Quoted parts joined by dots, or the default name. A part that a series lacks is left out."""
    if not item.name:
        return F.lit(item.default)
    quote = lambda c: F.concat(F.lit("'"), F.regexp_replace(c, r"(['\\])", r"\\$1"), F.lit("'"))
    return F.concat_ws(".", *(F.lit(quoted(p)) if isinstance(p, str) else quote(_filled_in(p)) for p in item.name))


def metadata_of(item: Item) -> Column:
    """Values as text."""
    if not item.metadata:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*(x for k, v in item.metadata for x in (F.lit(k), F.lit(str(v)) if isinstance(v, (str, int, float)) else _filled_in(v))))
