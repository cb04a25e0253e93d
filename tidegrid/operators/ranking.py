"""TOP and BOTTOM: keep the series whose whole-series aggregate is largest or smallest."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.binder import Rank
from .frame import Frame


@dataclass(frozen=True)
class Part:
    """One frame of a SELECT item."""

    item: int
    frame: Frame


def ranked(parts: list[Part], rank: Rank, events: int) -> tuple[DataFrame | None, bool]:
    """((item, part, sid, place) of the kept series, whether events stay).

    Scores come from a hash aggregate and the kept ones from an ordered limit; only
    those meet the points again. Nothing is dropped, and no order changes, if there
    are no more series than asked for. Ties go by series, then item. Events in the
    same SELECT take slots first for TOP, and are cut for BOTTOM.
    """
    total = sum(p.frame.series.count() for p in parts)
    if total <= rank.count:
        return None, True
    score = rank.function.build(*rank.consts)
    scores = reduce(DataFrame.unionByName, [p.frame.points.groupBy("sid").agg(score.cast("double").alias("score")).select(F.lit(p.item).alias("item"), F.lit(i).alias("part"), "sid", "score") for i, p in enumerate(parts)])
    first = F.desc_nulls_last("score") if rank.kind == "top" else F.asc_nulls_last("score")
    room = max(0, rank.count - (events if rank.kind == "top" else 0))
    kept = scores.orderBy(first, "sid", "part").limit(room)
    place = F.row_number().over(Window.orderBy(first, "sid", "part"))
    return kept.select("item", "part", "sid", place.alias("place")), rank.kind == "top"
