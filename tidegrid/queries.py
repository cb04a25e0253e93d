"""Registered queries over the benchmark tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .sources import tables

#: Ranges of the buckets (ms), and the clock of queries relative to now.
EVENTS = (1704067200000, 1706659200000)
SALES = (788918400000, 1004918400000)
NOW_MS = EVENTS[1]
_T = f"BETWEEN {EVENTS[0]} AND {EVENTS[1]}"
_S = f"BETWEEN {SALES[0]} AND {SALES[1]}"
_CLICK = "'click' BUCKET 'events'"
_VIEW = "'view' BUCKET 'events'"
_SHARDS = "'click'.* BUCKET 'shards'"


def _metrics(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Engine(tables.catalog(spark, sf_dir), now_ms=NOW_MS).prepare(text, check=False).metrics
        flat = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
        return rows.select("part_ord", "name", "series", flat.alias("metadata"), "off", "ts_ms", (F.round("value", 6) + 0.0).alias("value"), (F.round("confidence", 6) + 0.0).alias("confidence"), "resolution_ms")

    return run


def _events(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (_, _, rows), = Engine(tables.catalog(spark, sf_dir), now_ms=NOW_MS).prepare(text, check=False).events
        return rows.select("event_id", "ts_ms", "user_id", "event_type", "value", "props")

    return run


# --- SQL --------------------------------------------------------------------------


def _dense(bucket: str, lo: int, hi: int, where: str = "true", name: str = "dense") -> str:
    """Common tables: the series of a bucket with gaps filled, as (series, tags..., off, value, confidence)."""
    source = {
        "events": ("event_type AS series, event_type AS type, '' AS shard", "ts", 3600000, "arg_max(value, event_id)", "events"),
        "shards": ("event_type || '.s' || (user_id % 4) AS series, event_type AS type, 's' || (user_id % 4) AS shard", "ts", 3600000, "arg_max(value, event_id)", "events"),
        "sales": ("'sales.' || l_returnflag || '.' || l_linestatus AS series, l_returnflag AS type, l_linestatus AS shard", "l_shipdate", 86400000, "sum(l_quantity)", "lineitem"),
    }[bucket]
    keys, ts, rms, value, table = source
    a, z = lo // rms, hi // rms
    return f"""{name}_raw AS (SELECT {keys}, epoch_us({ts}) // {rms * 1000} - {a} AS off, {value} AS v FROM {table} GROUP BY ALL),
{name}_series AS (SELECT DISTINCT series, type, shard FROM {name}_raw WHERE {where}),
{name}_grid AS (SELECT s.series, s.type, s.shard, g.off, r.v FROM {name}_series s CROSS JOIN (SELECT unnest(range(0, {z - a})) AS off) g LEFT JOIN {name}_raw r ON r.series = s.series AND r.off = g.off),
{name} AS (SELECT series, type, shard, off, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS value, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM {name}_grid)"""


def _out(body: str, name: str, start: int, rms: int, part: int = 0, metadata: str = "''", series: str = "series") -> str:
    return f"SELECT {part}::INT AS part_ord, {name} AS name, {series} AS series, {metadata} AS metadata, off::BIGINT AS off, ({start} + off * {rms})::BIGINT AS ts_ms, round(value::DOUBLE, 6) + 0.0 AS value, round(confidence::DOUBLE, 6) + 0.0 AS confidence, {rms}::BIGINT AS resolution_ms FROM ({body}) q"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


HOUR, DAY = 3600000, 86400000
_IS_CLICK = "type = 'click'"


def _one(where: str, body: str, name: str, rms: int = HOUR, bucket: str = "events", span: tuple[int, int] = EVENTS, **more) -> str:
    return f"WITH {_dense(bucket, *span, where)}\n{_out(body, _text(name) if not name.startswith('=') else name[1:], span[0], rms, **more)}"


def _windowed(value: str, count: int = 24) -> str:
    """A window aggregate; a null value has confidence 0."""
    return f"SELECT series, off, value, CASE WHEN value IS NULL THEN 0.0 ELSE confidence END AS confidence FROM (SELECT series, off // {count} AS off, {value} AS value, avg(confidence) AS confidence FROM dense GROUP BY 1, 2)"


def _rank(p: float) -> str:
    return f"list_sort(list(value))[least(floor(count(*) * {p})::BIGINT, count(*) - 1) + 1]"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(key: str, text: str, sql: str) -> None:
    QUERIES[key] = _metrics(text)
    ORACLE_SQL[key] = sql


def _register() -> None:
    plain = "SELECT series, off, value, confidence FROM dense"
    _add("get_raw", f"SELECT {_CLICK} {_T}", _one(_IS_CLICK, plain, _CLICK))
    _add("glob", f"SELECT {_SHARDS} {_T}", _one(_IS_CLICK, plain, _SHARDS, bucket="shards"))
    for key, selector, where in (
        ("lookup_all", "ALL FROM 'shards'", "true"),
        ("lookup_metric", "'click'.'s0' FROM 'shards'", "series = 'click.s0'"),
        ("where_eq", "ALL FROM 'shards' WHERE 'type' = 'click'", "type = 'click'"),
        ("where_ne", "ALL FROM 'shards' WHERE 'type' != 'click'", "type <> 'click'"),
        ("where_not", "ALL FROM 'shards' WHERE 'type' NOT 'click'", "type <> 'click'"),
        ("where_exists", "ALL FROM 'shards' WHERE 'shard'", "shard IS NOT NULL"),
        ("where_and", "ALL FROM 'shards' WHERE 'type' = 'click' AND 'shard' != 's1'", "type = 'click' AND shard <> 's1'"),
        ("where_or", "ALL FROM 'shards' WHERE 'type' = 'click' OR 'shard' = 's1'", "type = 'click' OR shard = 's1'"),
    ):
        _add(key, f"SELECT {selector} {_T}", _one(where, plain, selector.replace(" NOT ", " != "), bucket="shards"))

    def agg(key: str, call: str, value: str, name: str, span: str = "1 d", count: int = 24) -> None:
        _add(key, f"SELECT {call} {_T}".replace("@", span), _one(_IS_CLICK, _windowed(value, count), name, HOUR * count, bucket="shards"))

    for f, sql in (("sum", "sum(value)"), ("avg", "avg(value)"), ("min", "min(value)"), ("max", "max(value)"), ("median", _rank(0.5)), ("variance", "var_pop(value)"), ("stddev", "stddev_pop(value)")):
        agg(f"agg_{f}", f"{f}({_SHARDS}, @)", sql, f"{f}({_SHARDS})")
    agg("agg_percentile", f"percentile({_SHARDS}, 0.9, @)", _rank(0.9), f"percentile({_SHARDS})")
    agg("agg_percentile_int", f"percentile({_SHARDS}, 1, @)", _rank(1.0), f"percentile({_SHARDS})")
    for suffix, column, c in (("", "value", "50.0"), ("_conf", "confidence", "0.5")):
        for side, op in (("above", ">"), ("below", "<")):
            hit = f"{column} {op} {c}"
            agg(f"agg_count_{side}{suffix}", f"count_{side}{suffix}({_SHARDS}, {c}, @)", f"(count(*) FILTER ({hit}))::DOUBLE", f"count_{side}{suffix}({_SHARDS})")
            agg(f"agg_first_{side}{suffix}", f"first_{side}{suffix}({_SHARDS}, {c}, @)", f"arg_min(value, off) FILTER ({hit})", f"first_{side}{suffix}({_SHARDS})")
            agg(f"agg_last_{side}{suffix}", f"last_{side}{suffix}({_SHARDS}, {c}, @)", f"arg_max(value, off) FILTER ({hit})", f"last_{side}{suffix}({_SHARDS})")
    agg("agg_count_above_int", f"count_above({_SHARDS}, 50, @)", "(count(*) FILTER (value > 50))::DOUBLE", f"count_above({_SHARDS})")
    agg("agg_truncated", f"avg({_SHARDS}, 90 m)", "avg(value)", f"avg({_SHARDS})", count=1)
    agg("agg_partial", f"sum({_SHARDS}, 7 h)", "sum(value)", f"sum({_SHARDS})", count=7)
    nested = "SELECT series, off // 4 AS off, avg(value) AS value, avg(confidence) AS confidence FROM (SELECT series, off // 6 AS off, sum(value) AS value, avg(confidence) AS confidence FROM dense GROUP BY 1, 2) GROUP BY 1, 2"
    _add("agg_nested", f"SELECT avg(sum({_SHARDS}, 6 h), 1 d) {_T}", _one(_IS_CLICK, nested, f"avg(sum({_SHARDS}))", DAY, bucket="shards"))

    def point(key: str, call: str, value: str, name: str) -> None:
        _add(key, f"SELECT {call} {_T}", _one(_IS_CLICK, f"SELECT series, off, {value} AS value, confidence FROM dense", name))

    w = "OVER (PARTITION BY series ORDER BY off)"
    point("tr_derivate", f"derivate({_CLICK})", f"coalesce(value - lag(value) {w}, lead(value) {w} - value)", f"derivate({_CLICK})")
    point("tr_abs", f"abs({_CLICK} - 60)", "abs(value - 60)", f"abs(sub({_CLICK}))")
    point("tr_sqrt_scale", f"sqrt_scale({_CLICK} - 60)", "sign(value - 60) * sqrt(abs(value - 60))", f"sqrt_scale(sub({_CLICK}))")
    point("tr_log10_scale", f"log10_scale({_CLICK} - 60)", "CASE WHEN value = 60 THEN 0.0 ELSE sign(value - 60) * log10(abs(value - 60)) END", f"log10_scale(sub({_CLICK}))")
    point("tr_confidence", f"confidence({_CLICK})", "confidence", f"confidence({_CLICK})")
    point("tr_min", f"min({_CLICK}, 50.0)", "least(value, 50.0)", f"min({_CLICK})")
    point("tr_max", f"max({_CLICK}, 50.0)", "greatest(value, 50.0)", f"max({_CLICK})")
    point("ar_add", f"add({_CLICK}, 5)", "value + 5", f"add({_CLICK})")
    point("ar_sub", f"sub({_CLICK}, 2.5)", "value - 2.5::DOUBLE", f"sub({_CLICK})")
    point("ar_mul", f"mul({_CLICK}, 3)", "value * 3", f"mul({_CLICK})")
    point("ar_divide", f"divide({_CLICK}, 4)", "value / 4", f"divide({_CLICK})")
    point("ar_add_infix", f"{_CLICK} + 5", "value + 5", f"add({_CLICK})")
    point("ar_sub_infix", f"{_CLICK} - 5 - 2", "value - 5 - 2", f"sub(sub({_CLICK}))")

    for f, sql in (("sum", "sum(value)"), ("avg", "avg(value)"), ("min", "min(value)"), ("max", "max(value)"), ("product", "list_reduce(list(value ORDER BY series), lambda a, b: a * b)")):
        _add(f"cb_{f}", f"SELECT {f}({_SHARDS}) {_T}", _one(_IS_CLICK, f"SELECT off, {sql} AS value, avg(confidence) AS confidence FROM dense GROUP BY off", f"{f}({_SHARDS})", bucket="shards", series="''"))

    def pair(key: str, text: str, value: str, name: str, lo: int = 0, other: str = "view") -> None:
        body = f"SELECT a.off, {value} AS value, (a.confidence + b.confidence) / 2 AS confidence FROM dense a JOIN other b ON a.off = b.off"
        ctes = f"{_dense('events', *EVENTS, _IS_CLICK)},\n{_dense('events', EVENTS[0] - lo, EVENTS[1] - lo, f'type = {_text(other)}', 'other')}"
        _add(key, text, f"WITH {ctes}\n{_out(body, _text(name), EVENTS[0], HOUR, series=_text(''))}")

    v = "'view' BUCKET 'events'"
    pair("cb_diff", f"SELECT {_CLICK} - {_VIEW} {_T}", "a.value - b.value", f"diff({_CLICK}, {v})")
    pair("cb_quotient", f"SELECT {_CLICK} / {_VIEW} {_T}", "a.value / CASE WHEN b.value = 0 THEN 1 ELSE b.value END", f"quotient({_CLICK}, {v})")
    pair("cb_sum_infix", f"SELECT {_CLICK} + {_VIEW} {_T}", "a.value + b.value", f"sum({_CLICK}, {v})")
    pair("cb_product_infix", f"SELECT {_CLICK} * {_VIEW} {_T}", "a.value * b.value", f"product({_CLICK}, {v})")
    pair("shift_diff", f"SELECT {_CLICK} - {_CLICK} SHIFT BY 1 d {_T}", "a.value - b.value", f"diff({_CLICK}, {_CLICK} SHIFT BY 1 d)", DAY, "click")
    _add("shift", f"SELECT {_CLICK} SHIFT BY 1 d {_T}", f"WITH {_dense('events', EVENTS[0] - DAY, EVENTS[1] - DAY, _IS_CLICK)}\n{_out(plain, _text(f'{_CLICK} SHIFT BY 1 d'), EVENTS[0], HOUR)}")

    for key, f, tags, group in (("group_by_sum", "sum", "$'type'", "type"), ("group_by_avg", "avg", "$'type'", "type"), ("group_by_two", "max", "$'shard', $'type'", "shard || '.' || type")):
        name = "=" + ("'''' || series || ''''" if "," not in tags else "'''' || replace(series, '.', '''.''') || ''''")
        shown = "$'type'" if "," not in tags else "$'shard'.$'type'"
        _add(key, f"SELECT ALL FROM 'shards' GROUP BY {tags} USING {f} AS {shown} {_T}", _one("true", f"SELECT {group} AS series, off, {f}(value) AS value, avg(confidence) AS confidence FROM dense GROUP BY 1, 2", name, bucket="shards"))
    week = "SELECT series, off // 7 AS off, sum(value) AS value, avg(confidence) AS confidence FROM (SELECT type AS series, off, sum(value) AS value, avg(confidence) AS confidence FROM dense GROUP BY 1, 2) GROUP BY 1, 2"
    _add("sales_group", f"SELECT sum(ALL FROM 'sales' GROUP BY $'flag' USING sum, 1 w) AS $'flag' {_S}", f"WITH {_dense('sales', *SALES)}\n{_out(week, _quote_series(), SALES[0], 7 * DAY)}")

    cells = """cells AS (SELECT series, off // 24 AS off, (v // unit) * unit AS lo, unit, count(*) AS cnt FROM (SELECT series, off, v, (2 ** greatest(0, length(bin(v)) - 1 - 7))::BIGINT AS unit FROM (SELECT series, off, round(value)::BIGINT AS v FROM dense) WHERE v BETWEEN 0 AND 1000) GROUP BY ALL)"""
    mid, running = "(lo + unit // 2)", "running AS (SELECT *, sum(cnt) OVER (PARTITION BY series, off ORDER BY lo) AS run, sum(cnt) OVER (PARTITION BY series, off) AS n FROM cells)"
    mean = f"sum(cnt * {mid}) / sum(cnt)::DOUBLE"
    square = f"sum(cnt * {mid} * {mid}) / sum(cnt)::DOUBLE"
    at = lambda p: f"min(lo + unit - 1) FILTER (run >= greatest(1, floor(n * {p} + 0.5)))"
    for f, call, value, table in (("min", "min(@)", "min(lo)", "cells"), ("max", "max(@)", "max(lo + unit - 1)", "cells"), ("mean", "mean(@)", mean, "cells"), ("stddev", "stddev(@)", f"sqrt(greatest(0.0, {square} - ({mean}) * ({mean})))", "cells"), ("median", "median(@)", at(0.5), "running"), ("percentile", "percentile(@, 90.0)", at(0.9), "running")):
        body = f"SELECT series, off, {value} AS value, 1.0 AS confidence FROM {table} GROUP BY 1, 2"
        call = call.replace("@", f"histogram({_CLICK}, 1000, 2, 1 d)")
        _add(f"hist_{f}", f"SELECT {call} {_T}", f"WITH {_dense('events', *EVENTS, _IS_CLICK)},\n{cells},\n{running}\n{_out(body, _text(f'{f}(histogram({_CLICK}))'), EVENTS[0], DAY)}")

    for key, rank, score, order in (("top_avg", "TOP 2 BY avg()", "avg(value)", "DESC"), ("bottom_avg", "BOTTOM 2 BY avg()", "avg(value)", "ASC"), ("top_percentile", "TOP 3 BY percentile(0.9)", _rank(0.9), "DESC"), ("top_all", "TOP 9 BY max()", "max(value)", "DESC")):
        many = rank.split()[1]
        body = f"SELECT d.series, d.off, d.value, d.confidence FROM dense d JOIN (SELECT series FROM (SELECT series, {score} AS score FROM dense GROUP BY 1) ORDER BY score {order}, series LIMIT {many}) USING (series)"
        _add(key, f"SELECT {_SHARDS} {_T} {rank}", _one(_IS_CLICK, body, _SHARDS, bucket="shards"))

    _add("alias", f"SELECT avg(c, 1 d) ALIAS {_CLICK} AS c {_T}", _one(_IS_CLICK, _windowed("avg(value)"), f"avg({_CLICK})", DAY))
    _add("as_name", f"SELECT avg({_SHARDS}, 1 d) AS 'n'.$1.$2 {_T}", _one(_IS_CLICK, _windowed("avg(value)"), "=" + "'''n''.''' || replace(series, '.', '''.''') || ''''", DAY, bucket="shards"))
    _add("metadata", f"SELECT avg(c, 1 d) AS 'n'.$1 METADATA {{'k': 'v', 'p': $1, 'x': 5}} ALIAS {_CLICK} AS c {_T}", _one(_IS_CLICK, _windowed("avg(value)"), "'n'.'click'", DAY, metadata="'k=v,p=click,x=5'"))
    two = f"WITH {_dense('events', *EVENTS, _IS_CLICK)}\n{_out(plain, _text(_CLICK), EVENTS[0], HOUR)}\nUNION ALL {_out(_windowed('max(value)'), _text(f'max({_CLICK})'), EVENTS[0], DAY, part=1)}"
    _add("select_list", f"SELECT {_CLICK}, max({_CLICK}, 1 d) {_T}", two)

    for key, frame, lo, hi in (
        ("tf_last", "LAST 7 d", NOW_MS - 7 * DAY, NOW_MS),
        ("tf_after", f"AFTER {EVENTS[0]} FOR 3 d", EVENTS[0], EVENTS[0] + 3 * DAY),
        ("tf_before", f"BEFORE {EVENTS[1]} FOR 3 d", EVENTS[1] - 3 * DAY, EVENTS[1]),
        ("tf_ago", "BETWEEN 5 d AGO AND NOW", NOW_MS - 5 * DAY, NOW_MS),
        ("tf_swapped", f"BETWEEN {EVENTS[1]} AND {EVENTS[0]}", *EVENTS),
        ("tf_date", 'BETWEEN "2024-01-02 00:00:00" AND "2024-01-05 00:00:00"', 1704153600000, 1704412800000),
    ):
        ctes = _dense("events", lo, hi, _IS_CLICK).replace("FROM events GROUP BY ALL", f"FROM events WHERE epoch_us(ts) >= {lo}000 AND epoch_us(ts) < {hi}000 GROUP BY ALL")
        ctes = ctes.replace("SELECT DISTINCT series, type, shard FROM dense_raw", "SELECT 'click' AS series, 'click' AS type, '' AS shard")
        ctes = ctes.replace("WHERE type = 'click'),", "),")
        _add(key, f"SELECT {_CLICK} {frame}", f"WITH {ctes}\n{_out(plain, _text(_CLICK), lo, HOUR)}")

    ranged = f"epoch_us(ts) >= {EVENTS[0]}000 AND epoch_us(ts) < {EVENTS[1]}000"
    k = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    for key, where, sql in (
        ("ev_all", "", "true"),
        ("ev_cmp", "WHERE 'k' >= 50 AND 'value' < 80.5", f"{k} >= 50 AND value < 80.5"),
        ("ev_eq", "WHERE 'event_type' == 'click' AND 'k' =< 10", f"event_type = 'click' AND {k} <= 10"),
        ("ev_ne", "WHERE 'event_type' != 'click'", "event_type <> 'click'"),
        ("ev_regex", "WHERE 'k' >= 50 AND 'event_type' ~= '^c'", f"{k} >= 50 AND regexp_matches(event_type, '^c')"),
        ("ev_not", "WHERE NOT 'k' > 50", f"NOT coalesce({k} > 50, false)"),
        ("ev_or", "WHERE ('k' < 10 OR 'user_id' > 50) AND 'event_type' == 'view'", f"({k} < 10 OR user_id > 50) AND event_type = 'view'"),
    ):
        QUERIES[key] = _events(f"SELECT EVENTS FROM 'events' {where} {_T}")
        ORACLE_SQL[key] = f"SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ts_ms, user_id, event_type, value, props FROM events WHERE {ranged} AND ({sql})"


def _quote_series() -> str:
    return "'''' || series || ''''"


_register()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean of one series."""
    return _metrics(f"SELECT avg({_CLICK}, 1 d) {_T}")(spark, sf_dir)
