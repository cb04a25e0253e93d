"""Operators on small series with known answers, and rules that hold between queries."""

import math

import pytest
from pyspark.sql import functions as F

from tidegrid import Engine
from tidegrid.functions import Function, builtin
from tidegrid.plans.errors import BadArgument, NoSeries, QueryTimeout, ResolutionConflict, UnknownBucket
from tidegrid.sources.catalog import Bucket, Catalog, EventSource, open_store, tag_key, write_store

A = [3.0, None, 5.0, -2.0, None, None, 8.0, 1.0]
B = [0.0, 4.0, 2.0, 2.0, 10.0, 6.0, 0.0, 3.0]
T = "BETWEEN 1000 AND 9000"


def _bucket(spark, name, step, series):
    points = [(list(p), i, v) for p, values, _ in series for i, v in enumerate(values, 1) if v is not None]
    frame = spark.createDataFrame(points, "path array<string>, idx long, value double")
    listed = spark.createDataFrame([(list(p), {tag_key(ns, k): v for (ns, k), v in tags.items()}) for p, _, tags in series], "path array<string>, tags map<string,string>")
    return Bucket(name, step, lambda a, z: frame.where((F.col("idx") >= a // step) & (F.col("idx") < -(-z // step)))), listed, frame


@pytest.fixture(scope="module")
def catalog(spark):
    out = Catalog(spark)
    b, s, _ = _bucket(spark, "b", 1000, [(("x", "a"), A, {("", "dc"): "1", ("", "role"): "web"}), (("x", "b"), B, {("", "dc"): "1", ("k", "t"): "v"}), (("y",), B, {("", "dc"): "2", ("", "role"): "db"})])
    out.add_bucket(b, s, "c")
    b, s, _ = _bucket(spark, "slow", 2000, [(("x",), A, {})])
    out.add_bucket(b, s)
    events = spark.sql(
        """SELECT * FROM VALUES (1, timestamp_ntz'1970-01-01 00:00:01', '{"a":{"b":[1,2]},"n":5,"s":"ab"}'), (2, timestamp_ntz'1970-01-01 00:00:02', '{"n":"5","s":"b"}'),
        (3, timestamp_ntz'1970-01-01 00:00:08.5', NULL), (4, timestamp_ntz'1970-01-01 00:00:09', '{"n":7}') AS t(id, ts, body)"""
    )
    out.events["e"] = EventSource("e", events, "ts", "body", {"id": "id"})
    return out


def values(catalog, text, block=None, **more):
    rows = Engine(catalog, now_ms=9000, **more).prepare(text, block=block).metrics.orderBy("part_ord", "place", "series", "off").collect()
    out = {}
    for r in rows:
        out.setdefault((r.part_ord, r.series), []).append(r.value)
    return list(out.values())


def confidences(catalog, text):
    return [r.confidence for r in Engine(catalog, now_ms=9000).prepare(text).metrics.orderBy("off").collect()]


X, Y = "'x'.'a' BUCKET 'b'", "'y' BUCKET 'b'"
FILLED = [3.0, 3.0, 5.0, -2.0, -2.0, -2.0, 8.0, 1.0]


@pytest.mark.parametrize("block", [None, 3, 1])
def test_gaps_take_the_last_value(catalog, block):
    assert values(catalog, f"SELECT {X} {T}", block) == [FILLED]
    assert values(catalog, f"SELECT {X} BETWEEN 1 AND 4000", block) == [[0.0, 3.0, 3.0, 5.0]][:1]


def test_gap_confidence(catalog):
    assert confidences(catalog, f"SELECT {X} {T}") == [1, 0, 1, 1, 0, 0, 1, 1]
    assert confidences(catalog, f"SELECT avg({X}, 4 s) {T}") == [0.75, 0.5]


def test_series_without_points_is_all_gap(catalog):
    assert values(catalog, f"SELECT 'none' BUCKET 'b' {T}") == [[0.0] * 8]


@pytest.mark.parametrize(
    ("call", "wanted"),
    [
        ("sum({}, 3 s)", [11.0, -6.0, 9.0]),
        ("avg({}, 4 s)", [2.25, 1.25]),
        ("min({}, 4 s)", [-2.0, -2.0]),
        ("max({}, 4 s)", [5.0, 8.0]),
        ("median({}, 4 s)", [3.0, 1.0]),
        ("percentile({}, 0.9, 4 s)", [5.0, 8.0]),
        ("percentile({}, 1, 4 s)", [5.0, 8.0]),
        ("variance({}, 4 s)", [6.6875, 16.6875]),
        ("stddev({}, 4 s)", [math.sqrt(6.6875), math.sqrt(16.6875)]),
        ("count_above({}, 2.5, 4 s)", [3.0, 1.0]),
        ("count_below({}, 3, 4 s)", [1.0, 3.0]),
        ("first_above({}, 3, 4 s)", [5.0, 8.0]),
        ("first_below({}, 3, 4 s)", [-2.0, -2.0]),
        ("last_above({}, 0, 4 s)", [5.0, 1.0]),
        ("last_below({}, 100, 4 s)", [-2.0, 1.0]),
        ("first_above({}, 100, 4 s)", [None, None]),
        ("count_above_conf({}, 0.5, 4 s)", [3.0, 2.0]),
        ("count_below_conf({}, 0.5, 4 s)", [1.0, 2.0]),
        ("first_above_conf({}, 0.5, 4 s)", [3.0, 8.0]),
        ("first_below_conf({}, 0.5, 4 s)", [3.0, -2.0]),
        ("last_above_conf({}, 0.5, 4 s)", [-2.0, 1.0]),
        ("last_below_conf({}, 0.5, 4 s)", [3.0, -2.0]),
        ("derivate({})", [0.0, 0.0, 2.0, -7.0, 0.0, 0.0, 10.0, -7.0]),
        ("abs({})", [3, 3, 5, 2, 2, 2, 8, 1]),
        ("sqrt_scale({} - 1 + 5)", [math.copysign(math.sqrt(abs(v + 4)), v + 4) for v in FILLED]),
        ("log10_scale({} + 2)", [0.0 if v == -2 else math.log10(v + 2) for v in FILLED]),
        ("min({}, 2.0)", [2, 2, 2, -2, -2, -2, 2, 1]),
        ("max({}, 2.0)", [3, 3, 5, 2, 2, 2, 8, 2]),
        ("confidence({})", [1, 0, 1, 1, 0, 0, 1, 1]),
        ("mul({}, 2)", [2 * v for v in FILLED]),
        ("{} * 2", [2 * v for v in FILLED]),
        ("divide({}, 2)", [v / 2 for v in FILLED]),
        ("avg({}, 1500 ms)", FILLED),
    ],
)
def test_functions(catalog, call, wanted):
    got = values(catalog, f"SELECT {call.format(X)} {T}")[0]
    assert got == pytest.approx(wanted) if None not in wanted else got == wanted


def test_divide_by_zero_is_refused(catalog):
    with pytest.raises(BadArgument):
        values(catalog, f"SELECT divide({X}, 0) {T}")


@pytest.mark.parametrize(("op", "f"), [("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b), ("/", lambda a, b: a / (b or 1))])
def test_pairs(catalog, op, f):
    assert values(catalog, f"SELECT {X} {op} {Y} {T}") == [[f(a, b) for a, b in zip(FILLED, B)]]


def test_combiners_take_globs_and_keep_order(catalog):
    assert values(catalog, f"SELECT diff('x'.* BUCKET 'b', {Y}) {T}") == [[a - b - b for a, b in zip(FILLED, B)]]
    assert values(catalog, f"SELECT sum('x'.* BUCKET 'b') {T}") == [[a + b for a, b in zip(FILLED, B)]]
    assert values(catalog, f"SELECT max({X}) {T}") == [FILLED]


def test_resolution_conflict(catalog):
    with pytest.raises(ResolutionConflict, match="1000, 2000"):
        values(catalog, f"SELECT {X} + 'x' BUCKET 'slow' {T}")
    assert len(values(catalog, f"SELECT {X}, 'x' BUCKET 'slow' {T}")) == 2


def test_selectors(catalog):
    count = lambda s: len(values(catalog, f"SELECT {s} {T}"))
    assert count("'x'.* BUCKET 'b'") == 2 and count("* BUCKET 'b'") == 1 and count("*.'a' BUCKET 'b'") == 1
    assert count("ALL FROM 'c'") == 3 and count("'y' FROM 'c'") == 1
    assert count("ALL FROM 'c' WHERE 'dc' = '1'") == 2
    assert count("ALL FROM 'c' WHERE 'role' != 'web'") == 1  # the tag has to be there
    assert count("ALL FROM 'c' WHERE 'role'") == 2
    assert count("ALL FROM 'c' WHERE 'k':'t' = 'v'") == 1
    assert count("ALL FROM 'c' WHERE 'dc' = '2' OR 'role' AND 'dc' = '1'") == 1  # left to right
    with pytest.raises(NoSeries, match=r"'z'\.\*"):
        count("'z'.* BUCKET 'b'")
    with pytest.raises(UnknownBucket):
        count("'x' BUCKET 'nope'")


def test_groups(catalog):
    assert values(catalog, f"SELECT ALL FROM 'c' GROUP BY $dc USING sum {T}") == [[a + b for a, b in zip(FILLED, B)], B]
    rows = Engine(catalog).run(f"SELECT avg(ALL FROM 'c' GROUP BY $dc USING max, 8 s) AS 'g'.$dc {T}")[1]
    assert [r["name"] for r in rows] == ["'g'.'1'", "'g'.'2'"]


def test_shift_shows_at_the_start_of_the_query(catalog):
    prepared = Engine(catalog).prepare(f"SELECT {X} SHIFT BY 2 s BETWEEN 3000 AND 6000").metrics.orderBy("off").collect()
    assert [r.value for r in prepared] == FILLED[:3] and prepared[0].ts_ms == 3000


def test_identities(catalog):
    assert values(catalog, f"SELECT {X} - {X} {T}") == [[0.0] * 8]
    assert values(catalog, f"SELECT sum(sum({X}, 2 s), 4 s) {T}") == values(catalog, f"SELECT sum({X}, 4 s) {T}")


def test_long_series_take_the_other_derivate(catalog, monkeypatch):
    from tidegrid.operators import steps

    wanted = values(catalog, f"SELECT derivate({X}) {T}")
    monkeypatch.setattr(steps, "FILL_BLOCK", 2)
    assert values(catalog, f"SELECT derivate({X}) {T}", 2) == wanted


def test_histograms(catalog):
    h = f"histogram({Y}, 100, 2, 4 s)"
    got = lambda f: values(catalog, f"SELECT {f} {T}")[0]
    assert got(f"min({h})") == [0, 0] and got(f"max({h})") == [4, 10] and got(f"mean({h})") == [2, 4.75]
    assert got(f"median({h})") == [2, 3] and got(f"percentile({h}, 100.0)") == [4, 10]
    assert got(f"stddev({h})") == pytest.approx([math.sqrt(2), math.sqrt(((0 - 4.75) ** 2 + (3 - 4.75) ** 2 + (6 - 4.75) ** 2 + (10 - 4.75) ** 2) / 4)])
    assert len(got(f"max(histogram({Y}, 100, 2, 3 s))")) == 2  # no partial window
    assert got("max(histogram(mul('y' BUCKET 'b', 100), 1000, 1, 8 s))") == [1023]  # buckets of 32 or 64
    assert got(f"max(histogram({X}, 4, 2, 8 s))") == [3]  # -2, 5 and 8 are not recorded
    with pytest.raises(BadArgument):
        got(f"max(histogram({Y}, 100, 6, 1 s))")


def test_ranking(catalog):
    name = lambda s: [r.series for r in Engine(catalog).prepare(f"SELECT ALL FROM 'c' {T} {s}").metrics.where("off = 0").orderBy("place", "series").collect()]
    assert name("TOP 1 BY min()") == ["x.b"] and name("BOTTOM 1 BY min()") == ["x.a"]
    assert name("TOP 3 BY avg()") == ["x.a", "x.b", "y"]  # no more than asked for: no ranking
    assert set(name("TOP 2 BY avg()")) | set(name("BOTTOM 1 BY avg()")) == {"x.a", "x.b", "y"}
    assert name("TOP 2 BY percentile(0.9)") == ["x.b", "y"]


def test_events_and_ranking(catalog):
    run = lambda s: [r["type"] for r in Engine(catalog).run(f"SELECT ALL FROM 'c', EVENTS FROM 'e' {T} {s}")[1]]
    assert run("TOP 2 BY avg()") == ["events", "metrics"] and run("BOTTOM 2 BY avg()") == ["metrics", "metrics"]


@pytest.mark.parametrize(
    ("where", "ids"),
    [("", [1, 2, 3]), ("'n' == 5", [1, 2]), ("'n' > 5", []), ("'a'.'b'[1] == 2", [1]), ("'s' ~= 'b'", [1, 2]), ("'s' == 'b'", [2]), ("'s' != 'b'", [1, 3]), ("NOT 'n' >= 5", [3]), ("'id' =< 2 AND 's' ~= '^a' OR 'id' == 3", [1, 3])],
)
def test_events(catalog, where, ids):
    (_, _, rows), = Engine(catalog).prepare(f"SELECT EVENTS FROM 'e' {where and 'WHERE ' + where} {T}").events
    assert [r.id for r in rows.orderBy("ts_ms").collect()] == ids


def test_results_and_metadata(catalog):
    start, (one,) = Engine(catalog).run(f"SELECT {X} AS 'n'.$2.$dc METADATA {{'a': $1, 'b': 5, 'c': $dc}} BETWEEN 1500 AND 3500")
    assert start == 1500 and one["name"] == "'n'.'a'.'1'" and one["metadata"] == {"a": "x", "b": "5", "c": "1"} and one["data"] == [(3.0, 1.0), (3.0, 0.0)]


def test_slow_queries_are_logged_and_late_ones_end(catalog, spark, caplog):
    assert Engine(catalog, slow_s=0).run(f"SELECT {X} {T}", timeout_s=60)[1] and "slow query" in caplog.text

    def slow(start, end):
        return spark.range(1 << 40).selectExpr("array('x') AS path", "id % 8 AS idx", "rand() AS value").groupBy("path", "idx").agg(F.max("value").alias("value"))

    stuck = Catalog(spark)
    stuck.add_bucket(Bucket("s", 1000, slow), spark.sql("SELECT array('x') AS path, map('a', 'b') AS tags"))
    with pytest.raises(QueryTimeout):
        Engine(stuck).run(f"SELECT 'x' BUCKET 's' {T}", timeout_s=2)


@pytest.mark.parametrize("where, pushed", [("'type' = 'click'", "EqualTo(event_type,click)"), ("'type' = 'click' AND 'shard' = 's1'", "EqualTo(event_type,click)"), ("'type' != 'click'", "Not(EqualTo(event_type,click))")])
def test_tag_predicates_reach_the_scan_of_the_points(spark, sf_dir, where, pushed):
    from tidegrid.queries import _T
    from tidegrid.sources import tables

    plan = Engine(tables.catalog(spark, sf_dir)).prepare(f"SELECT ALL FROM 'shards' WHERE {where} {_T}", check=False).explain()
    points = [line for line in plan.splitlines() if "PushedFilters" in line and "ts" in line]  # only the points' scan is bounded in time
    assert points and all(pushed in line for line in points)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_slots_do_not_depend_on_the_zone(spark, zone):
    from tidegrid.sources.catalog import millis, slot

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-03-10 02:30:00", "2024-03-10 03:30:00", "1969-12-31 23:59:59.250", "2024-11-03 01:30:00.125"]
        frame = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("cast(t as timestamp_ntz) as ts")
        found = [tuple(r) for r in frame.select(millis("ts"), slot("ts", 3_600_000)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == [(1710037800000, 475010), (1710041400000, 475011), (-750, -1), (1730597400125, 480721)]


def test_no_lists_are_gathered(spark, sf_dir):
    """Percentiles and ordered combiners are aggregates that combine before the shuffle."""
    from tidegrid import queries

    for name in ("agg_percentile", "agg_median", "cb_product", "cb_diff", "cb_quotient", "top_percentile"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "collect_list" not in plan


def test_ordered_combiners_of_several_inputs(catalog):
    """Three inputs, and the same by hand."""
    one, two = values(catalog, f"SELECT {X} {T}")[0], values(catalog, f"SELECT {Y} {T}")[0]
    assert values(catalog, f"SELECT diff({X}, {Y}, {Y}) {T}")[0] == pytest.approx([a - 2 * b for a, b in zip(one, two)])
    quotient = [a / (b or 1) / (b or 1) for a, b in zip(one, two)]
    assert values(catalog, f"SELECT quotient({X}, {Y}, {Y}) {T}")[0] == pytest.approx(quotient)


def test_user_functions(catalog):
    own = builtin()
    own.add(Function("span", "agg", "metric", ("time",), "metric", lambda: F.max("value") - F.min("value")))
    assert values(catalog, f"SELECT span({X}, 4 s) {T}", functions=own) == [[7.0, 10.0]]


def test_store_round_trip(spark, tmp_path):
    _, series, points = _bucket(spark, "b", 1000, [(("x", "a"), A, {("", "dc"): "1"}), (("y",), B, {})])
    write_store(str(tmp_path), "b", 1000, "c", points, series)
    stored = open_store(spark, str(tmp_path))
    assert values(stored, f"SELECT {X} {T}") == [FILLED] and len(values(stored, f"SELECT ALL FROM 'c' WHERE 'dc' {T}")) == 1


def test_time_and_type_reach_the_scan(spark, sf_dir):
    from tidegrid.queries import _CLICK, _T
    from tidegrid.sources import tables

    plan = Engine(tables.catalog(spark, sf_dir)).prepare(f"SELECT avg({_CLICK}, 1 d) {_T}").explain()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "EqualTo(event_type,click)" in pushed and "ts" in pushed
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan
