"""Input views derived from the given tables, each with its SQL twin (see FIXTURES.md).

Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions import time as tm
from flowspark.functions.geo import GridSpec, cell_id
from flowspark.functions.num import rnd
from flowspark.plans.oracle import cte
from flowspark.plans.oracle import rnd as _rnd
from flowspark.session import cut_lineage, fresh_dir
from flowspark.sources.tables import Tables, read_dates, view

GRID = GridSpec("bj", 116.25, 116.75, 39.75, 40.25, 8, 8, 8)
TZ = GRID.tz_hours
N_CELLS = GRID.n_cells
KEYS = ["city", "grid_id"]
TRAIN_SHARE = 0.7

IN_TYPES = ["view", "click", "purchase"]
OUT_TYPES = ["signup", "error"]


def _amount(types: list[str]) -> Column:
    return F.when(F.col("event_type").isin(types), F.col("value")).otherwise(F.lit(0.0))


@view
def flow_events(t: Tables) -> DataFrame:
    return t.events.select(
        F.lit(GRID.city).alias("city"),
        (F.col("user_id") % N_CELLS).alias("grid_id"),
        tm.step_of(F.col("ts")).alias("step"),
        _amount(IN_TYPES).alias("inflow"),
        _amount(OUT_TYPES).alias("outflow"),
    )


def _sum_flow(df: DataFrame) -> DataFrame:
    return df.groupBy("city", "grid_id", "step").agg(
        F.round(F.sum("inflow"), 2).alias("inflow"), F.round(F.sum("outflow"), 2).alias("outflow")
    )


@view
def flow_sparse(t: Tables) -> DataFrame:
    """One row per (cell, step) that has an event. Written once: the only pass over the events
    that the flow, its calendar, split and baseline need."""
    return cut_lineage(_sum_flow(flow_events(t)))


def full_days(ev: DataFrame) -> DataFrame:
    """One row per city: first and last step of the whole days that the events span."""
    day = tm.SLOTS_PER_DAY
    return ev.groupBy("city").agg(
        (F.floor(F.min("step") / day) * day).alias("lo"),
        (F.floor(F.max("step") / day) * day + (day - 1)).alias("hi"),
    )


def dense_calendar(ev: DataFrame, n_cells: int) -> DataFrame:
    """(city, grid_id, step) for every cell and step, generated cell by cell in parallel."""
    cells = full_days(ev).withColumn(
        "grid_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cells - 1).cast("long")))
    )
    return cells.repartition("grid_id").select(
        "city", "grid_id", F.explode(F.sequence("lo", "hi")).alias("step")
    )


def dense_flow(ev: DataFrame, n_cells: int) -> DataFrame:
    """Amounts summed on the dense calendar. The calendar enters as zero rows before the
    aggregation, so densifying costs no join."""
    zero = dense_calendar(ev, n_cells).withColumns({"inflow": F.lit(0.0), "outflow": F.lit(0.0)})
    return _sum_flow(ev.unionByName(zero))


@view
def flow(t: Tables) -> DataFrame:
    return dense_flow(flow_sparse(t), N_CELLS)


@view
def flow_null(t: Tables) -> DataFrame:
    """Dense calendar, null where no event was seen."""
    ev = flow_sparse(t)
    blank = dense_calendar(ev, N_CELLS).withColumns(
        {"inflow": F.lit(None).cast("double"), "outflow": F.lit(None).cast("double")}
    )
    return _sum_flow(ev.unionByName(blank))


def with_split(df: DataFrame, ev: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``is_train``: the first ``share`` of the calendar. One bound row per city."""
    cut = full_days(ev).select(
        "city", (F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) * share)).alias("_cut")
    )
    return df.join(cut, "city").withColumn("is_train", F.col("step") < F.col("_cut")).drop("_cut")


@view
def flow_split(t: Tables) -> DataFrame:
    """Dense flow with ``slot`` (local) and ``is_train``."""
    return with_split(flow(t), flow_sparse(t)).withColumn("slot", tm.slot_of(F.col("step"), TZ))


cte("ev", """
SELECT event_id, user_id, event_type, value, props, ts, user_id % 64 AS grid_id,
       epoch_us(ts) // 1800000000 AS step FROM events
""")
cte("sparse", """
SELECT grid_id, step,
  round(sum(CASE WHEN event_type IN ('view','click','purchase') THEN value ELSE 0 END), 2) AS inflow,
  round(sum(CASE WHEN event_type IN ('signup','error') THEN value ELSE 0 END), 2) AS outflow
FROM ev GROUP BY ALL
""", ["ev"])
cte("bounds", "SELECT min(step) // 48 * 48 AS lo, max(step) // 48 * 48 + 47 AS hi FROM ev", ["ev"])
cte("cal", """
SELECT g.range AS grid_id, s.step FROM range(64) g,
  (SELECT unnest(range(lo, hi + 1)) AS step FROM bounds) s
""", ["bounds"])
cte("flow", """
SELECT grid_id, step, (step + 16) % 48 AS slot, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow,
  step < (SELECT lo + CAST(floor((hi - lo + 1) * 0.7::DOUBLE) AS BIGINT) FROM bounds) AS is_train
FROM cal LEFT JOIN sparse USING (grid_id, step)
""", ["cal", "sparse", "bounds"])
cte("flow_null", """
SELECT grid_id, step, inflow, outflow FROM cal LEFT JOIN sparse USING (grid_id, step)
""", ["cal", "sparse"])


# points: one per event, location by rule; category and tags from the event
def point_lon(i: Column) -> Column:
    return F.lit(116.253) + ((i * 7) % 50) * 0.01


def point_lat(i: Column) -> Column:
    return F.lit(39.753) + ((F.floor(i / 50) * 13) % 50) * 0.01


def lon_sql(i: str) -> str:
    return f"(116.253::DOUBLE + (({i} * 7) % 50) * 0.01::DOUBLE)"


def lat_sql(i: str) -> str:
    return f"(39.753::DOUBLE + ((({i} // 50) * 13) % 50) * 0.01::DOUBLE)"


def cell_sql(lon: str, lat: str, rows: int = 8, cols: int = 8) -> str:
    """Cell inside the fixture box; no bounds test."""
    return (
        f"(CAST(floor((40.25::DOUBLE - {lat}) / {0.5 / rows}::DOUBLE) AS BIGINT) * {cols} + "
        f"CAST(floor(({lon} - 116.25::DOUBLE) / {0.5 / cols}::DOUBLE) AS BIGINT))"
    )


# Fixed values of the fixture: the tag of an event type, and the values by the number in props.
TAG_KEYS = {"view": "amenity", "click": "office", "purchase": "shop", "signup": "leisure", "error": "highway"}
TAG_VALUES = [
    "restaurant", "bank", "bakery", "clinic", "pitch", "government", "books", "bus_stop",
    "parking", "place_of_worship", "cinema", "crossing", "traffic_signals", "bicycle_rental",
]
SIDE_VALUES = ["house", "yes", "terrace"]


@view
def osm_nodes(t: Tables) -> DataFrame:
    """One tagged node per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    key = F.create_map(*[F.lit(x) for kv in TAG_KEYS.items() for x in kv])[F.col("event_type")]
    tags = F.map_from_arrays(
        F.array(F.lit("name"), key, F.lit("building"), F.lit("station"), F.lit("railway")),
        F.array(
            F.concat(F.lit("n"), F.col("event_type")),
            F.element_at(F.array(*[F.lit(v) for v in TAG_VALUES]), k % len(TAG_VALUES) + 1),
            F.element_at(F.array(*[F.lit(v) for v in SIDE_VALUES]), k % len(SIDE_VALUES) + 1),
            F.when(k % 5 == 0, "subway").otherwise("none"),
            F.when(k % 7 == 0, "subway_entrance").otherwise("none"),
        ),
    )
    i = F.col("event_id")
    return t.events.select(
        i.alias("id"), point_lon(i).alias("lon"), point_lat(i).alias("lat"), tags.alias("tags"),
        k.alias("k"), "event_type", "value", "ts",
    )


cte("nodes", f"""
SELECT event_id AS id, {lon_sql('event_id')} AS lon, {lat_sql('event_id')} AS lat, k, event_type, value, ts,
  CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in TAG_KEYS.items())} END AS key1,
  {TAG_VALUES!r}[k % {len(TAG_VALUES)} + 1] AS val1, {SIDE_VALUES!r}[k % {len(SIDE_VALUES)} + 1] AS val2,
  k % 5 = 0 AS is_station, k % 7 = 0 AS is_entrance, {cell_sql(lon_sql('event_id'), lat_sql('event_id'))} AS grid_id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
""")


# ways: one per lineitem row, three vertices, short enough to cross a few cells
WAY_TYPES = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential",
    "service", "footway", "path", "cycleway", "pedestrian", "steps", "track",
]


@view
def osm_ways(t: Tables) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x0, y0 = point_lon(p), point_lat(p)
    x1, y1 = x0 + (s % 7 - 3) * 0.011, y0 + (n % 7 - 3) * 0.009
    x2, y2 = x1 + (n % 5 - 2) * 0.013, y1 + (s % 5 - 2) * 0.012
    kind = F.element_at(F.array(*[F.lit(w) for w in WAY_TYPES]), (p % len(WAY_TYPES) + 1).cast("int"))
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.create_map(F.lit("highway"), kind).alias("tags"),
        F.array(pt(x0, y0), pt(x1, y1), pt(x2, y2)).alias("coords"),
    )


cte("ways", f"""
SELECT kind, x0, y0, x1, y1, x1 + (l_linenumber % 5 - 2) * 0.013::DOUBLE AS x2,
       y1 + (l_suppkey % 5 - 2) * 0.012::DOUBLE AS y2
FROM (SELECT *, x0 + (l_suppkey % 7 - 3) * 0.011::DOUBLE AS x1, y0 + (l_linenumber % 7 - 3) * 0.009::DOUBLE AS y1
  FROM (SELECT *, {lon_sql('l_partkey')} AS x0, {lat_sql('l_partkey')} AS y0,
        {WAY_TYPES!r}[l_partkey % {len(WAY_TYPES)} + 1] AS kind FROM lineitem))
""")


# transit timetable: trips, stop times and stops
@view
def trips(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"))


@view
def stop_times(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"))


@view
def stops(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    return t.part.select(p.alias("stop_id"), point_lon(p).alias("stop_lon"), point_lat(p).alias("stop_lat"))


# stations: three customers share one; the line is the nation, the first train follows the balance
@view
def stations(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    place = F.floor(c / 3)
    lon, lat = point_lon(place * 11), point_lat(place * 11)
    return t.customer.select(
        F.col("c_nationkey").cast("long").alias("line"),
        F.col("c_mktsegment").alias("direction"),
        F.format_string("S%08d", place).alias("station"),
        F.format_string("%02d:%02d", F.pmod(F.floor("c_acctbal"), F.lit(24)), F.pmod(c * 7, F.lit(60))).alias("first_train"),
        cell_id(lon, lat, GRID).alias("grid_id"),
    )


cte("stations", f"""
SELECT CAST(c_nationkey AS BIGINT) AS line, c_mktsegment AS direction, printf('S%08d', c_custkey // 3) AS station,
  ((CAST(floor(c_acctbal) AS BIGINT) % 24) + 24) % 24 * 60 + (c_custkey * 7) % 60 AS minutes,
  {cell_sql(lon_sql('(c_custkey // 3 * 11)'), lat_sql('(c_custkey // 3 * 11)'))} AS grid_id
FROM customer
""")


# names: distinct part names, and a second list with two characters missing from odd-length names
def names_a(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_name").alias("name"))


def names_b(t: Tables) -> DataFrame:
    n = F.col("p_name")
    cut = F.concat(F.substring(n, 1, 1), F.expr("substring(p_name, 4)"))
    return t.part.select(F.when(F.length(n) % 2 == 1, cut).otherwise(n).alias("name"))


cte("names_a", "SELECT DISTINCT p_name AS name FROM part")
cte("names_b", """
SELECT DISTINCT CASE WHEN length(p_name) % 2 = 1 THEN substr(p_name, 1, 1) || substr(p_name, 4)
  ELSE p_name END AS name FROM part
""")


# weather: hourly means of all events; for queries that merge two sources those of the even and of the odd ones
def weather_source(t: Tables, half: int | None = None) -> DataFrame:
    hour = F.floor(tm.step_of(F.col("ts")) / 2)
    events = t.events if half is None else t.events.where(F.col("event_id") % 2 == half)
    return (
        events.groupBy(F.lit("bj").alias("city"), hour.alias("hour"))
        .agg(
            rnd(F.avg("value")).alias("temp"),
            F.round(F.max("value"), 2).alias("wind_speed"),
            F.count("*").alias("clouds_all"),
        )
    )


for _n, _half in (("w", ""), ("wa", "WHERE event_id % 2 = 0"), ("wb", "WHERE event_id % 2 = 1")):
    cte(_n, f"""
    SELECT step // 2 AS hour, {_rnd("avg(value)", "temp")}, round(max(value), 2) AS wind_speed,
      count(*) AS clouds_all FROM ev {_half} GROUP BY ALL
    """, ["ev"])


@view
def holidays(t: Tables) -> DataFrame:
    """The city's holiday list (city, d), read from a text of dates: the Sundays among the local days of all events."""
    path = fresh_dir(t.spark, "holidays")
    day = tm.local_date(tm.step_of(F.col("ts")), TZ)
    lines = F.array(F.date_format("day", "yyyy-MM-dd"), F.lit("# holidays"))
    days = t.events.select(day.alias("day")).distinct().where(F.dayofweek("day") == 1)
    days.select(F.explode(lines).alias("value")).write.text(path)
    return read_dates(t.spark, path).select(F.lit(GRID.city).alias("city"), "d")


cte("holidays", "SELECT d FROM (SELECT DISTINCT CAST(make_timestamp((step + 16) * 1800000000) AS DATE) AS d FROM ev) WHERE isodow(d) = 7", ["ev"])


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def pixels(t: Tables) -> DataFrame:
    """One pixel per lineitem row: raster position from the keys, bands from the numbers."""
    return t.lineitem.select(
        F.lit("bj").alias("scene"),
        (F.col("l_orderkey") % 64).alias("row"),
        (F.col("l_partkey") % 64).alias("col"),
        (F.col("l_linenumber") * 1000 + F.col("l_quantity") * 100).alias("dn3"),
        F.round(F.col("l_extendedprice") / 10).alias("dn4"),
        F.round(F.col("l_discount") * 200000).alias("dn5"),
        F.round(F.col("l_tax") * 200000).alias("dn6"),
    )


def scenes(t: Tables) -> DataFrame:
    """Calibration of the scene, one row; the sun elevation comes from the region count."""
    return t.region.groupBy(F.lit("bj").alias("scene")).agg(
        F.lit(2e-5).alias("mult"), F.lit(-0.1).alias("add"), (F.count("*") * 10.0).alias("sun_elev")
    )


cte("pixels", """
SELECT l_orderkey % 64 AS "row", l_partkey % 64 AS col, l_linenumber * 1000 + l_quantity * 100 AS dn3,
  round(l_extendedprice / 10) AS dn4, round(l_discount * 200000) AS dn5, round(l_tax * 200000) AS dn6
FROM lineitem
""")


# relations: one per order, its lineitems are the members
ROLES = ["platform_entry", "stop", "forward"]


def osm_relations(t: Tables) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(x) for x in ROLES]), F.col("l_linenumber") % len(ROLES) + 1)
    kind = F.when(F.col("l_quantity") % 10 == 0, "w").otherwise("n")
    member = F.struct(kind.alias("type"), F.col("l_partkey").alias("ref"), role.alias("role"))
    # an order has a handful of lineitems
    members = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(member).alias("members"))
    o = t.orders
    tags = F.map_from_arrays(
        F.array(F.lit("route"), F.lit("ref"), F.lit("name")),
        F.array(
            F.when(F.col("o_orderpriority").startswith("1"), "subway").otherwise("bus"),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("R"), F.col("o_custkey").cast("string"))),
            F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("N"), F.col("o_custkey").cast("string"))),
        ),
    )
    return members.join(o.select(F.col("o_orderkey").alias("id"), tags.alias("tags")), "id")


cte("relation_members", f"""
SELECT DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN 'subway' ELSE 'bus' END AS route,
  coalesce(CASE WHEN o_orderstatus != 'P' THEN 'R' || o_custkey END, CASE WHEN o_orderstatus != 'O' THEN 'N' || o_custkey END,
    'route_' || o_orderkey) AS line, l_partkey AS node_id, {ROLES!r}[l_linenumber % {len(ROLES)} + 1] AS role
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity % 10 != 0
""")
