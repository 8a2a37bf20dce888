"""Spatial joins on boxes, neighbours by shared boundary, and dissolving units into their parents.

Coordinates are whole steps, so all comparisons are exact. Nothing compares all pairs: boxes meet in cells of a grid whose
size follows their own, segments on their common line, and rings are found by doubling pointers on written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import geometry as geo
from tidewatch.operators import stored
from tidewatch.plans.registry import query
from tidewatch.sources import bind, boundaries

VERSION = "1"
BOX = ["west", "south", "east", "north"]


def box_pairs(boxes: DataFrame) -> DataFrame:
    """a, b (a < b): units (unit_id, box) whose boxes overlap or touch, each pair once.

    A box lies in at most four cells of the grid whose cells are no smaller than it. It goes there, and on the side of the
    smaller boxes also to its cells of all coarser grids, so that boxes of any sizes meet in the grid of the larger one.
    Of the cells in which a pair meets, the one that holds the lower left corner of what they share gives it.
    """
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1))
    own = boxes.select("unit_id", *BOX, F.ceil(F.log2(extent)).cast("int").alias("level"))
    at = lambda c: F.expr(f"shiftright({c}, grid)")

    def dealt(rows: DataFrame, grids: Column, name: str) -> DataFrame:
        r = rows.select("*", F.explode(grids).alias("grid"))
        r = r.select("*", F.explode(F.sequence(at("west"), at("east"))).alias("cx"))
        r = r.select("*", F.explode(F.sequence(at("south"), at("north"))).alias("cy"))
        return r.select("grid", "cx", "cy", *(F.col(c).alias(f"{name}_{c}") for c in ["unit_id", "level", *BOX]))

    top = own.select(F.max("level")).scalar()
    m = dealt(own, F.sequence("level", top), "a").join(dealt(own, F.array("level"), "b"), ["grid", "cx", "cy"])
    corner = (F.col("cx") == F.expr("shiftright(greatest(a_west, b_west), grid)")) & (F.col("cy") == F.expr("shiftright(greatest(a_south, b_south), grid)"))
    touch = (F.col("a_west") <= F.col("b_east")) & (F.col("b_west") <= F.col("a_east")) & (F.col("a_south") <= F.col("b_north")) & (F.col("b_south") <= F.col("a_north"))
    once = (F.col("a_level") < F.col("b_level")) | ((F.col("a_level") == F.col("b_level")) & (F.col("a_unit_id") < F.col("b_unit_id")))
    return m.where(corner & touch & once).select(F.least("a_unit_id", "b_unit_id").alias("a"), F.greatest("a_unit_id", "b_unit_id").alias("b"))


def _gcd(a: Column, b: Column) -> Column:
    """Of two 32-bit numbers: Euclid's steps, 48 at most."""
    pair = lambda x, y: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(pair(s.b, s.a % F.nullif(s.b, F.lit(0))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), pair(a, b), step, lambda s: s.a)


def segments(rings: DataFrame, key: str) -> DataFrame:
    """key, nx, ny, c (the line: its least direction, the first part not below 0, and offset), way (1 or -1: how the segment runs
    along it), low, high (places on the line), p_low, p_high (the points there), of the edges of rings (key, ring)."""
    n = F.size("ring") - 1
    e = rings.select(key, F.explode(F.zip_with(F.slice("ring", 1, n), F.slice("ring", 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("e"))
    e = e.select(key, "e.*").where(~F.col("p").eqNullSafe(F.col("q"))).withColumns({"dx": F.expr("q.x - p.x"), "dy": F.expr("q.y - p.y")})
    e = e.withColumns({"way": F.when((F.col("dx") < 0) | ((F.col("dx") == 0) & (F.col("dy") < 0)), -1).otherwise(1), "g": _gcd(F.abs("dx"), F.abs("dy"))})
    e = e.withColumns({"nx": F.expr("dx div g * way"), "ny": F.expr("dy div g * way")}).withColumn("c", F.expr("nx * p.y - ny * p.x"))
    low, high = F.when(F.col("way") == 1, F.col("p")).otherwise(F.col("q")), F.when(F.col("way") == 1, F.col("q")).otherwise(F.col("p"))
    place = lambda p: F.when(F.col("nx") != 0, p.x).otherwise(p.y)
    e = e.select(key, "nx", "ny", "c", "way", low.alias("p_low"), high.alias("p_high"))
    return e.withColumns({"low": place(F.col("p_low")), "high": place(F.col("p_high"))})


def neighbours(units: DataFrame) -> DataFrame:
    """a, b (a < b), shared: units (unit_id, ring, box) with a common boundary of some length; units that meet in points only are
    none. Boxes find the candidates; of a candidate, segments on one line are laid over each other."""
    s = segments(units, "unit_id")
    a, b = (s.select(F.col("unit_id").alias(k), "nx", "ny", "c", F.col("low").alias(f"{k}_low"), F.col("high").alias(f"{k}_high")) for k in ("a", "b"))
    m = box_pairs(units).join(a, "a").join(b, ["b", "nx", "ny", "c"])
    over = F.least("a_high", "b_high") - F.greatest("a_low", "b_low")
    step = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")) / F.when(F.col("nx") != 0, F.col("nx")).otherwise(F.col("ny"))
    return m.where(over > 0).groupBy("a", "b").agg(F.sum(over * step).alias("shared"))


_SHARED = "CASE WHEN a.east = b.west OR b.east = a.west THEN least(a.north, b.north) - greatest(a.south, b.south) ELSE least(a.east, b.east) - greatest(a.west, b.west) END"
_MEET = "((a.east = b.west OR b.east = a.west) AND least(a.north, b.north) > greatest(a.south, b.south) OR (a.north = b.south OR b.north = a.south) AND least(a.east, b.east) > greatest(a.west, b.west))"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.subcounties(spark, sf_dir).withColumn("ring", boundaries.ring_of_box())


@query("unit_neighbours", f"WITH {bind.CTES}, {boundaries.CTES} SELECT a.unit_id AS a, b.unit_id AS b, CAST({_SHARED} AS DOUBLE) AS shared FROM sub a JOIN sub b ON a.unit_id < b.unit_id AND {_MEET}")
def unit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subcounties with a common boundary, and its length."""
    return neighbours(units(spark, sf_dir))


#: src, dst: neighbouring districts, for SQL texts after those of bind.
ADJACENT = f"""{boundaries.CTES}, adj AS MATERIALIZED (SELECT DISTINCT CAST(substr(a.parent_id, 2) AS BIGINT) AS src, CAST(substr(b.parent_id, 2) AS BIGINT) AS dst FROM sub a JOIN sub b ON a.parent_id <> b.parent_id AND {_MEET} WHERE starts_with(a.parent_id, 'D') AND starts_with(b.parent_id, 'D'))"""


def parents_adjacent(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """src, dst: both directions of parents (unit_id, parent_id) that pairs (a, b) of their children join."""
    p = lambda k, name: parents.select(F.col("unit_id").alias(k), F.col("parent_id").alias(name))
    m = pairs.join(p("a", "src"), "a").join(p("b", "dst"), "b").where("src <> dst").select("src", "dst")
    return m.union(m.select("dst", "src")).distinct()


@query("district_neighbours", f"WITH {bind.CTES}, {ADJACENT} SELECT src, dst FROM adj")
def district_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring districts in both directions, evaluated once for the tables that make the boundaries."""

    def build() -> DataFrame:
        u = units(spark, sf_dir)
        found = parents_adjacent(neighbours(u), u.select("unit_id", "parent_id").where("parent_id LIKE 'D%'"))
        return found.select(*(F.expr(f"CAST(substr({c}, 2) AS BIGINT)").alias(c) for c in ("src", "dst")))

    return stored.evaluation(spark, "adjacency", VERSION, [f"{sf_dir}/{t}.parquet" for t in ("nation", "region", "supplier")], build)


# Dissolving


def outline(children: DataFrame) -> DataFrame:
    """parent_id, x1, y1, x2, y2: the boundary of the union of children (parent_id, ring), inside on the left.

    Along a line, a child's edge counts 1 or -1 by its direction. Where two children share it the counts cancel, whether or
    not their edges end at the same points; what is left between two changes of the sum is a boundary.
    """
    line = ["parent_id", "nx", "ny", "c"]
    s = segments(children, "parent_id")
    ends = F.explode(F.array(F.struct(F.col("low").alias("at"), F.col("p_low").alias("p"), F.col("way").alias("step")), F.struct(F.col("high").alias("at"), F.col("p_high").alias("p"), (-F.col("way")).alias("step"))))
    change = s.select(*line, ends.alias("e")).groupBy(*line, "e.at").agg(F.sum("e.step").alias("step"), F.min("e.p").alias("p")).where("step <> 0")
    order = Window.partitionBy(*line).orderBy("at")
    e = change.select("parent_id", F.sum("step").over(order).alias("net"), F.col("p").alias("p"), F.lead("p").over(order).alias("q")).where("net <> 0")
    a, b = F.when(F.col("net") > 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("net") > 0, F.col("q")).otherwise(F.col("p"))
    return e.select("parent_id", a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))


def stitched(edges: DataFrame) -> DataFrame:
    """parent_id, place, x, y, start (the least edge of the ring): edges (parent_id, x1, y1, x2, y2) in the order of their rings.

    Where several edges leave a point, the sharpest turn to the left follows, so parts that touch in a point stay apart.
    Each round doubles the reach of every edge's pointer: rings of any length take as many rounds as their length has bits.
    """
    e = stored.written(edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    f = e.select("parent_id", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("id").alias("next"))
    ax, ay, bx, by = (F.expr(x).cast("double") for x in ("x2 - x1", "y2 - y1", "x3 - x2", "y3 - y2"))
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.when(turn > 3.14159, -4.0).otherwise(turn)), "next"))
    follow = e.join(f, ["parent_id", "x2", "y2"]).withColumn("best", best).where("best = 1")
    least = F.struct("x1", "y1", "x2", "y2", "id")
    follow = stored.written(follow.select("id", "parent_id", "x1", "y1", "next", least.alias("own")), "follow")
    label = follow.select("id", F.col("next").alias("to"), F.col("own").alias("least"))
    while True:
        far = label.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("least").alias("other"))
        label = stored.written(label.join(far, "to").select("id", F.col("beyond").alias("to"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")), "labels")
        if label.where("moved").isEmpty():
            break
    # Distances to the end of the ring, which lies before its least edge.
    f = follow.join(label.select("id", "least"), "id")
    rank = stored.written(f.select("id", F.when(F.col("next") != F.col("least.id"), F.col("next")).alias("to"), F.lit(1).cast("long").alias("left")), "ranks")
    while not rank.where("to IS NOT NULL").isEmpty():
        far = rank.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("left").alias("more"))
        rank = stored.written(rank.join(far, "to", "left").select("id", F.col("beyond").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "ranks")
    return f.join(rank, "id").select("parent_id", (-F.col("left")).alias("place"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.struct("least.x1", "least.y1", "least.x2", "least.y2").alias("start"))


def dissolved(children: DataFrame) -> DataFrame:
    """parent_id, ring: the closed rings around the union of children (parent_id, ring), from their least points on; those around
    parts run against the clock, those around holes with it."""
    points = stitched(outline(children)).groupBy("parent_id", "start").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("p"))
    ring = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    return points.select("parent_id", ring.alias("ring"))


def parent_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of districts, city units and regions, evaluated once for the tables that make the boundaries."""

    def build() -> DataFrame:
        u = units(spark, sf_dir)
        return dissolved(u.select("parent_id", "ring").union(u.select(F.concat(F.lit("R"), "region_id"), "ring")))

    return stored.evaluation(spark, "rings", VERSION, [f"{sf_dir}/{t}.parquet" for t in ("nation", "region", "supplier")], build)


#: ring(parent_id, pts): closed rings from their least points on, walked edge by edge.
RINGS = f"""{boundaries.CTES}, ch AS (SELECT parent_id, west, south, east, north FROM sub UNION ALL SELECT 'R' || region_id, west, south, east, north FROM sub),
ed AS (SELECT parent_id, west AS x1, south AS y1, east AS x2, south AS y2 FROM ch UNION ALL SELECT parent_id, east, south, east, north FROM ch UNION ALL SELECT parent_id, east, north, west, north FROM ch UNION ALL SELECT parent_id, west, north, west, south FROM ch),
bo AS MATERIALIZED (SELECT a.* FROM ed a ANTI JOIN ed b ON a.parent_id = b.parent_id AND a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1),
wk AS (SELECT parent_id, x1 AS sx, y1 AS sy, x1, y1, x2, y2, 0 AS k FROM bo UNION ALL SELECT wk.parent_id, sx, sy, bo.x1, bo.y1, bo.x2, bo.y2, k + 1 FROM wk JOIN bo ON bo.parent_id = wk.parent_id AND bo.x1 = wk.x2 AND bo.y1 = wk.y2 WHERE wk.x2 <> sx OR wk.y2 <> sy),
cn AS (SELECT *, lag((sign(x2 - x1), sign(y2 - y1))) OVER w AS before, (sign(x2 - x1), sign(y2 - y1)) AS now, min((x1, y1)) OVER (PARTITION BY parent_id, sx, sy) AS least FROM wk WINDOW w AS (PARTITION BY parent_id, sx, sy ORDER BY k)),
ring AS MATERIALIZED (SELECT parent_id, list({{'x': x1, 'y': y1}} ORDER BY k) AS open, list_append(list({{'x': x1, 'y': y1}} ORDER BY k), {{'x': sx, 'y': sy}}) AS pts FROM cn WHERE least = (sx, sy) AND (before IS NULL OR before <> now) GROUP BY parent_id, sx, sy)"""
_EACH = "list_sum(list_transform(range(1, len(pts)), lambda i: {}))"
_AREA = _EACH.format("pts[i].x * pts[i + 1].y - pts[i + 1].x * pts[i].y") + " / 2.0"
_LENGTH = _EACH.format("sqrt((pts[i].x - pts[i + 1].x) ** 2 + (pts[i].y - pts[i + 1].y) ** 2)")


@query("dissolved_rings", f"WITH RECURSIVE {bind.CTES}, {RINGS} SELECT parent_id, CASE WHEN {_AREA} > 0 THEN 'part' ELSE 'hole' END AS kind, len(open) AS points, CAST({_AREA} AS DOUBLE) AS area, CAST({_LENGTH} AS DOUBLE) AS perimeter, array_to_string(list_transform(pts, lambda p: p.x || ' ' || p.y), ',') AS path FROM ring")
def dissolved_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of districts, cities and regions, dissolved from their subcounties."""
    area = geo.signed_area(F.col("ring"))
    path = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ",")
    return parent_rings(spark, sf_dir).select("parent_id", F.when(area > 0, "part").otherwise("hole").alias("kind"), (F.size("ring") - 1).alias("points"), area.alias("area"), geo.length(F.col("ring")).alias("perimeter"), path.alias("path"))


@query("dissolve_control", f"WITH RECURSIVE {bind.CTES}, {RINGS}, a AS (SELECT parent_id, count(*) AS children, CAST(sum((east - west) * (north - south)) AS DOUBLE) AS children_area FROM ch GROUP BY 1), r AS (SELECT parent_id, {_AREA} AS area FROM ring) SELECT parent_id, children, children_area, count(*) FILTER (area > 0) AS parts, count(*) FILTER (area < 0) AS holes, abs(CAST(sum(area) AS DOUBLE) - max(children_area)) < 1e-6 AS agrees FROM r JOIN a USING (parent_id) GROUP BY ALL")
def dissolve_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the area within a parent's rings, holes taken off, is that of its children, which are measured on their own."""
    u = units(spark, sf_dir)
    every = u.select("parent_id", "ring").union(u.select(F.concat(F.lit("R"), "region_id"), "ring"))
    own = every.groupBy("parent_id").agg(F.count("*").alias("children"), F.sum(geo.signed_area(F.col("ring"))).alias("children_area"))
    area = F.col("area")
    r = parent_rings(spark, sf_dir).select("parent_id", geo.signed_area(F.col("ring")).alias("area"))
    r = r.groupBy("parent_id").agg(F.count_if(area > 0).alias("parts"), F.count_if(area < 0).alias("holes"), F.sum("area").alias("total"))
    return r.join(own, "parent_id").select("parent_id", "children", "children_area", "parts", "holes", (F.abs(F.col("total") - F.col("children_area")) < 1e-6).alias("agrees"))


def on_sphere(ring: Column) -> Column:
    """Steps as longitudes and latitudes."""
    return F.transform(ring, lambda p: F.struct((p.x * boundaries.STEP + boundaries.EAST).alias("x"), (p.y * boundaries.STEP + boundaries.NORTH).alias("y")))


_LL = f"list_transform(pts, lambda p: {{'x': p.x * {boundaries.STEP}::DOUBLE + {boundaries.EAST}::DOUBLE, 'y': p.y * {boundaries.STEP}::DOUBLE + ({boundaries.NORTH})::DOUBLE}})"
_SPHERE = f"abs({_EACH.format('(radians(pts[i + 1].x) - radians(pts[i].x)) * (2 + sin(radians(pts[i].y)) + sin(radians(pts[i + 1].y)))')}) * {geo.RADIUS_KM}::DOUBLE * {geo.RADIUS_KM}::DOUBLE / 2"
_ARC = _EACH.format("2 * asin(sqrt(sin((radians(pts[i + 1].y) - radians(pts[i].y)) / 2) ** 2 + cos(radians(pts[i].y)) * cos(radians(pts[i + 1].y)) * sin((radians(pts[i + 1].x) - radians(pts[i].x)) / 2) ** 2))") + f" * {geo.RADIUS_KM}::DOUBLE"


@query("boundary_measures", f"""WITH RECURSIVE {bind.CTES}, {RINGS}, ll AS (SELECT parent_id, {_AREA} > 0 AS part, {_LL} AS pts FROM ring), m AS (SELECT parent_id, part, {_SPHERE} AS area, {_ARC} AS len, list_min(list_transform(pts, lambda p: p.x)) AS west, list_min(list_transform(pts, lambda p: p.y)) AS south, list_max(list_transform(pts, lambda p: p.x)) AS east, list_max(list_transform(pts, lambda p: p.y)) AS north, len(pts) AS n FROM ll)
SELECT parent_id AS unit_id, round(sum(CASE WHEN part THEN area ELSE -area END), 3) AS area_km2, round(sum(len), 3) AS perimeter_km, count(*) FILTER (part) AS parts, count(*) AS rings, CAST(sum(n) AS BIGINT) AS points, round(min(west), 6) AS west, round(min(south), 6) AS south, round(max(east), 6) AS east, round(max(north), 6) AS north FROM m GROUP BY 1""")
def boundary_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and perimeter on the sphere, counts and box of every dissolved unit."""
    r = parent_rings(spark, sf_dir).select("parent_id", (geo.signed_area(F.col("ring")) > 0).alias("part"), on_sphere(F.col("ring")).alias("ring"))
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    r = r.select("parent_id", "part", geo.geodesic_area_km2(F.col("ring")).alias("area"), geo.geodesic_length_km(F.col("ring")).alias("len"), F.size("ring").alias("n"), edge(F.array_min, "x").alias("west"), edge(F.array_min, "y").alias("south"), edge(F.array_max, "x").alias("east"), edge(F.array_max, "y").alias("north"))
    m = r.groupBy(F.col("parent_id").alias("unit_id")).agg(F.round(F.sum(F.when(F.col("part"), F.col("area")).otherwise(-F.col("area"))), 3).alias("area_km2"), F.round(F.sum("len"), 3).alias("perimeter_km"), F.count_if("part").alias("parts"), F.count("*").alias("rings"), F.sum("n").alias("points"), *(F.round(f(c), 6).alias(c) for f, c in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"))))
    return m


# Files


def _faulty(d: Column) -> Column:
    """A bad ring besides the sound ones, by district: left open, with too few points, without area, or a hole outside."""
    ring = lambda *xy: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy))
    return F.when(d % 6 == 1, F.array(ring((0, 0), (1, 0), (1, 1)))).when(d % 6 == 2, F.array(ring((0, 0), (1, 0), (0, 0)))).when(d % 6 == 3, F.array(ring((0, 0), (1, 0), (2, 0), (0, 0)))).when(d % 6 == 4, F.array(ring((-9, -9), (-8, -9), (-8, -8), (-9, -9)))).otherwise(F.array().cast(f"array<{boundaries.POINTS}>"))


def boundary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document, text: a file for every region in either format, with its districts' boundaries as features; some hold bad rings."""
    flat = parent_rings(spark, sf_dir).where("parent_id LIKE 'D%'").select("parent_id", F.reverse(F.transform("ring", lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y")))).alias("ring"))
    u = flat.groupBy("parent_id").agg(F.array_sort(F.collect_list("ring")).alias("rings")).withColumn("d", F.expr("CAST(substr(parent_id, 2) AS BIGINT)"))
    u = u.join(bind.districts(spark, sf_dir).select(F.col("district_id").alias("d"), "region_id", "district_name"), "d").withColumn("bad", _faulty(F.col("d")))
    pair = lambda r: F.transform(r, lambda p: F.array(p.x, p.y))
    about = F.struct(F.col("parent_id").alias("unit_id"), F.col("district_name").alias("name"))
    polygons = F.transform(boundaries.nested(F.col("rings")), lambda p: F.concat(F.array(pair(p["outer"])), F.transform(p["holes"], pair)))
    # In GeoJSON a bad ring is a polygon of its own; a hole outside cannot be written there and becomes a hole of the first.
    hole = F.col("d") % 6 == 4
    more = F.transform(F.when(hole, F.slice(F.col("bad"), 1, 0)).otherwise(F.col("bad")), lambda r: F.array(pair(r)))
    first = F.transform(polygons, lambda p, i: F.when(hole & (i == 0), F.concat(p, F.transform("bad", pair))).otherwise(p))
    geojson = F.struct(F.lit("Feature").alias("type"), about.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.concat(first, more).alias("coordinates")).alias("geometry"))
    esri = F.struct(about.alias("attributes"), F.struct(F.transform(F.concat("rings", "bad"), pair).alias("rings")).alias("geometry"))
    g = u.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("d", geojson.alias("f")))).alias("g"), F.array_sort(F.collect_list(F.struct("d", esri.alias("f")))).alias("e"))
    text = F.array(F.struct(F.concat(F.lit("geojson-"), "region_id").alias("document"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("g", lambda x: x.f).alias("features"))).alias("text")), F.struct(F.concat(F.lit("rings-"), "region_id").alias("document"), F.to_json(F.struct(F.lit("esriGeometryPolygon").alias("geometryType"), F.struct(F.lit(4326).alias("wkid")).alias("spatialReference"), F.transform("e", lambda x: x.f).alias("features"))).alias("text")))
    return g.select(F.explode(text).alias("t")).select("t.*")


@query("boundary_features", f"""WITH RECURSIVE {bind.CTES}, {RINGS}, r AS (SELECT parent_id, {_AREA} AS area, len(open) AS n FROM ring WHERE starts_with(parent_id, 'D')), f AS (SELECT parent_id, count(*) FILTER (area > 0) AS polygons, count(*) FILTER (area < 0) AS holes, CAST(sum(area) AS DOUBLE) AS area, CAST(sum(n + 1) AS BIGINT) AS points FROM r GROUP BY 1)
SELECT k || '-' || region_id AS document, CASE k WHEN 'geojson' THEN k ELSE 'feature_set' END AS format, 'EPSG:4326' AS crs, parent_id AS unit_id, district_name AS name, polygons, holes, area, points FROM f JOIN district ON parent_id = 'D' || district_id, (VALUES ('geojson'), ('rings')) t(k)""")
def boundary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units read from files of both formats: their polygons are equal."""
    f = boundaries.read_polygons(boundary_files(spark, sf_dir))
    every = F.flatten(F.transform("polygons", lambda p: F.concat(F.array(p["outer"]), p["holes"])))
    area = F.aggregate(every, F.lit(0.0), lambda s, r: s + geo.signed_area(r))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    return f.select("document", "format", "crs", F.col("properties")["unit_id"].alias("unit_id"), F.col("properties")["name"].alias("name"), F.size("polygons").cast("long").alias("polygons"), total(F.transform("polygons", lambda p: F.size(p["holes"]))).alias("holes"), area.alias("area"), total(F.transform(every, F.size)).alias("points"))


@query("boundary_defects", f"WITH {bind.CTES}, d AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY district_id) - 1 AS place FROM district) SELECT k || '-' || region_id AS document, CAST(place AS INTEGER) AS place, CASE district_id % 6 WHEN 1 THEN 'unclosed_ring' WHEN 2 THEN 'too_few_points' WHEN 3 THEN 'no_area' WHEN 4 THEN 'hole_outside' END AS code FROM d, (VALUES ('geojson'), ('rings')) t(k) WHERE district_id % 6 BETWEEN 1 AND 4")
def boundary_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that files hold and no polygon takes, each with its fault."""
    return boundaries.defects(boundary_files(spark, sf_dir)).select("document", "place", "code")


@query("boundary_profiles", f"WITH {bind.CTES} SELECT k || '-' || region_id AS document, CASE k WHEN 'geojson' THEN k ELSE 'feature_set' END AS format, 'EPSG:4326' AS crs, CASE k WHEN 'geojson' THEN 'MultiPolygon' ELSE 'rings' END AS kinds, count(*) AS features, count(*) FILTER (district_id % 6 BETWEEN 1 AND 4) AS faulty FROM district, (VALUES ('geojson'), ('rings')) t(k) GROUP BY ALL")
def boundary_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, reference system, kinds of geometry and features of every file, and how many features hold a fault."""
    files = boundary_files(spark, sf_dir)
    f = boundaries.read_features(files)
    p = f.groupBy("document", "format", "crs").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("place").alias("features"))
    bad = boundaries.defects(files).groupBy("document").agg(F.count_distinct("place").alias("faulty"))
    return p.join(bad, "document", "left").select("document", "format", "crs", "kinds", "features", F.coalesce("faulty", F.lit(0)).alias("faulty"))
