"""Spatial joins, dissolving, files and measures against plain Python."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geometry as geo
from tidewatch.operators import geometry, stored
from tidewatch.sources import boundaries

RING = "array<struct<x: long, y: long>>"
REAL = "array<struct<x: double, y: double>>"


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(1)
    boxes = []
    for i in range(160):
        size = rng.choice([1, 2, 3, 8, 40, 300])
        x, y = rng.randrange(-200, 200), rng.randrange(-200, 200)
        boxes.append((f"u{i:03}", x, y, x + rng.randrange(size), y + rng.randrange(size)))
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    got = [tuple(r) for r in geometry.box_pairs(spark.createDataFrame(boxes, "unit_id string, west long, south long, east long, north long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_no_plan_of_the_spatial_join_compares_all_pairs(spark):
    u = spark.createDataFrame([("a", 0, 0, 1, 1), ("b", 1, 0, 2, 1)], "unit_id string, west long, south long, east long, north long")
    plan = geometry.box_pairs(u)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def unit(name, *points):
    ring = [*points, points[0]]
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return name, ring, min(xs), min(ys), max(xs), max(ys)


def frame(spark, units):
    return spark.createDataFrame(units, f"unit_id string, ring {RING}, west long, south long, east long, north long")


def test_neighbours_share_a_length_not_a_point(spark):
    units = [
        unit("long", (0, 0), (10, 0), (10, 2), (0, 2)),
        unit("low", (0, -3), (4, -3), (4, 0), (0, 0)),  # shares 4 of the 10 below
        unit("corner", (10, 2), (12, 2), (12, 4), (10, 4)),  # a point
        unit("slope", (0, 2), (10, 2), (10, 7)),  # 10 along the top
        unit("other", (2, 3), (10, 7), (4, 7), (0, 2)),  # a piece of the slope's diagonal: (0, 2) to (2, 3) and on to (10, 7)
        unit("away", (50, 50), (51, 50), (51, 51)),
    ]
    got = {(r.a, r.b): r.shared for r in geometry.neighbours(frame(spark, units)).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {("long", "low"): 4, ("long", "slope"): 10, ("other", "slope"): round(math.hypot(10, 5), 9), ("corner", "slope"): 2}


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def rings_of(spark, children):
    df = spark.createDataFrame([(p, [*r, r[0]]) for p, r in children], f"parent_id string, ring {RING}")
    out = defaultdict(list)
    for r in geometry.dissolved(df).collect():
        out[r.parent_id].append([(p.x, p.y) for p in r.ring])
    return out


def box(x, y, w=1, h=1):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_dissolving_with_holes_islands_and_touching_corners(spark):
    cells = [(x, y) for x in range(5) for y in range(5) if (x, y) not in {(2, 2), (1, 1)}]  # two holes that touch in a point
    children = [("holes", box(x, y)) for x, y in cells]
    children += [("islands", box(0, 0)), ("islands", box(1, 1)), ("islands", box(7, 7, 2, 3))]  # two touch in a point
    children += [("steps", box(0, 0, 6, 2)), ("steps", box(0, 2, 2, 1)), ("steps", box(2, 2, 3, 1)), ("steps", box(5, 2, 1, 4))]  # edges end in the middle of others
    children += [("slope", [(0, 0), (4, 0), (4, 2)]), ("slope", [(0, 0), (2, 1), (0, 4)]), ("slope", [(2, 1), (4, 2), (0, 4)])]
    got = rings_of(spark, children)
    for name, rings in got.items():
        assert all(r[0] == r[-1] == min(r[:-1]) and len(set(zip(r, r[1:], strict=False))) == len(r) - 1 for r in rings)
        assert sum(map(area, rings)) == sum(area([*r, r[0]]) for p, r in children if p == name)
    assert sorted(map(area, got["islands"])) == [1, 1, 6]
    assert sum(area(r) > 0 for r in got["holes"]) == 1 and max(map(area, got["holes"])) == 25
    assert got["steps"] == [[(0, 0), (6, 0), (6, 6), (5, 6), (5, 3), (0, 3), (0, 0)]]
    assert got["slope"] == [[(0, 0), (4, 0), (4, 2), (0, 4), (0, 0)]]


def test_dissolving_random_cells_keeps_area_and_boundary(spark):
    rng = random.Random(4)
    cells = {(x, y): rng.choice("abc") for x in range(14) for y in range(14)}
    got = rings_of(spark, [(p, box(x, y)) for (x, y), p in cells.items()])
    for p in "abc":
        own = {c for c, q in cells.items() if q == p}
        edges = sum((x + dx, y + dy) not in own for x, y in own for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        assert sum(map(area, got[p])) == len(own)
        assert sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for r in got[p] for a, b in zip(r, r[1:], strict=False)) == edges


def measured(spark, ring, *columns):
    return spark.createDataFrame([(ring,)], f"ring {REAL}").select(*columns).first()


def test_measures_on_the_sphere(spark):
    ring = [(29.5, -1.5), (35.0, -1.5), (34.2, 4.0), (30.1, 3.9), (29.5, -1.5)]
    steps = [(math.radians(b[0] - a[0]), math.radians(a[1]), math.radians(b[1])) for a, b in zip(ring, ring[1:], strict=False)]
    want_area = abs(sum(d * (2 + math.sin(p) + math.sin(q)) for d, p, q in steps)) * 6371.0088**2 / 2
    want_length = sum(2 * 6371.0088 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2)) for d, p, q in steps)
    got = measured(spark, ring, geo.geodesic_area_km2(F.col("ring")), geo.geodesic_length_km(F.col("ring")))
    assert got[0] == pytest.approx(want_area, rel=1e-9) and got[1] == pytest.approx(want_length, rel=1e-9)
    # A quarter of a degree at the equator is a known distance.
    assert measured(spark, [(0.0, 0.0), (0.25, 0.0), (0.0, 0.0)], geo.geodesic_length_km(F.col("ring")))[0] == pytest.approx(2 * 0.25 * math.pi * 6371.0088 / 180)


def test_points_in_rings(spark):
    ring = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (3.0, 2.0), (0.0, 6.0), (0.0, 0.0)]
    inside = lambda x, y: measured(spark, ring, geo.contains(F.col("ring"), F.lit(x), F.lit(y)))[0]
    assert [inside(1.0, 1.0), inside(3.0, 1.9), inside(3.0, 2.1), inside(5.5, 5.0), inside(-1.0, 1.0), inside(7.0, 0.0), inside(3.0, 6.0)] == [True, True, False, True, False, False, False]


def plain_simplified(ring, least):
    n = len(ring)
    at = lambda i: ring[n - 2 if i < 0 else 1 if i >= n else i]
    t = lambda i: abs((at(i)[0] - at(i - 1)[0]) * (at(i + 1)[1] - at(i - 1)[1]) - (at(i + 1)[0] - at(i - 1)[0]) * (at(i)[1] - at(i - 1)[1])) / 2
    return ring if n <= 4 else [p for i, p in enumerate(ring) if i in (0, n - 1) or not (t(i) < least and t(i) <= t(i - 1) and t(i) <= t(i + 1))]


def test_simplifying_keeps_what_two_units_share(spark):
    rng = random.Random(3)
    ring = [(math.cos(a / 20 * math.tau) + rng.uniform(-0.02, 0.02), math.sin(a / 20 * math.tau) + rng.uniform(-0.02, 0.02)) for a in range(20)]
    ring.append(ring[0])
    points = lambda r: [(p.x, p.y) for p in r]
    got = points(measured(spark, ring, geo.simplified(F.col("ring"), 0.02))[0])
    assert got == plain_simplified(ring, 0.02) and 4 <= len(got) < len(ring)
    back = points(measured(spark, ring[::-1], geo.simplified(F.col("ring"), 0.02))[0])
    assert back[::-1] == got
    twice = points(measured(spark, ring, geo.simplified(F.col("ring"), 0.02, 2))[0])
    assert twice == plain_simplified(got, 0.02)


def test_files_of_both_formats_and_their_faults(spark):
    part, hole, far = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)], [(20, 0), (22, 0), (22, 2), (20, 0)]
    esri = lambda *rings: {"attributes": {"unit_id": "U"}, "geometry": {"rings": rings}}
    feature = lambda kind, c: {"type": "Feature", "properties": {"unit_id": "U", "n": 3}, "geometry": {"type": kind, "coordinates": c}}
    files = {
        "e": {"geometryType": "esriGeometryPolygon", "spatialReference": {"wkid": 4326, "latestWkid": 4326}, "features": [esri(far[::-1], part[::-1], hole), esri(part[::-1], far), esri(hole[:-1]), esri(), {"attributes": {"unit_id": "V"}}]},
        "g": {"type": "FeatureCollection", "features": [feature("MultiPolygon", [[far], [part, hole]]), feature("Polygon", [part[::-1], hole[::-1]]), feature("Point", [1, 2]), feature("Polygon", [[[0, 0], [1, None], [1, 1], [0, 0]]])]},
        "u": {"type": "Topology", "features": [feature("Polygon", [part])]},
        "n": {"type": "FeatureCollection", "features": []},
    }
    rows = [(k, json.dumps(v)) for k, v in files.items()] + [("m", '{"type": "FeatureCollection", "features": ['), ("z", None)]
    docs = spark.createDataFrame(rows, "document string, text string")
    got = {(r.document, r.place): r for r in boundaries.read_polygons(docs).collect()}
    shape = lambda r: sorted((area([(p.x, p.y) for p in g["outer"]]), [area([(p.x, p.y) for p in h]) for h in g["holes"]]) for g in r.polygons)
    assert shape(got["e", 0]) == shape(got["g", 0]) == [(2.0, []), (81.0, [-4.0])]
    assert shape(got["g", 1]) == [(81.0, [-4.0])] and got["e", 0].crs == got["g", 0].crs == "EPSG:4326"
    assert got["g", 0].properties["n"] == "3" and got["e", 0].format == "feature_set"
    found = Counter((r.document, r.place, r.ring, r.code) for r in boundaries.defects(docs).collect())
    assert found == Counter([("e", 1, 1, "hole_outside"), ("e", 2, 0, "unclosed_ring"), ("e", 3, None, "empty_geometry"), ("e", 4, None, "no_geometry"), ("g", 2, None, "no_geometry"), ("g", 3, 0, "missing_coordinate"), ("u", 0, None, "unknown_file"), ("n", None, None, "no_features"), ("m", None, None, "malformed_file"), ("z", None, None, "malformed_file")])


def test_an_evaluation_is_written_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(str(tmp_path / "t")).selectExpr("id + 1 AS id")

    get = lambda **p: sorted(r.id for r in stored.evaluation(spark, "test", "1", [str(tmp_path / "t")], build, **p).collect())
    assert get() == get() == [1, 2, 3, 4, 5] and len(calls) == 1
    assert get(k=2) == [1, 2, 3, 4, 5] and len(calls) == 2
    spark.range(2).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert get() == [1, 2] and len(calls) == 3
