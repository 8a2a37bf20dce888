"""Boundaries of the bound tables, their files in two formats, and the reader of such files.

Every region is a band, in which its districts follow each other, each as wide as it has facilities and one column more.
A column (a facility, or what is left) has three subcounties, one above the other; the middle one of a facility that is
not active belongs to the region's city unit, an enclave in the district around it. Coordinates are whole steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import geometry as geo
from tidewatch.sources import bind

#: Degrees of a step and where the steps begin.
STEP, EAST, NORTH = 0.01, 29.5, -1.5
LEVELS = ((0, 3), (3, 7), (7, 10))
POINTS = "array<struct<x: double, y: double>>"


def subcounties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, parent_id, region_id and the box (west, south, east, north) of every subcounty, in steps."""
    d = bind.districts(spark, sf_dir).select("district_id", "region_id")
    f = bind.facilities(spark, sf_dir).select("facility_id", "district_id", "is_active")
    wide = d.join(f.groupBy("district_id").agg(F.count("*").alias("n")), "district_id", "left").withColumn("width", F.coalesce("n", F.lit(0)) + 1)
    before = Window.partitionBy("region_id").orderBy("district_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = wide.select("district_id", "region_id", "width", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("left"))
    column = f.select("district_id", "is_active", F.concat(F.lit("F"), "facility_id").alias("name"), (F.row_number().over(Window.partitionBy("district_id").orderBy("facility_id")) - 1).alias("k"))
    rest = placed.select("district_id", F.lit(True).alias("is_active"), F.concat(F.lit("D"), "district_id").alias("name"), (F.col("width") - 1).alias("k"))
    level = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (a, b) in enumerate(LEVELS))))
    c = column.unionByName(rest).join(placed, "district_id").select("*", level.alias("level"))
    x, y = F.col("left") + F.col("k"), F.col("region_id") * 10
    parent = F.when((F.col("level.i") == 1) & ~F.col("is_active"), F.concat(F.lit("C"), "region_id")).otherwise(F.concat(F.lit("D"), "district_id"))
    return c.select(F.concat("name", F.lit("-"), F.col("level.i")).alias("unit_id"), parent.alias("parent_id"), "region_id", x.cast("long").alias("west"), (y + F.col("level.low")).cast("long").alias("south"), (x + 1).cast("long").alias("east"), (y + F.col("level.high")).cast("long").alias("north"))


CTES = """df AS (SELECT d.district_id, d.region_id, count(f.facility_id) + 1 AS width FROM district d LEFT JOIN facility f USING (district_id) GROUP BY ALL),
pl AS (SELECT *, coalesce(sum(width) OVER (PARTITION BY region_id ORDER BY district_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM df),
co AS (SELECT district_id, is_active, 'F' || facility_id AS name, row_number() OVER (PARTITION BY district_id ORDER BY facility_id) - 1 AS k FROM facility UNION ALL SELECT district_id, true, 'D' || district_id, width - 1 FROM pl),
sub AS MATERIALIZED (SELECT name || '-' || i AS unit_id, CASE WHEN i = 1 AND NOT is_active THEN 'C' || region_id ELSE 'D' || district_id END AS parent_id, region_id, CAST(l + k AS BIGINT) AS west, CAST(region_id * 10 + lo AS BIGINT) AS south, CAST(l + k + 1 AS BIGINT) AS east, CAST(region_id * 10 + hi AS BIGINT) AS north
  FROM co JOIN pl USING (district_id), (VALUES (0, 0, 3), (1, 3, 7), (2, 7, 10)) t(i, lo, hi))"""


def ring_of_box() -> Column:
    """The ring of a row's box, against the clock."""
    p = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return F.array(p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north"), p("west", "south"))


def nested(rings: Column) -> Column:
    """Polygons of a flat list of closed rings (points): an outer ring is with the clock, a hole against it, as in feature
    sets; a hole goes to the smallest outer ring around its first point. Arrays of outer and holes, all rings turned to
    outer ones against the clock; holes without an outer ring are left to defects()."""
    size = lambda r: F.abs(geo.signed_area(r))
    outer = F.filter(rings, lambda r: geo.signed_area(r) < 0)
    holes = F.filter(rings, lambda r: geo.signed_area(r) > 0)

    def home(h: Column) -> Column:
        around = F.filter(outer, lambda o: geo.contains(o, h[0].x, h[0].y) & (size(o) > size(h)))
        return F.array_min(F.transform(around, lambda o: F.struct(size(o).alias("size"), o.alias("ring"))))["ring"]

    return F.transform(outer, lambda o: F.struct(F.reverse(o).alias("outer"), F.transform(F.filter(holes, lambda h: home(h).eqNullSafe(o)), F.reverse).alias("holes")))


#: What a ring may lack, in the order in which it is told.
def defect(ring: Column) -> Column:
    """The first fault of a ring, or null."""
    return F.when(F.size(ring) == 0, "empty_ring").when(F.exists(ring, lambda p: p.x.isNull() | p.y.isNull()), "missing_coordinate").when(~geo.closed(ring), "unclosed_ring").when(F.size(ring) < 4, "too_few_points").when(geo.signed_area(ring) == 0, "no_area")


FEATURES = "features array<struct<properties: map<string,string>, attributes: map<string,string>, geometry: struct<type: string, coordinates: variant, rings: array<array<array<double>>>>>>, type string, geometryType string, spatialReference struct<wkid: int>"


def points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def read_features(documents: DataFrame) -> DataFrame:
    """document, place, format, crs, properties, kind, rings of every feature of boundary files (document, text), and fault: why
    a file or a feature has no rings. A format is told by its members; a feature set's rings are flat, GeoJSON's come by
    polygon with the outer ring first, and are turned to the flat form: outer rings with the clock, holes against it."""
    d = documents.select("document", "text", F.from_json("text", FEATURES).alias("f"), F.try_parse_json("text").isNotNull().alias("sound"))
    esri = F.col("f.geometryType").isNotNull() | F.exists("f.features", lambda x: x.attributes.isNotNull())
    form = F.when(~F.col("sound") | F.col("f").isNull(), "malformed").when(F.coalesce(esri, F.lit(False)), "feature_set").when(F.col("f.type") == "FeatureCollection", "geojson").otherwise("unknown")
    crs = F.when(form == "geojson", "EPSG:4326").otherwise(F.concat(F.lit("EPSG:"), F.col("f.spatialReference.wkid").cast("string")))
    d = d.select("document", form.alias("format"), crs.alias("crs"), F.posexplode_outer("f.features").alias("place", "feature"))
    polygons = F.when(F.col("feature.geometry.type") == "MultiPolygon", F.try_variant_get("feature.geometry.coordinates", "$", "array<array<array<array<double>>>>")).when(F.col("feature.geometry.type") == "Polygon", F.array(F.try_variant_get("feature.geometry.coordinates", "$", "array<array<array<double>>>")))
    turned = lambda poly: F.transform(poly, lambda r, i: F.when(i == 0, geo.reversed_to(points(r), False)).otherwise(geo.reversed_to(points(r), True)))
    rings = F.when(F.col("format") == "feature_set", F.transform("feature.geometry.rings", points)).when(F.col("format") == "geojson", F.flatten(F.transform(polygons, turned)))
    d = d.select("document", "place", "format", "crs", F.coalesce("feature.attributes", "feature.properties").alias("properties"), F.coalesce("feature.geometry.type", F.lit("rings")).alias("kind"), rings.alias("rings"))
    fault = F.when(F.col("format").isin("malformed", "unknown"), F.concat("format", F.lit("_file"))).when(F.col("place").isNull(), "no_features").when(F.col("rings").isNull(), "no_geometry").when(F.size("rings") == 0, "empty_geometry")
    return d.withColumn("fault", fault)


def read_polygons(documents: DataFrame) -> DataFrame:
    """The features with polygons (outer, holes), from their sound rings."""
    f = read_features(documents)
    return f.withColumn("polygons", nested(F.filter("rings", lambda r: defect(r).isNull())))


def defects(documents: DataFrame) -> DataFrame:
    """document, place, ring, code of everything that read_polygons() leaves out: files, features, rings, holes without a home."""
    f = read_features(documents)
    whole = f.where("fault IS NOT NULL").select("document", "place", F.lit(None).cast("int").alias("ring"), F.col("fault").alias("code"))
    r = f.select("document", "place", "rings", F.posexplode("rings").alias("ring", "points")).withColumn("code", defect(F.col("points")))
    around = F.exists(F.filter("rings", lambda o: defect(o).isNull() & (geo.signed_area(o) < 0)), lambda o: geo.contains(o, F.col("points")[0].x, F.col("points")[0].y) & (F.abs(geo.signed_area(o)) > F.abs(geo.signed_area(F.col("points")))))
    lost = F.when((geo.signed_area(F.col("points")) > 0) & ~around, "hole_outside")
    return whole.union(r.withColumn("code", F.coalesce("code", F.when(F.col("code").isNull(), lost))).where("code IS NOT NULL").select("document", "place", "ring", "code"))
