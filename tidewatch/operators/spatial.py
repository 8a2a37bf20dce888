"""Geographic aggregation, availability with suppression, hierarchy and scope operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.ratio import ratio, ratio_status, sql_ratio, sql_status
from tidewatch.operators import flags
from tidewatch.plans.registry import query
from tidewatch.sources import bind

_PLACE = "c AS (SELECT facility_id, month, count(*) FILTER (confirmed) AS n, count(*) FILTER (tested) AS d FROM visit GROUP BY ALL)"


@query("geographic_by_facility", f"""WITH {flags.CTES}, {_PLACE}, g AS (SELECT district_id, month, sum(n) AS n, sum(d) AS d, count(DISTINCT facility_id) AS contributing FROM c JOIN facility USING (facility_id) WHERE is_active GROUP BY ALL), e AS (SELECT district_id, count(*) AS expected FROM facility WHERE is_active GROUP BY 1)
SELECT district_id, month, CAST(n AS BIGINT) AS numerator, CAST(d AS BIGINT) AS denominator, contributing, greatest(expected, contributing) AS expected, {sql_ratio("contributing", "greatest(expected, contributing)", 4)} AS completeness, {sql_ratio("n", "d")} AS value, {sql_status("n", "d")} AS value_status FROM g JOIN e USING (district_id)""")
def by_facility(spark: SparkSession, sf_dir: str, visits: DataFrame | None = None) -> DataFrame:
    """Positivity of districts by where facilities stand, with reporting completeness."""
    c = (flags.visits(spark, sf_dir) if visits is None else visits).groupBy("facility_id", "month").agg(F.count_if("confirmed").alias("n"), F.count_if("tested").alias("d"))
    active = bind.facilities(spark, sf_dir).where("is_active")
    g = c.join(active, "facility_id").groupBy("district_id", "month").agg(F.sum("n").alias("numerator"), F.sum("d").alias("denominator"), F.count("*").alias("contributing"))
    e = active.groupBy("district_id").agg(F.count("*").alias("expected"))
    n, d, k = F.col("numerator"), F.col("denominator"), F.greatest("expected", "contributing")
    return g.join(e, "district_id").select("district_id", "month", n, d, "contributing", k.alias("expected"), ratio(F.col("contributing"), k, 4).alias("completeness"), ratio(n, d).alias("value"), ratio_status(n, d).alias("value_status"))


@query("geographic_by_residence", f"""WITH {flags.CTES}, g AS (SELECT residence_id, month, count(*) FILTER (confirmed) AS n, count(*) FILTER (tested) AS d FROM visit GROUP BY ALL) SELECT residence_id, month, n AS numerator, d AS denominator, 0 AS contributing, {sql_ratio("n", "d")} AS value, {sql_status("n", "d")} AS value_status FROM g""")
def by_residence(spark: SparkSession, sf_dir: str, visits: DataFrame | None = None) -> DataFrame:
    """Positivity by where patients live; no facility contributes as such."""
    g = (flags.visits(spark, sf_dir) if visits is None else visits).groupBy("residence_id", "month").agg(F.count_if("confirmed").alias("numerator"), F.count_if("tested").alias("denominator"))
    n, d = F.col("numerator"), F.col("denominator")
    return g.select("residence_id", "month", n, d, F.lit(0).alias("contributing"), ratio(n, d).alias("value"), ratio_status(n, d).alias("value_status"))


MIN_CELL = 5


@query("spatial_cells", f"""WITH {flags.CTES}, g AS (SELECT residence_id AS district_id, month, count(*) FILTER (confirmed) AS n, count(*) FILTER (tested) AS d FROM visit GROUP BY 1, 2),
u AS (SELECT district.district_id, m.month, region_id, n, d FROM district CROSS JOIN (SELECT DISTINCT month FROM g) m LEFT JOIN g ON g.district_id = district.district_id AND g.month = m.month)
SELECT district_id, month, CASE WHEN region_id = 4 THEN 'outside_scope' WHEN n IS NULL THEN 'missing' WHEN coalesce(d, 0) = 0 THEN 'unavailable' WHEN n > 0 AND n < {MIN_CELL} THEN 'suppressed' ELSE 'available' END AS status,
CASE WHEN region_id <> 4 AND d > 0 AND NOT (n > 0 AND n < {MIN_CELL}) THEN n END AS numerator, CASE WHEN region_id <> 4 AND d > 0 AND NOT (n > 0 AND n < {MIN_CELL}) THEN {sql_ratio("n", "d")} END AS value FROM u""")
def spatial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map layer of every month: every unit has a status, and small cells have no figure."""
    g = flags.visits(spark, sf_dir).groupBy(F.col("residence_id").alias("district_id"), "month").agg(F.count_if("confirmed").alias("n"), F.count_if("tested").alias("d"))
    seen = bind.encounters(spark, sf_dir).select("month").distinct()
    n, d = F.col("n"), F.col("d")
    status = F.when(F.col("region_id") == 4, "outside_scope").when(n.isNull(), "missing").when(F.coalesce(d, F.lit(0)) == 0, "unavailable").when((n > 0) & (n < MIN_CELL), "suppressed").otherwise("available")
    every = bind.districts(spark, sf_dir).withColumn("month", F.explode(bind.months(spark, sf_dir))).join(seen, "month", "left_semi")
    u = every.join(g, ["district_id", "month"], "left").withColumn("status", status)
    shown = F.col("status") == "available"
    return u.select("district_id", "month", "status", F.when(shown, n).alias("numerator"), F.when(shown, ratio(n, d)).alias("value"))


@query("scope_by_path", f"WITH {bind.CTES} SELECT unit_id, level, name FROM unit WHERE path = 'N/R1' OR starts_with(path, 'N/R1/')")
def scope_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a scope: its root and what lies below."""
    return bind.units(spark, sf_dir).where((F.col("path") == "N/R1") | F.col("path").startswith("N/R1/")).select("unit_id", "level", "name")


@query("facility_scope", f"WITH {bind.CTES} SELECT facility_id, facility_name FROM facility WHERE 'D' || district_id IN (SELECT unit_id FROM unit WHERE starts_with(path, 'N/R2/')) OR facility_id IN (1, 2, 3)")
def facility_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities of a scope: named ones, or those in its districts."""
    inside = bind.units(spark, sf_dir).where(F.col("path").startswith("N/R2/")).select("unit_id")
    f = bind.facilities(spark, sf_dir).withColumn("unit_id", F.concat(F.lit("D"), "district_id"))
    named = F.col("facility_id").isin(1, 2, 3)
    return f.where(~named).join(inside, "unit_id", "left_semi").unionByName(f.where(named)).select("facility_id", "facility_name")


@query("scope_visibility", f"WITH {bind.CTES} SELECT unit_id, CASE WHEN path = 'N/R3' THEN 'self' WHEN starts_with(path, 'N/R3/') THEN 'descendant' ELSE 'ancestor' END AS relation FROM unit WHERE path = 'N/R3' OR starts_with(path, 'N/R3/') OR starts_with('N/R3', path || '/')")
def scope_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a principal with one scope sees of the hierarchy."""
    p, own = F.col("path"), F.lit("N/R3")
    relation = F.when(p == own, "self").when(p.startswith("N/R3/"), "descendant").when(F.startswith(own, F.concat(p, F.lit("/"))), "ancestor")
    return bind.units(spark, sf_dir).select("unit_id", relation.alias("relation")).where("relation IS NOT NULL")


@query("ancestors", f"WITH {bind.CTES} SELECT u.unit_id, a.unit_id AS ancestor_id, a.depth FROM unit u JOIN unit a ON starts_with(u.path || '/', a.path || '/') AND a.unit_id <> u.unit_id")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadcrumbs: the prefixes of a path, joined by equality."""
    u = bind.units(spark, sf_dir)
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    own = u.where("depth > 0").select("unit_id", F.explode(prefixes).alias("prefix"))
    return own.join(u.select(F.col("path").alias("prefix"), F.col("unit_id").alias("ancestor_id"), "depth"), "prefix").select("unit_id", "ancestor_id", "depth")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root_id, unit_id of every unit and of each of its ancestors, itself included: prefixes of paths, joined by equality."""
    u = bind.units(spark, sf_dir)
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    below = u.select("unit_id", "level", "name", F.explode(prefixes).alias("root_path"))
    return below.join(u.select(F.col("path").alias("root_path"), F.col("unit_id").alias("root_id")), "root_path").drop("root_path")


@query("scope_members", f"WITH {bind.CTES} SELECT r.unit_id AS root_id, u.unit_id, u.level, u.name FROM unit r JOIN unit u ON u.path = r.path OR starts_with(u.path, r.path || '/')")
def scope_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of every scope: each root with what lies below it."""
    return _lines(spark, sf_dir).select("root_id", "unit_id", "level", "name")


@query("scope_facilities", f"WITH {bind.CTES} SELECT r.unit_id AS root_id, facility_id FROM unit r JOIN unit u ON u.path = r.path OR starts_with(u.path, r.path || '/') JOIN facility ON u.unit_id = 'D' || district_id")
def scope_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facilities of every scope."""
    f = bind.facilities(spark, sf_dir).select("facility_id", F.concat(F.lit("D"), "district_id").alias("unit_id"))
    return _lines(spark, sf_dir).join(f, "unit_id").select("root_id", "facility_id")


@query("scope_views", f"WITH {bind.CTES} SELECT r.unit_id AS root_id, u.unit_id, CASE WHEN u.path = r.path THEN 'self' WHEN starts_with(u.path, r.path || '/') THEN 'descendant' ELSE 'ancestor' END AS relation FROM unit r JOIN unit u ON u.path = r.path OR starts_with(u.path, r.path || '/') OR starts_with(r.path, u.path || '/')")
def scope_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a principal of each scope sees of the hierarchy."""
    m = _lines(spark, sf_dir)
    own = F.col("root_id") == F.col("unit_id")
    up = m.where(~own).select(F.col("unit_id").alias("root_id"), F.col("root_id").alias("unit_id"), F.lit("ancestor").alias("relation"))
    return m.select("root_id", "unit_id", F.when(own, "self").otherwise("descendant").alias("relation")).union(up)


@query("unit_listing", f"WITH {bind.CTES} SELECT unit_id, depth, name FROM unit ORDER BY depth, name LIMIT 10 OFFSET 5")
def unit_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of units."""
    return bind.units(spark, sf_dir).orderBy("depth", "name").offset(5).limit(10).select("unit_id", "depth", "name")


@query("level_counts", f"WITH {bind.CTES} SELECT level, count(*) AS units, count(parent_id) AS with_parent, min(depth) AS depth FROM unit GROUP BY 1")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each level."""
    return bind.units(spark, sf_dir).groupBy("level").agg(F.count("*").alias("units"), F.count("parent_id").alias("with_parent"), F.min("depth").alias("depth"))


@query("hierarchy_validation", f"""WITH {bind.CTES} SELECT u.unit_id, CASE WHEN u.parent_id IS NULL AND u.depth > 0 THEN 'no_parent' WHEN u.depth > 0 AND p.unit_id IS NULL THEN 'unknown_parent' WHEN u.depth > 0 AND u.path <> p.path || '/' || u.unit_id THEN 'wrong_path' WHEN u.depth <> coalesce(p.depth + 1, 0) THEN 'wrong_depth'
WHEN count(*) OVER (PARTITION BY u.parent_id, u.name) > 1 THEN 'duplicate_name' ELSE 'sound' END AS finding FROM unit u LEFT JOIN unit p ON p.unit_id = u.parent_id""")
def hierarchy_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each unit's place in the hierarchy."""
    u = bind.units(spark, sf_dir)
    p = u.select(F.col("unit_id").alias("p_id"), F.col("path").alias("p_path"), F.col("depth").alias("p_depth"))
    twins = F.count("*").over(Window.partitionBy("parent_id", "name"))
    below = F.col("depth") > 0
    finding = F.when(F.col("parent_id").isNull() & below, "no_parent").when(below & F.col("p_id").isNull(), "unknown_parent").when(below & (F.col("path") != F.concat("p_path", F.lit("/"), "unit_id")), "wrong_path").when(F.col("depth") != F.coalesce(F.col("p_depth") + 1, F.lit(0)), "wrong_depth").when(twins > 1, "duplicate_name").otherwise("sound")
    return u.join(p, F.col("parent_id") == F.col("p_id"), "left").select("unit_id", finding.alias("finding"))


@query("area_control_totals", "WITH a AS (SELECT p_brand AS part, p_type AS whole, sum(CAST(p_retailprice AS DECIMAL(18, 2))) AS area FROM part GROUP BY ALL), t AS (SELECT whole, sum(area) AS total FROM a GROUP BY 1) SELECT whole, count(*) AS parts, CAST(sum(area) AS DOUBLE) AS area, bool_and(abs(CAST(total AS DOUBLE)) > 0) AND abs(CAST(sum(area) - max(total) AS DOUBLE)) <= 1e-6 AS agrees FROM a JOIN t USING (whole) GROUP BY 1")
def area_control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the areas of parts add up to that of the whole."""
    p = bind.table(spark, sf_dir, "part").select(F.col("p_brand").alias("part"), F.col("p_type").alias("whole"), F.col("p_retailprice").cast("decimal(18,2)").alias("area"))
    a = p.groupBy("whole", "part").agg(F.sum("area").alias("area"))
    t = p.groupBy("whole").agg(F.sum("area").alias("total"))
    return a.join(t, "whole").groupBy("whole").agg(F.count("*").alias("parts"), F.sum("area").cast("double").alias("area"), ((F.max("total") > 0) & (F.abs(F.sum("area") - F.max("total")) <= F.lit(1e-6))).alias("agrees"))


@query("bounding_boxes", "SELECT c_nationkey AS district_id, min(c_acctbal) AS west, max(c_acctbal) AS east, min(c_custkey) AS south, max(c_custkey) AS north FROM customer GROUP BY 1")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each district's points (the bound tables' two numeric columns stand for coordinates)."""
    return bind.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("district_id")).agg(F.min("c_acctbal").alias("west"), F.max("c_acctbal").alias("east"), F.min("c_custkey").alias("south"), F.max("c_custkey").alias("north"))
