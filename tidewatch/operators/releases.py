"""Releases of a geography merged into stable units: revisions, aliases, deactivation, one published release, as-of reads.

A release lists units by code. A unit keeps its identity over all releases; each release that changes it makes a revision,
and one that lacks it deactivates it, nothing is deleted. A release is merged by one join with the state before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as fn
from tidewatch.plans.registry import query
from tidewatch.sources import bind

STATE = "code string, name string, parent string, active boolean, geometry boolean"


def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version, code, name, parent, geometry of three releases over facilities and districts: some units come late or are left
    out for a release, some are renamed, some move to another district, and some have no boundary."""
    f, k = bind.facilities(spark, sf_dir), F.col("facility_id")
    v = F.col("version")
    x = f.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("version"))
    there = ((v == 1) & (k % 5 != 4)) | ((v == 2) & (k % 7 != 3)) | ((v == 3) & (k % 11 != 5))
    name = F.when((v >= 2) & (k % 6 == 2), F.concat("facility_name", F.lit(" (new)"))).otherwise(F.col("facility_name"))
    # In release 3 some units name a parent that no release has: it is merged but cannot be published.
    parent = F.when((v == 3) & (k % 9 == 0), F.concat(F.lit("D"), F.when(k % 27 == 0, F.lit(999)).otherwise((F.col("district_id") + 1) % 25))).otherwise(F.concat(F.lit("D"), "district_id"))
    return x.where(there).select(v.alias("version"), F.concat(F.lit("F"), k).alias("code"), name.alias("name"), parent.alias("parent"), (k % 4 != 1).alias("geometry"))


_REL = """rl AS MATERIALIZED (SELECT version, 'F' || facility_id AS code, CASE WHEN version >= 2 AND facility_id % 6 = 2 THEN facility_name || ' (new)' ELSE facility_name END AS name,
  CASE WHEN version = 3 AND facility_id % 9 = 0 THEN 'D' || CASE WHEN facility_id % 27 = 0 THEN 999 ELSE (district_id + 1) % 25 END ELSE 'D' || district_id END AS parent, facility_id % 4 <> 1 AS geometry
  FROM facility, (VALUES (1), (2), (3)) t(version) WHERE version = 1 AND facility_id % 5 <> 4 OR version = 2 AND facility_id % 7 <> 3 OR version = 3 AND facility_id % 11 <> 5),
gr AS (SELECT c.code, v.version, rl.name, rl.parent, rl.geometry, rl.code IS NOT NULL AS here FROM (SELECT DISTINCT code FROM rl) c CROSS JOIN (VALUES (1), (2), (3)) v(version) LEFT JOIN rl ON rl.code = c.code AND rl.version = v.version),
hs AS (SELECT *, lag(here) OVER w AS was, bool_or(here) OVER (PARTITION BY code ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever, last_value(name IGNORE NULLS) OVER p AS old_name, last_value(parent IGNORE NULLS) OVER p AS old_parent, last_value(geometry IGNORE NULLS) OVER p AS old_geometry FROM gr WINDOW w AS (PARTITION BY code ORDER BY version), p AS (PARTITION BY code ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rv AS MATERIALIZED (SELECT version, code, coalesce(name, old_name) AS name, coalesce(parent, old_parent) AS parent, coalesce(geometry, old_geometry) AS geometry, here AS active, CASE WHEN here AND NOT coalesce(ever, false) THEN 'new' WHEN here AND NOT was THEN 'reactivated' WHEN NOT here AND was THEN 'deactivated' WHEN name <> old_name AND parent <> old_parent THEN 'renamed_and_moved' WHEN name <> old_name THEN 'renamed' WHEN parent <> old_parent THEN 'moved' ELSE 'unchanged' END AS change, old_name
  FROM hs WHERE here OR coalesce(ever, false))"""


def merged(state: DataFrame, release: DataFrame) -> DataFrame:
    """What a release (code, name, parent, geometry) makes of the units before it (STATE): the new state of every unit, with its
    change and the name that it had."""
    old = state.select("code", *(F.col(c).alias(f"old_{c}") for c in ("name", "parent", "geometry", "active")), F.lit(True).alias("known"))
    m = old.join(release.select("code", "name", "parent", "geometry", F.lit(True).alias("here")), "code", "full")
    here, known, was = (F.coalesce(c, F.lit(False)) for c in ("here", "known", "old_active"))
    renamed, moved = F.col("name") != F.col("old_name"), F.col("parent") != F.col("old_parent")
    change = F.when(here & ~known, "new").when(here & ~was, "reactivated").when(~here & was, "deactivated").when(renamed & moved, "renamed_and_moved").when(renamed, "renamed").when(moved, "moved").otherwise("unchanged")
    return m.select("code", *(F.coalesce(c, f"old_{c}").alias(c) for c in ("name", "parent", "geometry")), here.alias("active"), change.alias("change"), "old_name")


def history(releases: DataFrame, versions: list[int]) -> DataFrame:
    """version, code, name, parent, geometry, active, change, old_name of every unit after every release, in the order of `versions`."""
    state, out = releases.sparkSession.createDataFrame([], STATE), None
    for v in versions:
        now = merged(state, releases.where(F.col("version") == v))
        state = now.select("code", "name", "parent", "active", "geometry")
        now = now.withColumn("version", F.lit(v))
        out = now if out is None else out.unionByName(now)
    return out


VERSIONS = [1, 2, 3]


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(bound(spark, sf_dir), VERSIONS)


@query("geography_revisions", f"WITH {bind.CTES}, {_REL} SELECT version, code, name, parent, active, change FROM rv WHERE change <> 'unchanged'")
def geography_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each release did to each unit that it changed."""
    return revisions(spark, sf_dir).where("change <> 'unchanged'").select("version", "code", "name", "parent", "active", "change")


@query("geography_aliases", f"WITH {bind.CTES}, {_REL} SELECT code, trim(regexp_replace(regexp_replace(regexp_replace(upper(old_name), '\\([^)]*\\)', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS alias, min(version) AS since FROM rv WHERE active AND old_name IS NOT NULL AND old_name <> name GROUP BY ALL")
def geography_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, normalised, that units had before a release renamed them."""
    r = revisions(spark, sf_dir).where("active AND old_name <> name")
    return r.groupBy("code", fn.place_name(F.col("old_name")).alias("alias")).agg(F.min("version").alias("since"))


@query("units_as_of", f"WITH {bind.CTES}, {_REL} SELECT version, code, name, parent FROM rv WHERE active")
def units_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that are in force in every release, as it has them."""
    return revisions(spark, sf_dir).where("active").select("version", "code", "name", "parent")


_PUB = "pb AS (SELECT version, count(*) FILTER (active) AS units, count(*) FILTER (active AND substr(parent, 2) NOT IN (SELECT CAST(district_id AS VARCHAR) FROM district)) AS blocking, count(*) FILTER (change = 'deactivated') AS deactivated FROM rv GROUP BY 1)"


@query("published_release", f"WITH {bind.CTES}, {_REL}, {_PUB} SELECT version, units, blocking, deactivated, CASE WHEN blocking > 0 THEN 'refused' WHEN version = max(version) FILTER (blocking = 0) OVER () THEN 'published' ELSE 'superseded' END AS status FROM pb")
def published_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases with what blocks them; the newest sound one is published, the others are superseded or refused."""
    d = bind.districts(spark, sf_dir).select(F.concat(F.lit("D"), "district_id").alias("parent"), F.lit(True).alias("known"))
    r = revisions(spark, sf_dir).join(d, "parent", "left")
    p = r.groupBy("version").agg(F.count_if("active").alias("units"), F.count_if(F.col("active") & F.col("known").isNull()).alias("blocking"), F.count_if(F.col("change") == "deactivated").alias("deactivated"))
    newest = F.max(F.when(F.col("blocking") == 0, F.col("version"))).over(Window.partitionBy(F.lit(1)))  # a row a release
    return p.select("version", "units", "blocking", "deactivated", F.when(F.col("blocking") > 0, "refused").when(F.col("version") == newest, "published").otherwise("superseded").alias("status"))


@query("level_geometry", f"WITH {bind.CTES}, {_REL} SELECT version, parent, count(*) AS units, count(*) FILTER (geometry) AS with_geometry FROM rv WHERE active GROUP BY 1, 2")
def level_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units of each parent have a boundary, by release: units and boundaries meet on unit and release."""
    r = revisions(spark, sf_dir).where("active")
    shapes = bound(spark, sf_dir).where("geometry").select("version", "code", F.lit(True).alias("shape"))
    return r.join(shapes, ["version", "code"], "left").groupBy("version", "parent").agg(F.count("*").alias("units"), F.count("shape").alias("with_geometry"))
