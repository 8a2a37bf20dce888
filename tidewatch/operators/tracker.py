"""Tracker events to canonical encounters: revisions, concepts of open payloads, and parents of visits, tests and medicines.

A payload is any set of keys. A key becomes a concept by a mapping table (a join, not code), and an event's concepts become
one map again. What cannot be taken is kept with its reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.registry import query
from tidewatch.sources import bind

#: Event type, payload key, concept. Types without a row are not mapped.
MAPPING = (("error", "k", "parasite_count"), ("purchase", "k", "doses"), ("view", "k", "temperature"))
KINDS = {"error": "test", "purchase": "medicine", "view": "visit"}
POSITIVE = 50


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under their latest revision: two event ids that follow each other, of even and odd number, revise one event."""
    e = bind.table(spark, sf_dir, "events").withColumn("external_id", F.col("event_id") - F.col("event_id") % 2)
    last = F.max_by(F.struct("event_id", "ts", "user_id", "event_type", "props"), F.struct("ts", "event_id"))
    return e.groupBy("external_id").agg(last.alias("e"), F.count("*").alias("revisions")).select("external_id", "revisions", "e.*")


def translated(spark: SparkSession, sf_dir: str, mapping: tuple = MAPPING) -> DataFrame:
    """latest() with concepts (a map) and reason: why an event is refused, or null."""
    e = latest(spark, sf_dir)
    m = spark.createDataFrame(list(mapping), "event_type string, key string, concept string")
    parts = e.select("external_id", "event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    pairs = parts.join(F.broadcast(m), ["event_type", "key"]).where("value IS NOT NULL")
    concepts = pairs.groupBy("external_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("concept", "value")))).alias("concepts"))
    known = F.array(*(F.lit(t) for t, _, _ in mapping))
    number = F.element_at(F.map_values("concepts"), 1)
    reason = F.when(F.col("user_id").isNull() | (F.col("user_id") % 50 == 0), "no_person").when(~F.array_contains(known, F.col("event_type")), "type_not_mapped").when(F.col("concepts").isNull(), "no_mapped_concept").when(number.try_cast("bigint").isNull(), "not_a_number")
    return e.join(concepts, "external_id", "left").withColumn("reason", reason)


_LATEST = """lt AS (SELECT event_id - event_id % 2 AS external_id, count(*) AS revisions, max({'t': ts, 'i': event_id, 'u': user_id, 'y': event_type, 'p': props}) AS e FROM events GROUP BY 1),
mp(event_type, key, concept) AS (VALUES """ + ", ".join(f"('{t}', '{k}', '{c}')" for t, k, c in MAPPING) + """),
tl AS (SELECT external_id, revisions, e.i AS event_id, e.t AS ts, e.u AS user_id, e.y AS event_type, mp.concept, json_extract_string(e.p, '$.' || mp.key) AS value FROM lt LEFT JOIN mp ON mp.event_type = e.y),
tr AS MATERIALIZED (SELECT *, CASE WHEN user_id IS NULL OR user_id % 50 = 0 THEN 'no_person' WHEN concept IS NULL THEN 'type_not_mapped' WHEN value IS NULL THEN 'no_mapped_concept' WHEN TRY_CAST(value AS BIGINT) IS NULL THEN 'not_a_number' END AS reason FROM tl)"""


@query("tracker_rows", f"WITH {_LATEST} SELECT external_id, event_id, revisions, event_type, CASE WHEN reason IS NULL THEN concept || '=' || value END AS concepts, reason FROM tr")
def tracker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the tracker with their concepts, or the reason for which they are refused."""
    t = translated(spark, sf_dir)
    text = F.array_join(F.transform(F.map_entries("concepts"), lambda x: F.concat(x.key, F.lit("="), x.value)), ",")
    return t.select("external_id", "event_id", "revisions", "event_type", F.when(F.col("reason").isNull(), text).alias("concepts"), "reason")


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are taken: kind, parent (person and day) and number."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    t = translated(spark, sf_dir).where("reason IS NULL")
    return t.select("external_id", "user_id", F.col("ts").cast("date").alias("day"), kind.alias("kind"), F.element_at(F.map_values("concepts"), 1).cast("bigint").alias("number"))


_TAKEN = _LATEST + """, tk AS MATERIALIZED (SELECT external_id, user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN 'test' WHEN 'purchase' THEN 'medicine' ELSE 'visit' END AS kind, CAST(value AS BIGINT) AS number FROM tr WHERE reason IS NULL),
pn AS MATERIALIZED (SELECT DISTINCT user_id FROM tk WHERE kind = 'test')"""


@query("tracker_encounters", f"WITH {_TAKEN} SELECT user_id AS person, day, CASE WHEN count(*) FILTER (kind = 'test') > 0 THEN 'tested' ELSE 'visit_only' END AS kind, count(*) FILTER (kind = 'test') AS tests, count(*) FILTER (kind = 'test' AND number >= {POSITIVE}) AS positives, count(*) FILTER (kind = 'visit') AS visits, CASE WHEN count(*) FILTER (kind = 'test') > 0 THEN coalesce(sum(number) FILTER (kind = 'medicine'), 0) ELSE 0 END AS doses FROM tk WHERE user_id IN (SELECT user_id FROM pn) GROUP BY 1, 2 HAVING count(*) FILTER (kind <> 'medicine') > 0")
def tracker_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters of persons with a test: tests of a person and day, the visits and medicines of the same parent, and days with a
    visit only. One grouping by parent takes the place of joins of the three kinds."""
    t = _taken(spark, sf_dir)
    n = lambda k: F.count_if(F.col("kind") == k)
    g = t.groupBy("user_id", "day").agg(n("test").alias("tests"), F.count_if((F.col("kind") == "test") & (F.col("number") >= POSITIVE)).alias("positives"), n("visit").alias("visits"), F.sum(F.when(F.col("kind") == "medicine", F.col("number"))).alias("given"))
    g = g.where("tests + visits > 0").join(t.where("kind = 'test'").select("user_id").distinct(), "user_id", "left_semi")
    tested = F.col("tests") > 0
    return g.select(F.col("user_id").alias("person"), "day", F.when(tested, "tested").otherwise("visit_only").alias("kind"), "tests", "positives", "visits", F.when(tested, F.coalesce("given", F.lit(0))).otherwise(0).alias("doses"))


@query("tracker_unlinked", f"WITH {_TAKEN} SELECT external_id, user_id AS person, day FROM tk m WHERE kind = 'medicine' AND NOT EXISTS (SELECT 1 FROM tk t WHERE t.kind = 'test' AND t.user_id = m.user_id AND t.day = m.day)")
def tracker_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medicines without a test of the same person and day."""
    t = _taken(spark, sf_dir)
    tests = t.where("kind = 'test'").select("user_id", "day").distinct()
    return t.where("kind = 'medicine'").join(tests, ["user_id", "day"], "left_anti").select("external_id", F.col("user_id").alias("person"), "day")
