"""Canonical surveillance tables over the driver's star schema.

Each function gives one entity as a DataFrame; CTES has the same rules as SQL text for the checks. Dimensions are small
next to visits, and Spark chooses by their size whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("facility_name"), F.col("s_nationkey").cast("long").alias("district_id"), (F.col("s_acctbal") >= 0).alias("is_active"))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("district_id"), F.col("n_name").alias("district_name"), F.col("r_regionkey").cast("long").alias("region_id"), F.col("r_name").alias("region_name"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy with materialised paths: the nation, its regions, their districts."""
    d = districts(spark, sf_dir)
    root = spark.range(1).select(F.lit("N").alias("unit_id"), F.lit("national").alias("level"), F.lit("NATIONAL").alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit("N").alias("path"), F.lit(0).alias("depth"))
    region = d.select("region_id", "region_name").distinct().select(F.concat(F.lit("R"), "region_id").alias("unit_id"), F.lit("region").alias("level"), F.col("region_name").alias("name"), F.lit("N").alias("parent_id"), F.concat(F.lit("N/R"), "region_id").alias("path"), F.lit(1).alias("depth"))
    leaf = d.select(F.concat(F.lit("D"), "district_id").alias("unit_id"), F.lit("district").alias("level"), F.col("district_name").alias("name"), F.concat(F.lit("R"), "region_id").alias("parent_id"), F.concat(F.lit("N/R"), "region_id", F.lit("/D"), "district_id").alias("path"), F.lit(2).alias("depth"))
    return root.unionByName(region).unionByName(leaf)


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits; the facility follows from the key and the number of facilities, a subquery."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "supplier").select(F.count("*")).scalar()
    attendance = F.when(F.col("o_orderstatus") == "F", "new").when(F.col("o_orderstatus") == "O", "re").otherwise("unknown")
    fever = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "yes").when(F.substring("o_orderpriority", 1, 1) == "4", "unknown").otherwise("no")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("encounter_id"), F.col("o_orderdate").cast("date").alias("encounter_date"), F.col("o_custkey").alias("patient_id"), F.col("c_nationkey").cast("long").alias("residence_id"), (F.col("o_orderkey") % n).alias("facility_id"), attendance.alias("attendance"), fever.alias("fever"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))


def months(spark: SparkSession, sf_dir: str) -> Column:
    """The months from the first visit to the last, by subqueries on their dates."""
    d = table(spark, sf_dir, "orders").select(F.trunc(F.min("o_orderdate").cast("date"), "month").alias("a"), F.trunc(F.max("o_orderdate").cast("date"), "month").alias("b"))
    return F.sequence(d.select("a").scalar(), d.select("b").scalar(), F.expr("INTERVAL 1 MONTH"))


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("l_returnflag") == "N", "not_done").when(F.col("l_linestatus") == "F", "rdt").otherwise("microscopy")
    result = F.when(F.col("l_returnflag") == "R", "positive").when(F.col("l_returnflag") == "A", "negative").otherwise("unknown")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), method.alias("method"), result.alias("result"))


def prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    named = l.join(p, l.l_partkey == p.p_partkey)
    return named.select(F.col("l_orderkey").alias("encounter_id"), F.when(F.col("l_tax") != 0, F.col("p_name")).alias("drug_name"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests and prescriptions of visits as one row a line: a line without a medicine of the catalogue prescribes nothing."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    method = F.when(F.col("l_returnflag") == "N", "not_done").when(F.col("l_linestatus") == "F", "rdt").otherwise("microscopy")
    result = F.when(F.col("l_returnflag") == "R", "positive").when(F.col("l_returnflag") == "A", "negative").otherwise("unknown")
    return l.join(p, l.l_partkey == p.p_partkey, "left").select(F.col("l_orderkey").alias("encounter_id"), method.alias("method"), result.alias("result"), F.when(F.col("l_tax") != 0, F.col("p_name")).alias("drug_name"), F.col("p_partkey").isNotNull().alias("prescribed"))


#: Fixed value: the stems that stand for the first-line medicines in the bound tables.
ANTIMALARIAL = "(ring|bolt)"


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commodity observations by district of the supplier and month; blank where nothing was reported."""
    l, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    metric = F.when(F.col("l_linenumber") == 1, "on_hand").when(F.col("l_linenumber") == 2, "received").when(F.col("l_linenumber") == 3, "days_out").otherwise("consumed")
    return l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey).select(F.col("l_suppkey").alias("facility_id"), F.col("s_nationkey").cast("long").alias("district_id"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), F.col("p_brand").alias("commodity"), metric.alias("metric"), F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("long")).alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("ts").cast("date").alias("day"), F.col("user_id").alias("patient_id"), F.col("event_type"), F.col("value"), "props")


CTES = """
facility AS (SELECT s_suppkey AS facility_id, s_name AS facility_name, CAST(s_nationkey AS BIGINT) AS district_id, s_acctbal >= 0 AS is_active FROM supplier),
district AS (SELECT CAST(n_nationkey AS BIGINT) AS district_id, n_name AS district_name, CAST(r_regionkey AS BIGINT) AS region_id, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey),
unit AS (SELECT 'N' AS unit_id, 'national' AS level, 'NATIONAL' AS name, NULL AS parent_id, 'N' AS path, 0 AS depth
  UNION ALL SELECT DISTINCT 'R' || region_id, 'region', region_name, 'N', 'N/R' || region_id, 1 FROM district
  UNION ALL SELECT 'D' || district_id, 'district', district_name, 'R' || region_id, 'N/R' || region_id || '/D' || district_id, 2 FROM district),
encounter AS (SELECT o_orderkey AS encounter_id, CAST(o_orderdate AS DATE) AS encounter_date, o_custkey AS patient_id, CAST(c_nationkey AS BIGINT) AS residence_id, o_orderkey % (SELECT count(*) FROM supplier) AS facility_id,
  CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 're' ELSE 'unknown' END AS attendance,
  CASE WHEN o_orderpriority[1:1] IN ('1', '2') THEN 'yes' WHEN o_orderpriority[1:1] = '4' THEN 'unknown' ELSE 'no' END AS fever,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders JOIN customer ON o_custkey = c_custkey),
test AS (SELECT l_orderkey AS encounter_id, CASE WHEN l_returnflag = 'N' THEN 'not_done' WHEN l_linestatus = 'F' THEN 'rdt' ELSE 'microscopy' END AS method,
  CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'A' THEN 'negative' ELSE 'unknown' END AS result FROM lineitem),
rx AS (SELECT l_orderkey AS encounter_id, CASE WHEN l_tax <> 0 THEN p_name END AS drug_name FROM lineitem JOIN part ON l_partkey = p_partkey),
stock AS (SELECT l_suppkey AS facility_id, CAST(s_nationkey AS BIGINT) AS district_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, p_brand AS commodity,
  CASE l_linenumber WHEN 1 THEN 'on_hand' WHEN 2 THEN 'received' WHEN 3 THEN 'days_out' ELSE 'consumed' END AS metric, CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS BIGINT) END AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
event AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id AS patient_id, event_type, value, props FROM events)
"""
