"""Joins of periods that overlap, and of the period in force at a date, without comparing all periods of a key.

Periods have any lengths. A period lies in at most two cells of the grid whose cells are no shorter than it; it goes there,
and on the side of the shorter period also to its cells of the coarser grids that the other side uses. A pair thus meets in
the grid of its longer period, and the cell that holds the later start gives it, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import flags
from tidewatch.plans.registry import query
from tidewatch.sources import bind


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All columns of a and b (keys, starts, ends: dates, inclusive; b's come as b_starts, b_ends) where keys are equal and the
    periods share a day. Periods that end before they start, or lack a date, overlap nothing."""
    b = b.withColumnsRenamed({"starts": "b_starts", "ends": "b_ends"})

    def level(s: str, e: str) -> Column:
        return F.ceil(F.log2(F.date_diff(F.col(e), F.col(s)) + 1.0)).cast("int")

    a = a.where("starts <= ends").withColumn("a_level", level("starts", "ends"))
    b = b.where("b_starts <= b_ends").withColumn("b_level", level("b_starts", "b_ends"))

    def celled(rows: DataFrame, s: str, e: str) -> DataFrame:
        cell = lambda c: F.expr(f"shiftright(unix_date({c}), grid)")
        return rows.withColumn("cell", F.explode(F.sequence(cell(s), cell(e))))

    def coarser(rows: DataFrame, own: str, other: DataFrame, its: str, least: int) -> DataFrame:
        used = other.select(F.coalesce(F.collect_set(its), F.array().cast("array<int>"))).scalar()
        return rows.withColumn("used", used).withColumn("grid", F.explode("used")).where(F.col("grid") >= F.col(own) + least).drop("used")

    on = [*keys, "grid", "cell"]
    own = lambda rows, level: rows.withColumn("grid", F.col(level))
    long_a = celled(own(a, "a_level"), "starts", "ends").join(celled(coarser(b, "b_level", a, "a_level", 0), "b_starts", "b_ends"), on)
    long_b = celled(coarser(a, "a_level", b, "b_level", 1), "starts", "ends").join(celled(own(b, "b_level"), "b_starts", "b_ends"), on)
    m = long_a.unionByName(long_b)
    first = F.col("cell") == F.expr("shiftright(unix_date(greatest(starts, b_starts)), grid)")
    share = (F.col("starts") <= F.col("b_ends")) & (F.col("b_starts") <= F.col("ends"))
    return m.where(first & share).drop("grid", "cell", "a_level", "b_level")


def in_force(rows: DataFrame, periods: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with `value` of the period (key, starts, value) of their key that started last by `at`, or null; of several that
    start on a day the largest value. One sort by key and date, for rows and periods together."""
    p = periods.groupBy(key, F.col("starts").alias(at)).agg(F.max(value).alias(value)).withColumn("is_row", F.lit(False))
    both = p.unionByName(rows.withColumn("is_row", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "is_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(F.when(~F.col("is_row"), F.col(value)), ignorenulls=True).over(order)).where("is_row").drop("is_row")


_GRAINS = ("day", "week", "month")


def _period(day: Column, grain: str) -> tuple[Column, Column]:
    if grain == "day":
        return day, day
    start = F.date_trunc(grain, day).cast("date")
    return start, F.date_add(start, 6) if grain == "week" else F.last_day(start)


def stock_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of stock at three grains: empty shelves of days, blanks of whole weeks, days out of months."""
    l, p = bind.table(spark, sf_dir, "lineitem"), bind.table(spark, sf_dir, "part")
    d = l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("facility_id"), F.col("p_brand").alias("commodity"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_linenumber").alias("n"), F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("value"))

    def facts(grain: str, name: str, having: Column) -> DataFrame:
        starts, ends = _period(F.col("day"), grain)
        g = d.groupBy("facility_id", "commodity", starts.alias("starts"), ends.alias("ends")).agg(F.sum(F.when(F.col("n") == 3, F.col("value"))).alias("out"), F.min(F.when(F.col("n") == 1, F.col("value"))).alias("hand"), F.count("value").alias("reported"))
        return g.where(having).select("facility_id", "commodity", "starts", "ends", F.lit(name).alias("fact"))

    return facts("day", "low_on_hand", F.col("hand") <= 2).union(facts("week", "blank_week", F.col("reported") == 0)).union(facts("month", "days_out", F.col("out") > 0))


_FACTS = """d AS (SELECT l_suppkey AS facility_id, p_brand AS commodity, CAST(l_shipdate AS DATE) AS day, l_linenumber AS n, CASE WHEN l_tax <> 0 THEN l_quantity END AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
sf AS (SELECT facility_id, commodity, day AS starts, day AS ends, 'low_on_hand' AS fact FROM d GROUP BY ALL HAVING min(value) FILTER (n = 1) <= 2
  UNION ALL SELECT facility_id, commodity, CAST(date_trunc('week', day) AS DATE), CAST(date_trunc('week', day) AS DATE) + 6, 'blank_week' FROM d GROUP BY ALL HAVING count(value) = 0
  UNION ALL SELECT facility_id, commodity, CAST(date_trunc('month', day) AS DATE), last_day(day), 'days_out' FROM d GROUP BY ALL HAVING sum(value) FILTER (n = 3) > 0),
mp AS (SELECT facility_id, 'week' AS grain, CAST(date_trunc('week', encounter_date) AS DATE) AS starts, CAST(date_trunc('week', encounter_date) AS DATE) + 6 AS ends, count(*) FILTER (confirmed) AS confirmed FROM visit GROUP BY ALL
  UNION ALL SELECT facility_id, 'month', month, last_day(month), count(*) FILTER (confirmed) FROM visit GROUP BY ALL)"""


def measured_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed visits of facilities by week and by month."""
    v = flags.visits(spark, sf_dir).select("facility_id", F.col("encounter_date").alias("day"), "confirmed")
    g = v.select("*", F.explode(F.array(*(F.struct(F.lit(x).alias("grain"), *(c.alias(n) for c, n in zip(_period(F.col("day"), x), ("starts", "ends"), strict=True))) for x in _GRAINS[1:]))).alias("p"))
    return g.groupBy("facility_id", "p.grain", "p.starts", "p.ends").agg(F.count_if("confirmed").alias("confirmed"))


@query("overlapping_stock_facts", f"""WITH {flags.CTES}, {_FACTS} SELECT m.facility_id, grain, m.starts, confirmed, count(*) AS facts, count(*) FILTER (fact = 'low_on_hand') AS low_days, count(*) FILTER (fact = 'blank_week') AS blank_weeks, count(*) FILTER (fact = 'days_out') AS months_out, min(f.starts) AS first_start, max(f.ends) AS last_end
FROM mp m JOIN sf f ON f.facility_id = m.facility_id AND f.starts <= m.ends AND f.ends >= m.starts GROUP BY ALL""")
def overlapping_stock_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every week and month of a facility, the stock facts of days, weeks and months that overlap it."""
    m = overlapping(measured_periods(spark, sf_dir), stock_facts(spark, sf_dir), ["facility_id"])
    of = lambda f: F.count_if(F.col("fact") == f)
    return m.groupBy("facility_id", "grain", "starts", "confirmed").agg(F.count("*").alias("facts"), of("low_on_hand").alias("low_days"), of("blank_week").alias("blank_weeks"), of("days_out").alias("months_out"), F.min("b_starts").alias("first_start"), F.max("b_ends").alias("last_end"))


@query("overlapping_episodes", f"""WITH {bind.CTES}, p AS (SELECT facility_id, patient_id, min(encounter_date) AS starts, max(encounter_date) AS ends FROM encounter GROUP BY ALL), b AS (SELECT facility_id, make_date(y, 1, 1) AS starts, make_date(y, 12, 31) AS ends FROM (SELECT DISTINCT facility_id, CAST(extract(year FROM encounter_date) AS INTEGER) AS y FROM encounter))
SELECT b.facility_id, b.starts, count(*) AS overlapping, count(*) FILTER (p.starts >= b.starts AND p.ends <= b.ends) AS contained FROM p JOIN b ON b.facility_id = p.facility_id AND p.starts <= b.ends AND p.ends >= b.starts GROUP BY ALL""")
def overlapping_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of patients at a facility, from a day to many years, by the facility's years: those that overlap a year and those
    that lie within it."""
    e = bind.encounters(spark, sf_dir)
    spells = e.groupBy("facility_id", "patient_id").agg(F.min("encounter_date").alias("starts"), F.max("encounter_date").alias("ends"))
    y = e.select("facility_id", F.year("encounter_date").alias("y")).distinct()
    years = y.select("facility_id", F.make_date("y", F.lit(1), F.lit(1)).alias("starts"), F.make_date("y", F.lit(12), F.lit(31)).alias("ends"))
    m = overlapping(spells, years, ["facility_id"])
    inside = (F.col("starts") >= F.col("b_starts")) & (F.col("ends") <= F.col("b_ends"))
    return m.groupBy("facility_id", F.col("b_starts").alias("starts")).agg(F.count("*").alias("overlapping"), F.count_if(inside).alias("contained"))
