"""Baselines, anomalies, persistence, hotspots and clusters over monthly series of districts.

All target periods are evaluated at once: a range window over the months of a series gives each point the K months before
it, so one shuffle by series replaces a query for every target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import flags, geometry, graph, spatial, stored
from tidewatch.plans.registry import query
from tidewatch.sources import bind


@dataclass(frozen=True)
class BaselineRule:
    """Approved parameters; a missing one makes a refusal row instead of a judgement."""

    periods: int | None = 6
    minimum_periods: int | None = 3
    minimum_completeness: float | None = 0.5
    multiplier: float | None = 2.0
    threshold: float | None = 2.0
    minimum_count: int | None = 5

    def missing(self) -> list[str]:
        return sorted(k for k, v in self.__dict__.items() if v is None)


RULE = BaselineRule()


MICRO = 1e6


def refusal(spark: SparkSession, rule: BaselineRule) -> DataFrame | None:
    """A row that names the missing parameters, or None."""
    return spark.range(1).select(F.lit("not_configured").alias("status"), F.lit(",".join(rule.missing())).alias("missing")) if rule.missing() else None


def median_of(values: Column) -> Column:
    """The median of a short array of numbers."""
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)


def looked_back(series: DataFrame, keys: list[str], months: int) -> DataFrame:
    """series with history: the available values of the months before, in millionths, for every point.

    A range window over the month's number, so the series is made and shuffled once. Whole millionths keep halves
    exact, so that half-even rounding does not depend on how a mean was summed up.
    """
    number = (F.year("month") * 12 + F.month("month")).cast("long")
    past = Window.partitionBy(*keys).orderBy(number).rangeBetween(-months, -1)
    return series.withColumn("history", F.collect_list(F.round(F.col("value") * MICRO)).over(past))


def baselines(series: DataFrame, keys: list[str], rule: BaselineRule = RULE) -> DataFrame:
    b = looked_back(series, keys, rule.periods)
    n = F.size("history")
    enough = F.when(n == 0, "no_history").when(n < rule.minimum_periods, "insufficient_history").when(n / F.lit(float(rule.periods)) < rule.minimum_completeness, "insufficient_completeness").otherwise("sufficient")
    b = b.withColumns({"used": n, "sufficiency": enough, "middle": median_of(F.col("history"))})
    b = b.withColumn("deviation", median_of(F.transform("history", lambda x: F.abs(x - F.col("middle")))))
    ok = F.col("sufficiency") == "sufficient"
    e, s = F.when(ok, F.bround("middle", 0)), F.when(ok & (n > 1), F.bround("deviation", 0))
    b = b.withColumns({"e": e, "s": s})
    band = lambda sign: F.bround(F.col("e") + sign * rule.multiplier * F.col("s"), 0) / MICRO
    return b.withColumns({"expected": F.col("e") / MICRO, "spread": F.col("s") / MICRO, "lower": band(-1), "upper": band(1)}).drop("middle", "deviation", "history", "e", "s")


def series(spark: SparkSession, sf_dir: str, visits: DataFrame | None = None) -> DataFrame:
    return spatial.by_facility(spark, sf_dir, visits).select("district_id", "month", "denominator", "value")


_SERIES = f"""c AS (SELECT facility_id, month, count(*) FILTER (confirmed) AS n, count(*) FILTER (tested) AS d FROM visit GROUP BY ALL), g AS (SELECT district_id, month, sum(n) AS n, CAST(sum(d) AS BIGINT) AS denominator FROM c JOIN facility USING (facility_id) WHERE is_active GROUP BY ALL),
s AS (SELECT district_id, month, denominator, CASE WHEN denominator > 0 THEN round_even(CAST(n AS DOUBLE) / CAST(denominator AS DOUBLE), 6) END AS value FROM g),
h AS (SELECT t.district_id, t.month, t.denominator, t.value, list(round(p.value * 1e6)) FILTER (p.value IS NOT NULL) AS h FROM s t LEFT JOIN s p ON p.district_id = t.district_id AND p.month < t.month AND p.month >= CAST(t.month - INTERVAL 6 MONTH AS DATE) GROUP BY ALL),
b0 AS (SELECT * EXCLUDE (h), coalesce(len(h), 0) AS used, CASE WHEN coalesce(len(h), 0) = 0 THEN 'no_history' WHEN len(h) < 3 THEN 'insufficient_history' WHEN len(h) / 6.0 < 0.5 THEN 'insufficient_completeness' ELSE 'sufficient' END AS sufficiency, list_aggregate(h, 'median') AS m, list_aggregate(h, 'mad') AS mad FROM h),
b1 AS (SELECT *, CASE WHEN sufficiency = 'sufficient' THEN round_even(m, 0) END AS e, CASE WHEN sufficiency = 'sufficient' AND used > 1 THEN round_even(mad, 0) END AS sp FROM b0),
b AS (SELECT * EXCLUDE (m, mad, e, sp), e / 1e6::DOUBLE AS expected, sp / 1e6::DOUBLE AS spread, round_even(e - 2.0::DOUBLE * sp, 0) / 1e6::DOUBLE AS lower, round_even(e + 2.0::DOUBLE * sp, 0) / 1e6::DOUBLE AS upper FROM b1)"""


@query("baseline", f"WITH {flags.CTES}, {_SERIES} SELECT district_id, month, used, sufficiency, expected, spread, lower, upper FROM b")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and MAD of the six months before, with the reason where there is none."""
    return baselines(series(spark, sf_dir), ["district_id"]).select("district_id", "month", F.col("used").cast("long").alias("used"), "sufficiency", "expected", "spread", "lower", "upper")


def judged(b: DataFrame, rule: BaselineRule = RULE) -> DataFrame:
    """outcome, score and direction; reasons come in a fixed order, and a method that cannot apply is never replaced."""
    x, e, s = F.col("value"), F.col("expected"), F.col("spread")
    score = F.when(s > 0, F.bround(F.abs(x - e) / F.nullif(s, F.lit(0.0)), 6))
    outcome = F.when(x.isNull(), "no_observation").when(F.col("sufficiency") != "sufficient", "no_baseline").when(F.col("denominator").isNull(), "count_unknown").when(F.col("denominator") < rule.minimum_count, "below_minimum").when(score.isNull(), "method_inapplicable").when(score >= rule.threshold, "flagged").otherwise("not_flagged")
    return b.withColumns({"score": score, "outcome": outcome, "direction": F.when(outcome == "flagged", F.when(x > e, "increase").otherwise("decrease"))})


_JUDGED = """j0 AS (SELECT *, CASE WHEN spread > 0 THEN round_even(abs(value - expected) / spread, 6) END AS score FROM b),
j1 AS (SELECT *, CASE WHEN value IS NULL THEN 'no_observation' WHEN sufficiency <> 'sufficient' THEN 'no_baseline' WHEN denominator IS NULL THEN 'count_unknown' WHEN denominator < 5 THEN 'below_minimum' WHEN score IS NULL THEN 'method_inapplicable' WHEN score >= 2.0 THEN 'flagged' ELSE 'not_flagged' END AS outcome FROM j0),
j AS (SELECT *, CASE WHEN outcome = 'flagged' THEN CASE WHEN value > expected THEN 'increase' ELSE 'decrease' END END AS direction FROM j1)"""


@query("anomaly", f"WITH {flags.CTES}, {_SERIES}, {_JUDGED} SELECT district_id, month, value, expected, score, outcome, direction FROM j")
def anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust z scores against the baseline."""
    return judged(baselines(series(spark, sf_dir), ["district_id"])).select("district_id", "month", "value", "expected", "score", "outcome", "direction")


@query("anomaly_persistence", f"""WITH {flags.CTES}, {_SERIES}, {_JUDGED}, f AS (SELECT district_id, month, extract(year FROM month) * 12 + extract(month FROM month) - row_number() OVER (PARTITION BY district_id ORDER BY month) AS island FROM j WHERE outcome = 'flagged')
SELECT district_id, min(month) AS first_month, max(month) AS last_month, count(*) AS periods, count(*) >= 2 AS sustained FROM f GROUP BY district_id, island""")
def anomaly_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of flagged months without a gap."""
    f = judged(baselines(series(spark, sf_dir), ["district_id"])).where("outcome = 'flagged'").select("district_id", "month")
    island = F.year("month") * 12 + F.month("month") - F.row_number().over(Window.partitionBy("district_id").orderBy("month"))
    return f.withColumn("island", island).groupBy("district_id", "island").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("periods"), (F.count("*") >= 2).alias("sustained")).drop("island")


_MEAN = """m0 AS (SELECT district_id, month, denominator, value, coalesce(len(h), 0) AS used, CASE WHEN len(h) >= 3 THEN round_even(list_aggregate(h, 'avg'), 0) / 1e6::DOUBLE END AS expected, CASE WHEN len(h) >= 3 THEN round_even(list_aggregate(h, 'stddev_samp'), 0) / 1e6::DOUBLE END AS spread FROM h)"""


@query("baseline_mean", f"WITH {flags.CTES}, {_SERIES}, {_MEAN} SELECT district_id, month, used, expected, spread FROM m0")
def baseline_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation of the months before, by a range window over the month's number."""
    number = (F.year("month") * 12 + F.month("month")).cast("long")
    past = Window.partitionBy("district_id").orderBy(number).rangeBetween(-RULE.periods, -1)
    x = F.round(F.col("value") * MICRO)
    s = series(spark, sf_dir).withColumns({"used": F.count(x).over(past), "mean": F.avg(x).over(past), "dev": F.stddev_samp(x).over(past)})
    ok = F.col("used") >= RULE.minimum_periods
    return s.select("district_id", "month", "used", F.when(ok, F.bround("mean", 0) / MICRO).alias("expected"), F.when(ok, F.bround("dev", 0) / MICRO).alias("spread"))


@query("relative_change_anomaly", f"WITH {flags.CTES}, {_SERIES} SELECT district_id, month, CASE WHEN expected > 0 THEN round_even((value - expected) / expected, 6) END AS relative, CASE WHEN value IS NULL THEN 'no_observation' WHEN expected IS NULL THEN 'no_baseline' WHEN expected = 0 THEN 'method_inapplicable' WHEN abs(value - expected) / expected >= 0.5 THEN 'flagged' ELSE 'not_flagged' END AS outcome, value < lower OR value > upper AS outside_band FROM b")
def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative deviation (inclusive threshold) and the uncertainty band (strict)."""
    b = baselines(series(spark, sf_dir), ["district_id"])
    x, e = F.col("value"), F.col("expected")
    rel = (x - e) / F.nullif(e, F.lit(0.0))
    outcome = F.when(x.isNull(), "no_observation").when(e.isNull(), "no_baseline").when(e == 0, "method_inapplicable").when(F.abs(rel) >= 0.5, "flagged").otherwise("not_flagged")
    return b.select("district_id", "month", F.when(e > 0, F.bround(rel, 6)).alias("relative"), outcome.alias("outcome"), ((x < F.col("lower")) | (x > F.col("upper"))).alias("outside_band"))


_SPACE = f"""s AS (SELECT residence_id AS district_id, month, count(*) FILTER (confirmed) AS n, count(*) FILTER (tested) AS denominator, CASE WHEN count(*) FILTER (tested) > 0 THEN round_even(CAST(count(*) FILTER (confirmed) AS DOUBLE) / CAST(count(*) FILTER (tested) AS DOUBLE), 6) END AS value FROM visit GROUP BY 1, 2),
{_SERIES.split('FROM g),')[1].strip()}, hot AS (SELECT district_id, month, value, n, CASE WHEN value IS NULL THEN 'no_observation' WHEN n < 3 THEN 'below_minimum_count' WHEN sufficiency <> 'sufficient' OR coalesce(spread, 0) = 0 THEN 'not_evaluated_no_baseline' WHEN (value - expected) / spread >= 1.5 THEN 'hotspot' ELSE 'not_hotspot' END AS outcome FROM b JOIN (SELECT district_id, month, n FROM s) USING (district_id, month)),
{geometry.ADJACENT}"""


def space(spark: SparkSession, sf_dir: str, visits: DataFrame | None = None) -> DataFrame:
    return spatial.by_residence(spark, sf_dir, visits).select(F.col("residence_id").alias("district_id"), "month", F.col("numerator").alias("n"), "denominator", "value")


def hotspots(spark: SparkSession, sf_dir: str, visits: DataFrame | None = None) -> DataFrame:
    b = baselines(space(spark, sf_dir, visits), ["district_id"])
    above = (F.col("value") - F.col("expected")) / F.nullif(F.col("spread"), F.lit(0.0))
    outcome = F.when(F.col("value").isNull(), "no_observation").when(F.col("n") < 3, "below_minimum_count").when((F.col("sufficiency") != "sufficient") | (F.coalesce("spread", F.lit(0.0)) == 0), "not_evaluated_no_baseline").when(above >= 1.5, "hotspot").otherwise("not_hotspot")
    return b.select("district_id", "month", "value", "n", outcome.alias("outcome"))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in both directions: districts whose subcounties share a boundary of some length."""
    return geometry.district_neighbours(spark, sf_dir)


@query("hotspot", f"WITH {flags.CTES}, {_SPACE} SELECT district_id, month, value, outcome FROM hot")
def hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts of residence well above their own past."""
    return hotspots(spark, sf_dir).select("district_id", "month", "value", "outcome")


@query("neighbour_concentration", f"""WITH {flags.CTES}, {_SPACE}, a AS (SELECT h.district_id, h.month, h.value, count(o.value) AS neighbours, avg(o.value) AS mean FROM s h LEFT JOIN adj ON src = h.district_id LEFT JOIN s o ON o.district_id = dst AND o.month = h.month GROUP BY ALL)
SELECT district_id, month, neighbours, CASE WHEN neighbours > 0 AND mean > 0 THEN round_even(value / mean, 4) END AS ratio, CASE WHEN value IS NULL THEN 'no_observation' WHEN neighbours = 0 THEN 'no_neighbours' WHEN mean = 0 THEN 'inapplicable' WHEN round_even(value / mean, 4) >= 1.5 THEN 'concentrated' ELSE 'not_concentrated' END AS outcome FROM a""")
def neighbour_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A district's value over the mean of its neighbours'."""
    s = space(spark, sf_dir)
    o = s.select(F.col("district_id").alias("dst"), "month", F.col("value").alias("other"))
    near = adjacency(spark, sf_dir).join(o, "dst").groupBy(F.col("src").alias("district_id"), "month").agg(F.count("other").alias("neighbours"), F.avg("other").alias("mean"))
    a = s.join(near, ["district_id", "month"], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    r = F.bround(F.col("value") / F.nullif(F.col("mean"), F.lit(0.0)), 4)
    outcome = F.when(F.col("value").isNull(), "no_observation").when(F.col("neighbours") == 0, "no_neighbours").when(F.col("mean") == 0, "inapplicable").when(r >= 1.5, "concentrated").otherwise("not_concentrated")
    return a.select("district_id", "month", "neighbours", F.when(F.col("neighbours") > 0, r).alias("ratio"), outcome.alias("outcome"))


@query("contiguous_clusters", f"""WITH RECURSIVE {flags.CTES}, {_SPACE}, e AS (SELECT h.month, src, dst FROM hot h JOIN adj ON src = h.district_id JOIN hot o ON o.district_id = dst AND o.month = h.month WHERE h.outcome = 'hotspot' AND o.outcome = 'hotspot'),
r AS (SELECT month, district_id AS a, district_id AS b FROM hot WHERE outcome = 'hotspot' UNION SELECT r.month, r.a, e.dst FROM r JOIN e ON e.month = r.month AND e.src = r.b), l AS (SELECT month, a, min(b) AS label FROM r GROUP BY ALL)
SELECT month, label AS first_district, count(*) AS units, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS members FROM l GROUP BY ALL HAVING count(*) >= 2""")
def contiguous_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of adjacent hotspots of a month, two units at least; a node is a district in a month."""
    hot = hotspots(spark, sf_dir).where("outcome = 'hotspot'").select("district_id", "month")
    name = lambda m, d: F.struct(F.col(m).alias("month"), F.col(d).alias("district_id"))
    hot = stored.written(hot, "hotspots")
    other = hot.select(F.col("district_id").alias("dst"), "month")
    edges = hot.join(adjacency(spark, sf_dir), hot.district_id == F.col("src")).join(other, ["dst", "month"]).select(name("month", "district_id").alias("src"), name("month", "dst").alias("dst"))
    found = graph.connected(hot.select(name("month", "district_id").alias("node")), edges)
    c = found.groupBy("label").agg(F.count("*").alias("units"), F.array_sort(F.collect_list("node.district_id")).alias("m")).where("units >= 2")
    return c.select("label.month", F.col("label.district_id").alias("first_district"), "units", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query("anomaly_methods", f"""WITH {flags.CTES}, {_SERIES}, m AS (SELECT *, unnest(['robust_z', 'relative', 'band']) AS method FROM b)
SELECT district_id, month, method, CASE WHEN value IS NULL THEN 'no_observation' WHEN sufficiency <> 'sufficient' THEN 'no_baseline' WHEN CASE method WHEN 'robust_z' THEN coalesce(spread, 0) = 0 WHEN 'relative' THEN coalesce(expected, 0) = 0 ELSE lower IS NULL OR upper IS NULL END THEN 'method_inapplicable'
  WHEN CASE method WHEN 'robust_z' THEN round_even(abs(value - expected) / spread, 6) >= 2.0 WHEN 'relative' THEN abs(value - expected) / expected >= 0.5 ELSE value < lower OR value > upper END THEN 'flagged' ELSE 'not_flagged' END AS outcome FROM m""")
def anomaly_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's judgement from one baseline; a method that cannot apply says so and no other takes its place."""
    b = baselines(series(spark, sf_dir), ["district_id"])
    x, e, s, low, high = (F.col(c) for c in ("value", "expected", "spread", "lower", "upper"))
    zero = F.lit(0.0)
    rules = {"robust_z": (F.coalesce(s, zero) == 0, F.bround(F.abs(x - e) / F.nullif(s, zero), 6) >= RULE.threshold), "relative": (F.coalesce(e, zero) == 0, F.abs(x - e) / F.nullif(e, zero) >= 0.5), "band": (low.isNull() | high.isNull(), (x < low) | (x > high))}
    judged_by = lambda name: F.struct(F.lit(name).alias("method"), F.when(x.isNull(), "no_observation").when(F.col("sufficiency") != "sufficient", "no_baseline").when(rules[name][0], "method_inapplicable").when(rules[name][1], "flagged").otherwise("not_flagged").alias("outcome"))
    return b.select("district_id", "month", F.explode(F.array(*map(judged_by, rules))).alias("m")).select("district_id", "month", "m.*")


@query("cluster_outcomes", f"""WITH {flags.CTES}, c AS (SELECT facility_id, month, count(*) FILTER (confirmed) AS n, count(*) FILTER (tested) AS d FROM visit GROUP BY ALL), g AS (SELECT district_id, month, sum(n) AS n, sum(d) AS d, count(*) AS k FROM c JOIN facility USING (facility_id) WHERE is_active GROUP BY ALL), x AS (SELECT district_id, count(*) AS expected FROM facility WHERE is_active GROUP BY 1)
SELECT district.district_id, m.month, CASE WHEN g.n IS NULL OR g.d = 0 THEN 'no_observation' WHEN g.n < 5 THEN 'below_minimum_count' WHEN round_even(k / greatest(expected, k)::DOUBLE, 4) < 0.5 THEN 'incomplete' ELSE 'evaluable' END AS outcome FROM district CROSS JOIN (SELECT DISTINCT month FROM encounter) m LEFT JOIN g ON g.district_id = district.district_id AND g.month = m.month LEFT JOIN x ON x.district_id = district.district_id""")
def cluster_outcomes(spark: SparkSession, sf_dir: str, minimum: int = 5, completeness: float = 0.5) -> DataFrame:
    """Of every district and month, whether it can take part in a cluster: its observation, count and completeness."""
    g = spatial.by_facility(spark, sf_dir).select("district_id", "month", "numerator", "denominator", "completeness", "value")
    seen = bind.encounters(spark, sf_dir).select("month").distinct()
    every = bind.districts(spark, sf_dir).select("district_id", F.explode(bind.months(spark, sf_dir)).alias("month")).join(seen, "month", "left_semi")
    outcome = F.when(F.col("value").isNull(), "no_observation").when(F.col("numerator").isNull() | (F.col("numerator") < minimum), "below_minimum_count").when(F.col("completeness").isNull() | (F.col("completeness") < completeness), "incomplete").otherwise("evaluable")
    return every.join(g, ["district_id", "month"], "left").select("district_id", "month", outcome.alias("outcome"))


@query("preceding_periods", "SELECT o_orderkey AS id, string_agg(CAST(CAST(date_trunc('month', o_orderdate) - to_months(CAST(i AS INTEGER)) AS DATE) AS VARCHAR), ',' ORDER BY i) AS periods FROM orders, range(1, 5) t(i) GROUP BY 1")
def preceding_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four months before a date, newest first."""
    start = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.add_months(start, -i).cast("string")), ",").alias("periods"))


@query("seasonal_periods", """SELECT o_orderkey AS id, string_agg(CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' AND (extract(year FROM o_orderdate) - i) % 4 <> 0 THEN 'skipped' ELSE CAST(CAST(extract(year FROM o_orderdate) - i AS VARCHAR) || strftime(o_orderdate, '-%m-%d') AS VARCHAR) END, ',' ORDER BY i) AS periods FROM orders, range(1, 4) t(i) GROUP BY 1""")
def seasonal_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same day of three years before; a day that a year lacks is recorded as skipped, not moved."""
    d = F.col("o_orderdate").cast("date")
    day = lambda i: F.coalesce(F.try_to_date(F.concat((F.year(d) - i).cast("string"), F.date_format(d, "-MM-dd"))).cast("string"), F.lit("skipped"))
    return bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array(*(day(i) for i in (1, 2, 3))), ",").alias("periods"))
