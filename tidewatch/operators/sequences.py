"""Episodes of visits, and recurrence of positives along chains, on visits and on the event stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.ratio import ratio, sql_ratio
from tidewatch.operators import flags
from tidewatch.plans.registry import query
from tidewatch.sources import bind

GAP = 90
_EP = f"""o AS (SELECT *, date_diff('day', lag(encounter_date) OVER (PARTITION BY patient_id ORDER BY encounter_date, encounter_id), encounter_date) AS since FROM visit),
ep AS (SELECT *, sum(CASE WHEN since IS NULL OR since > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY encounter_date, encounter_id) AS episode FROM o)"""


def episode_members(visits: DataFrame, gap: int = GAP) -> DataFrame:
    """Visits with their episode: a new one starts where the visit before is more than `gap` days back."""
    order = Window.partitionBy("patient_id").orderBy("encounter_date", "encounter_id")
    since = F.date_diff("encounter_date", F.lag("encounter_date").over(order))
    v = visits.withColumn("since", since)
    return v.withColumn("episode", F.sum(F.when(F.col("since").isNull() | (F.col("since") > gap), 1).otherwise(0)).over(order))


@query("episode_member_roles", f"""WITH {flags.CTES}, {_EP} SELECT encounter_id, CAST(episode AS BIGINT) AS episode, row_number() OVER w AS sequence,
CASE WHEN row_number() OVER w = 1 THEN 'index' WHEN confirmed AND coalesce(bool_or(confirmed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'repeat_positive' ELSE 'follow_up' END AS role, CASE WHEN row_number() OVER w > 1 THEN since END AS days_since_previous FROM ep WINDOW w AS (PARTITION BY patient_id, episode ORDER BY encounter_date, encounter_id)""")
def episode_member_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and role of each visit within its episode."""
    m = episode_members(flags.visits(spark, sf_dir))
    w = Window.partitionBy("patient_id", "episode").orderBy("encounter_date", "encounter_id")
    n = F.row_number().over(w)
    seen = F.coalesce(F.max(F.col("confirmed")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    role = F.when(n == 1, "index").when(F.col("confirmed") & seen, "repeat_positive").otherwise("follow_up")
    return m.select("encounter_id", "episode", n.cast("long").alias("sequence"), role.alias("role"), F.when(n > 1, F.col("since")).cast("long").alias("days_since_previous"))


_SUM = """es AS (SELECT patient_id, episode, min(encounter_date) AS first_day, max(encounter_date) AS last_day, count(*) AS visits, count(*) FILTER (confirmed) AS positives, count(*) FILTER (treated) AS treated,
  max(facility_id) FILTER (rn = 1) AS index_facility, max(residence_id) FILTER (rn = 1) AS index_residence FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, episode ORDER BY encounter_date, encounter_id) AS rn FROM ep) GROUP BY 1, 2)"""
_END = "DATE '2001-08-01'"


def episodes(spark: SparkSession, sf_dir: str, visits: DataFrame | None = None) -> DataFrame:
    m = episode_members(flags.visits(spark, sf_dir) if visits is None else visits)
    first = F.struct("encounter_date", "encounter_id")
    return m.groupBy("patient_id", "episode").agg(F.min("encounter_date").alias("first_day"), F.max("encounter_date").alias("last_day"), F.count("*").alias("visits"), F.count_if("confirmed").alias("positives"), F.count_if("treated").alias("treated"), F.min_by("facility_id", first).alias("index_facility"), F.min_by("residence_id", first).alias("index_residence"))


@query("episode_summary", f"""WITH {flags.CTES}, {_EP}, {_SUM} SELECT patient_id, CAST(episode AS BIGINT) AS episode, first_day, last_day, date_diff('day', first_day, last_day) AS span, visits, positives, treated, index_facility, index_residence, CASE WHEN date_diff('day', last_day, {_END}) < {GAP} THEN 'open' WHEN positives >= 2 THEN 'qualified' ELSE 'candidate' END AS status FROM es""")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an episode; an open one is open even if it qualifies."""
    status = F.when(F.date_diff(F.to_date(F.lit("2001-08-01")), "last_day") < GAP, "open").when(F.col("positives") >= 2, "qualified").otherwise("candidate")
    return episodes(spark, sf_dir).withColumns({"span": F.date_diff("last_day", "first_day").cast("long"), "status": status})


@query("recurrence_by_scope", f"""WITH {flags.CTES}, {_EP}, {_SUM}, x AS (SELECT 'facility' AS scope, index_facility AS scope_id, * FROM es UNION ALL SELECT 'residence', index_residence, * FROM es UNION ALL SELECT 'national', 0, * FROM es),
m AS (SELECT scope, scope_id, count(DISTINCT patient_id) FILTER (positives >= 1) AS eligible, count(DISTINCT patient_id) FILTER (positives >= 2) AS repeats, count(*) FILTER (positives >= 2) AS repeat_episodes, CAST(sum(positives) AS BIGINT) AS positives FROM x GROUP BY 1, 2)
SELECT *, {sql_ratio("repeats", "eligible")} AS value FROM m""")
def recurrence_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct patients of facilities, residences and the nation; each episode goes to its three scopes before the shuffle."""
    e = episodes(spark, sf_dir)
    scope = lambda name, c: F.struct(F.lit(name).alias("scope"), c.cast("long").alias("scope_id"))
    x = e.select("*", F.explode(F.array(scope("facility", F.col("index_facility")), scope("residence", F.col("index_residence")), scope("national", F.lit(0)))).alias("s"))
    # One row a scope and patient first: distinct counts become plain ones, and the national scope is no hot key.
    p = x.groupBy("s.scope", "s.scope_id", "patient_id").agg(F.max("positives").alias("most"), F.count_if(F.col("positives") >= 2).alias("n"), F.sum("positives").alias("positives"))
    m = p.groupBy("scope", "scope_id").agg(F.count_if(F.col("most") >= 1).alias("eligible"), F.count_if(F.col("most") >= 2).alias("repeats"), F.sum("n").alias("repeat_episodes"), F.sum("positives").alias("positives"))
    return m.withColumn("value", ratio(F.col("repeats"), F.col("eligible")))


@query("repeat_interval_bands", f"""WITH {flags.CTES}, {_EP}, r AS (SELECT since, CASE WHEN row_number() OVER w > 1 AND confirmed THEN since END AS d FROM ep WINDOW w AS (PARTITION BY patient_id, episode ORDER BY encounter_date, encounter_id)),
b(band, lo, hi) AS (VALUES ('0-13', 0, 14), ('14-27', 14, 28), ('28-59', 28, 60), ('60-90', 60, 91)) SELECT band, count(d) AS repeats FROM b LEFT JOIN r ON d >= lo AND d < hi GROUP BY 1""")
def repeat_interval_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open bands of days since the visit before, of positive members after the first; empty bands are kept."""
    m = episode_members(flags.visits(spark, sf_dir))
    w = Window.partitionBy("patient_id", "episode").orderBy("encounter_date", "encounter_id")
    d = m.withColumn("n", F.row_number().over(w)).where("n > 1 AND confirmed")
    band = F.when(F.col("since") < 14, "0-13").when(F.col("since") < 28, "14-27").when(F.col("since") < 60, "28-59").when(F.col("since") < 91, "60-90")
    c = d.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, ("0-13", "14-27", "28-59", "60-90")))).alias("band"))
    return every.join(c, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("repeats"))


@dataclass(frozen=True)
class ChainRule:
    """Chains of positives: at least `gap` days between members, at most `window` from first to last, `least` members."""

    gap: int = 2
    window: int = 9
    least: int = 3

    def __post_init__(self) -> None:
        if self.gap < 0 or self.window < self.gap or self.least < 2:
            raise ValueError("gap >= 0, window >= gap and least >= 2 are asked for")


CHAIN = ChainRule()
PERIOD = "2024-01-11"


def best_chain(days: list[int], rule: ChainRule, period_start: int) -> list[int]:
    """The longest chain that ends in the period; then the earliest end, the earliest start, the latest member before each.

    days are ascending and distinct. From each start, the longest chain to every day in the window is that of the longest
    before it, so the search is linear in days times window.
    """
    best: tuple[tuple[int, int, int], list[int]] | None = None
    for i, first in enumerate(days):
        chains = {i: [first]}
        for j in range(i + 1, len(days)):
            if days[j] - first > rule.window:
                break
            before = [k for k in chains if days[j] - days[k] >= rule.gap]
            if before:
                k = max(before, key=lambda k: (len(chains[k]), days[k]))
                chains[j] = [*chains[k], days[j]]
        for j, c in chains.items():
            key = (len(c), -days[j], -first)
            if len(c) >= rule.least and days[j] >= period_start and (best is None or key > best[0]):
                best = key, c
    return best[1] if best else []


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One positive event a patient and day, the one of the smallest id: a patient has no more rows than days."""
    e = bind.events(spark, sf_dir).where(F.col("event_type") == "error")
    return e.groupBy("patient_id", "day").agg(F.min("event_id").alias("event_id"), F.count("*").alias("same_day"), F.count_distinct(F.col("event_id") % 5).alias("places"))


def chains(spark: SparkSession, sf_dir: str, rule: ChainRule = CHAIN) -> DataFrame:
    """Each patient's positive days as one array, and the search over batches of patients instead of a group each."""
    start = (pd.Timestamp(PERIOD) - pd.Timestamp("1970-01-01")).days

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [best_chain(n.tolist(), rule, start) for n in pdf["n"]]
            last = [int(e[list(n).index(c[-1])]) if c else None for c, n, e in zip(found, pdf["n"], pdf["e"], strict=True)]
            yield pd.DataFrame({"patient_id": pdf["patient_id"], "in_period": [int((n >= start).sum()) for n in pdf["n"]], "chain": found, "final_event": pd.array(last, "Int64")})

    p = positives(spark, sf_dir).groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("day").cast("long").alias("n"), "event_id"))).alias("d"))
    return p.select("patient_id", F.col("d.n").alias("n"), F.col("d.event_id").alias("e")).mapInPandas(run, "patient_id long, in_period long, chain array<bigint>, final_event long")


_POS = f"""pos AS (SELECT patient_id, day, date_diff('day', DATE '1970-01-01', day) AS n, min(event_id) AS event_id, count(*) AS same_day, count(DISTINCT event_id % 5) AS places FROM event WHERE event_type = 'error' GROUP BY ALL)"""
_CH = f"""ch AS (SELECT patient_id, [n] AS c, n AS first, n AS last FROM pos UNION ALL SELECT ch.patient_id, list_append(c, p.n), first, p.n FROM ch JOIN pos p ON p.patient_id = ch.patient_id AND p.n - ch.last >= {CHAIN.gap} AND p.n - ch.first <= {CHAIN.window}),
best AS (SELECT patient_id, c FROM ch WHERE len(c) >= {CHAIN.least} AND last >= date_diff('day', DATE '1970-01-01', DATE '{PERIOD}') QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY len(c) DESC, last, first, list_reverse(c) DESC) = 1),
ev AS (SELECT p.patient_id, count(*) FILTER (p.n >= date_diff('day', DATE '1970-01-01', DATE '{PERIOD}')) AS in_period, coalesce(any_value(c), []) AS c FROM pos p LEFT JOIN best USING (patient_id) GROUP BY 1)"""


@query("best_chain", f"""WITH RECURSIVE {bind.CTES}, {_POS}, {_CH} SELECT patient_id, array_to_string(c, ',') AS chain, len(c) AS length, CASE WHEN in_period = 0 THEN 'not_in_period' WHEN len(c) > 0 THEN 'qualifies' ELSE 'does_not_qualify' END AS determination FROM ev""")
def best_chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patient's best chain and determination."""
    c = chains(spark, sf_dir)
    how = F.when(F.col("in_period") == 0, "not_in_period").when(F.size("chain") > 0, "qualifies").otherwise("does_not_qualify")
    return c.select("patient_id", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain"), F.size("chain").cast("long").alias("length"), how.alias("determination"))


@query("recurrence_summary", f"WITH RECURSIVE {bind.CTES}, {_POS}, {_CH} SELECT count(*) FILTER (len(c) > 0) AS numerator, count(*) FILTER (in_period > 0) AS denominator, {sql_ratio('count(*) FILTER (len(c) > 0)', 'count(*) FILTER (in_period > 0)')} AS proportion FROM ev")
def recurrence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifying patients over those with a positive in the period."""
    s = chains(spark, sf_dir).agg(F.count_if(F.size("chain") > 0).alias("numerator"), F.count_if(F.col("in_period") > 0).alias("denominator"))
    return s.withColumn("proportion", ratio(F.col("numerator"), F.col("denominator")))


@query("positive_frequency", f"WITH RECURSIVE {bind.CTES}, {_POS}, {_CH}, l(label) AS (VALUES ('2'), ('3'), ('4+')), f AS (SELECT CASE WHEN len(c) >= 4 THEN '4+' ELSE CAST(len(c) AS VARCHAR) END AS label FROM ev WHERE len(c) > 0) SELECT label, count(f.label) AS patients FROM l LEFT JOIN f USING (label) GROUP BY 1")
def positive_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains by length, with empty lengths kept."""
    f = chains(spark, sf_dir).where("size(chain) > 0").groupBy(F.when(F.size("chain") >= 4, "4+").otherwise(F.size("chain").cast("string")).alias("label")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(F.lit("2"), F.lit("3"), F.lit("4+"))).alias("label"))
    return every.join(f, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("patients"))


@query("interval_distribution", f"""WITH RECURSIVE {bind.CTES}, {_POS}, {_CH}, g AS (SELECT c[i + 1] - c[i] AS d FROM ev, range(1, 12) t(i) WHERE i < len(c)), b(band, lo, hi) AS (VALUES ('2-3', 2, 3), ('4-5', 4, 5), ('6-9', 6, 9)) SELECT band, count(d) AS intervals FROM b LEFT JOIN g ON d BETWEEN lo AND hi GROUP BY 1""")
def interval_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed bands of days between members of chains; empty bands are kept."""
    c = F.col("chain")
    d = chains(spark, sf_dir).where("size(chain) > 1").select(F.explode(F.transform(F.slice(c, 2, F.size(c) - 1), lambda x, i: x - F.get(c, i))).alias("d"))
    band = F.when(F.col("d").between(2, 3), "2-3").when(F.col("d").between(4, 5), "4-5").when(F.col("d").between(6, 9), "6-9")
    n = d.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(F.lit("2-3"), F.lit("4-5"), F.lit("6-9"))).alias("band"))
    return every.join(n, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("intervals"))


@query("facility_breakdown", f"""WITH RECURSIVE {bind.CTES}, {_POS}, {_CH}, num AS (SELECT p.event_id % 5 AS facility_id, count(*) AS n FROM ev JOIN pos p ON p.patient_id = ev.patient_id AND p.n = c[-1] GROUP BY 1), den AS (SELECT event_id % 5 AS facility_id, count(DISTINCT patient_id) AS d FROM pos WHERE day >= DATE '{PERIOD}' GROUP BY 1)
SELECT coalesce(num.facility_id, den.facility_id) AS facility_id, coalesce(n, 0) AS numerator, coalesce(d, 0) AS denominator FROM num FULL JOIN den USING (facility_id)""")
def facility_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerators by the place of the last positive, denominators by every place in the period: they do not add up."""
    n = chains(spark, sf_dir).where("final_event IS NOT NULL").groupBy((F.col("final_event") % 5).alias("facility_id")).agg(F.count("*").alias("n"))
    p = positives(spark, sf_dir).where(F.col("day") >= PERIOD).select((F.col("event_id") % 5).alias("facility_id"), "patient_id").distinct()
    d = p.groupBy("facility_id").agg(F.count("*").alias("d"))
    return n.join(d, "facility_id", "full").select("facility_id", F.coalesce("n", F.lit(0)).alias("numerator"), F.coalesce("d", F.lit(0)).alias("denominator"))


@query("weekly_trend", f"""WITH RECURSIVE {bind.CTES}, {_POS}, {_CH}, num AS (SELECT CAST(date_trunc('week', DATE '1970-01-01' + CAST(c[-1] AS INTEGER)) AS DATE) AS week, count(*) AS n FROM ev WHERE len(c) > 0 GROUP BY 1), den AS (SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS d FROM (SELECT patient_id, max(day) AS d FROM pos WHERE day >= DATE '{PERIOD}' GROUP BY 1) GROUP BY 1)
SELECT coalesce(num.week, den.week) AS week, coalesce(n, 0) AS numerator, coalesce(d, 0) AS denominator FROM num FULL JOIN den USING (week)""")
def weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monday weeks of last chain days and of latest positives."""
    week = lambda d: F.date_trunc("week", d).cast("date").alias("week")
    n = chains(spark, sf_dir).where("size(chain) > 0").groupBy(week(F.date_from_unix_date(F.element_at("chain", -1).cast("int")))).agg(F.count("*").alias("n"))
    p = positives(spark, sf_dir).where(F.col("day") >= PERIOD).groupBy("patient_id").agg(F.max("day").alias("d"))
    return n.join(p.groupBy(week(F.col("d"))).agg(F.count("*").alias("d")), "week", "full").select("week", F.coalesce("n", F.lit(0)).alias("numerator"), F.coalesce("d", F.lit(0)).alias("denominator"))


@query("pair_recurrence", f"""WITH {bind.CTES}, {_POS} SELECT patient_id, EXISTS (SELECT 1 FROM pos a JOIN pos b ON a.patient_id = b.patient_id AND b.n - a.n BETWEEN 3 AND 6 WHERE a.patient_id = p.patient_id AND b.day >= DATE '{PERIOD}') AS qualifies FROM (SELECT DISTINCT patient_id FROM pos) p""")
def pair_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two positives 3 to 6 days apart, the later in the period: a range window over days instead of a self join."""
    w = Window.partitionBy("patient_id").orderBy("n").rangeBetween(-6, -3)
    p = positives(spark, sf_dir).withColumn("n", F.unix_date("day").cast("long"))
    hit = (F.count("*").over(w) > 0) & (F.col("day") >= PERIOD)
    return p.withColumn("hit", hit).groupBy("patient_id").agg(F.bool_or("hit").alias("qualifies"))


@query("positive_intervals", f"WITH {bind.CTES}, {_POS} SELECT patient_id, day, n - lag(n) OVER w AS adjacent, n - first_value(n) OVER w AS anchor FROM pos WINDOW w AS (PARTITION BY patient_id ORDER BY n)")
def positive_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the positive before and since the first."""
    w = Window.partitionBy("patient_id").orderBy("n")
    n = F.col("n")
    p = positives(spark, sf_dir).withColumn("n", F.unix_date("day").cast("long"))
    return p.select("patient_id", "day", (n - F.lag("n").over(w)).alias("adjacent"), (n - F.first("n").over(w)).alias("anchor"))


@query("same_day_groups", f"WITH {bind.CTES}, {_POS} SELECT patient_id, day, same_day AS members, CASE WHEN places = 1 THEN 'near_duplicate' ELSE 'same_day_distinct' END AS kind, event_id AS representative FROM pos WHERE same_day >= 2")
def same_day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives of one patient and day, with the one that stands for them."""
    return positives(spark, sf_dir).where("same_day >= 2").select("patient_id", "day", F.col("same_day").alias("members"), F.when(F.col("places") == 1, "near_duplicate").otherwise("same_day_distinct").alias("kind"), F.col("event_id").alias("representative"))


@query("duplicate_counts", f"WITH {bind.CTES}, {_POS} SELECT CASE WHEN places = 1 THEN 'near_duplicate' ELSE 'same_day_distinct' END AS kind, count(*) AS groups, CAST(sum(same_day) AS BIGINT) AS members FROM pos WHERE same_day >= 2 GROUP BY 1")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one day by kind."""
    return same_day_groups(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("groups"), F.sum("members").alias("members"))


@query("coverage_stitching", """WITH w AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS opened, CAST(o_orderdate AS DATE) + 120 AS closed, o_orderkey AS k FROM orders),
r AS (SELECT *, max(closed) OVER (PARTITION BY id ORDER BY opened, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w) SELECT id, min(opened) AS opened, max(closed) AS closed, count(*) FILTER (before IS NOT NULL AND opened > before + 1) AS gaps, count(*) FILTER (before IS NOT NULL AND opened > before + 1) = 0 AS covered FROM r GROUP BY 1""")
def coverage_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether windows cover their span; adjacent days join."""
    o = bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("opened"), F.date_add(F.col("o_orderdate").cast("date"), 120).alias("closed"), F.col("o_orderkey").alias("k"))
    before = F.max("closed").over(Window.partitionBy("id").orderBy("opened", "k").rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce(F.col("opened") > F.date_add(before, 1), F.lit(False))
    return o.withColumn("gap", gap).groupBy("id").agg(F.min("opened").alias("opened"), F.max("closed").alias("closed"), F.count_if("gap").alias("gaps"), (F.count_if("gap") == 0).alias("covered"))


@query("patient_bounds", f"WITH {flags.CTES} SELECT facility_id, min(encounter_date) AS first_day, max(encounter_date) AS last_day, count(DISTINCT patient_id) AS patients FROM visit WHERE confirmed GROUP BY 1")
def patient_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last positive day of a facility."""
    return flags.visits(spark, sf_dir).where("confirmed").groupBy("facility_id").agg(F.min("encounter_date").alias("first_day"), F.max("encounter_date").alias("last_day"), F.count_distinct("patient_id").alias("patients"))


@query("patient_timeline", f"WITH {flags.CTES}, p AS (SELECT encounter_id, string_agg(method || '/' || result, ',' ORDER BY method, result) AS tests FROM test GROUP BY 1) SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_date, encounter_id) AS place, encounter_id, encounter_date, facility_id, coalesce(tests, '') AS tests FROM encounter LEFT JOIN p USING (encounter_id)")
def patient_timeline(spark: SparkSession, sf_dir: str, patient_id: int | None = None) -> DataFrame:
    """All visits of every patient, or of one, in order, with their tests; a patient's visits come first, so few tests are nested."""
    e = bind.encounters(spark, sf_dir)
    t = bind.tests(spark, sf_dir)
    if patient_id is not None:
        e = e.where(F.col("patient_id") == patient_id)
        t = t.join(e.select("encounter_id"), "encounter_id", "left_semi")
    t = t.groupBy("encounter_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("method", F.lit("/"), "result"))), ",").alias("tests"))
    place = F.row_number().over(Window.partitionBy("patient_id").orderBy("encounter_date", "encounter_id")).cast("long")
    return e.join(t, "encounter_id", "left").select("patient_id", place.alias("place"), "encounter_id", "encounter_date", "facility_id", F.coalesce("tests", F.lit("")).alias("tests"))


@query("cohort_comparison", f"""WITH {flags.CTES}, a AS (SELECT DISTINCT patient_id FROM visit WHERE confirmed AND encounter_date < DATE '1998-01-01'), b AS (SELECT DISTINCT patient_id FROM visit WHERE confirmed AND encounter_date >= DATE '1998-01-01')
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either""")
def cohort_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cohorts of patients as sets, from one aggregation."""
    v = flags.visits(spark, sf_dir).where("confirmed")
    p = v.groupBy("patient_id").agg(F.bool_or(F.col("encounter_date") < "1998-01-01").alias("a"), F.bool_or(F.col("encounter_date") >= "1998-01-01").alias("b"))
    return p.agg(F.count_if(F.expr("a AND NOT b")).alias("only_a"), F.count_if(F.expr("b AND NOT a")).alias("only_b"), F.count_if(F.expr("a AND b")).alias("both"), F.count("*").alias("either"))


@query("cohorts_by_year", f"""WITH {flags.CTES}, p AS (SELECT patient_id, min(encounter_date) AS first, max(encounter_date) AS last FROM visit WHERE confirmed GROUP BY 1), y AS (SELECT make_date(y, 1, 1) AS cut FROM (SELECT unnest(range(min(extract(year FROM encounter_date)), max(extract(year FROM encounter_date)) + 1)) AS y FROM encounter))
SELECT cut, count(*) FILTER (last < cut) AS only_before, count(*) FILTER (first >= cut) AS only_after, count(*) FILTER (first < cut AND last >= cut) AS both, count(*) AS either FROM p, y GROUP BY 1""")
def cohorts_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients confirmed before and after the start of every year, as sets: a patient's first and last day say both."""
    v = flags.visits(spark, sf_dir).where("confirmed")
    d = bind.table(spark, sf_dir, "orders")
    year = lambda f: d.select(F.year(f("o_orderdate"))).scalar()
    p = v.groupBy("patient_id").agg(F.min("encounter_date").alias("first"), F.max("encounter_date").alias("last"))
    c = p.groupBy(F.year("first").alias("a"), F.year("last").alias("b")).agg(F.count("*").alias("n"))
    x = c.select("a", "b", "n", F.explode(F.sequence(year(F.min), year(F.max))).alias("y"))
    some = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    return x.groupBy(F.make_date("y", F.lit(1), F.lit(1)).alias("cut")).agg(some(b < y).alias("only_before"), some(a >= y).alias("only_after"), some((a < y) & (b >= y)).alias("both"), F.sum("n").alias("either"))
