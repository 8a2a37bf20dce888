"""Scalar rules as queries, validators, latest revisions, upserts and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as fn
from tidewatch.plans.registry import query
from tidewatch.sources import bind


@query("text_normalised", r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text, nullif(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 255), '') AS stored, length(text) AS n FROM documents")
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed text of whole documents, and what a column of 255 characters keeps of it."""
    text = F.col("text")
    return bind.table(spark, sf_dir, "documents").select("doc_id", fn.collapsed(text).alias("text"), fn.collapsed(text, 255).alias("stored"), F.length("text").cast("long").alias("n"))


@query("place_names", r"""WITH r AS (SELECT n_nationkey AS id, '  ' || n_name || ' (Old) Town-Council ' AS raw FROM nation), x AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(upper(raw), '\([^)]*\)', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM r) SELECT id, name, CASE WHEN ends_with(name, ' TOWN COUNCIL') THEN 'town_council' ELSE 'subcounty' END AS kind FROM x""")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of places, comparable, with their kind."""
    n = bind.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), fn.place_name(F.concat(F.lit("  "), "n_name", F.lit(" (Old) Town-Council "))).alias("name"))
    return n.withColumn("kind", fn.place_kind(F.col("name")))


@query("code_parts", "SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, lpad(CAST(c_custkey AS VARCHAR), 6, '0')[1:1] AS region, lpad(CAST(c_custkey AS VARCHAR), 6, '0')[1:3] AS district, lpad(CAST(c_custkey AS VARCHAR), 6, '0')[1:4] AS county, lpad(CAST(c_custkey AS VARCHAR), 6, '0')[1:6] AS subcounty FROM customer")
def code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical codes and their prefixes."""
    return bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fn.code_parts(F.col("c_custkey").cast("string")).alias("x")).select("id", "x.*")


@query("strict_counts", "WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0' WHEN 3 THEN '-3' WHEN 4 THEN ' ' WHEN 5 THEN 'NaN' ELSE '2.5' END AS raw, CAST(l_quantity AS BIGINT) AS q FROM lineitem) SELECT l_linenumber AS line, count(*) AS cells, count(CASE WHEN l_linenumber IN (1, 2) THEN q END) AS counts, CAST(sum(CASE WHEN l_linenumber IN (1, 2) THEN q END) AS BIGINT) AS total FROM r GROUP BY 1")
def strict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reported cells are counts."""
    q = F.col("l_quantity").cast("long").cast("string")
    n = F.col("l_linenumber")
    raw = F.when(n == 1, q).when(n == 2, F.concat(q, F.lit(".0"))).when(n == 3, "-3").when(n == 4, " ").when(n == 5, "NaN").otherwise("2.5")
    r = bind.table(spark, sf_dir, "lineitem").select(n.alias("line"), fn.strict_count(raw).alias("v"))
    return r.groupBy("line").agg(F.count("*").alias("cells"), F.count("v").alias("counts"), F.sum("v").alias("total"))


@query("local_days", "SELECT CAST(ts + INTERVAL 3 HOUR AS DATE) AS local_day, count(*) AS events, CAST(date_trunc('week', CAST(ts + INTERVAL 3 HOUR AS DATE)) AS DATE) AS week FROM events GROUP BY ALL")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the calendar day of the reporting zone and its Monday."""
    d = fn.local_day(F.col("ts"))
    return bind.table(spark, sf_dir, "events").groupBy(d.alias("local_day")).agg(F.count("*").alias("events")).withColumn("week", F.date_trunc("week", "local_day").cast("date"))


@query("age_groups", "WITH a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 365 WHEN 1 THEN p_size * 30 ELSE p_size END AS days FROM part) SELECT CASE WHEN days < 1825 THEN 'under_5' WHEN days < 5475 THEN '5_to_14' ELSE '15_and_over' END AS age_group, count(*) AS n, min(days) AS least FROM a GROUP BY 1")
def age_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of several units in three groups."""
    unit = F.when(F.col("p_partkey") % 3 == 0, "years").when(F.col("p_partkey") % 3 == 1, "months").otherwise("days")
    d = bind.table(spark, sf_dir, "part").select(fn.age_days(F.col("p_size"), unit).alias("days"))
    return d.groupBy(fn.age_group(F.col("days")).alias("age_group")).agg(F.count("*").alias("n"), F.min("days").alias("least"))


@query("group_ids", """WITH m AS (SELECT o_custkey AS id, CAST(o_orderkey AS VARCHAR) AS m FROM orders), p AS (SELECT id, substr(sha256(m), 1, 3) AS part, sha256(string_agg(m, '|' ORDER BY m)) AS digest FROM m GROUP BY 1, 2)
SELECT id, substr(sha256('visits|' || string_agg(part || digest, '|' ORDER BY part)), 1, 20) AS group_id FROM p GROUP BY 1""")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of sets of visits."""
    return set_ids(bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("member")), "visits")


def set_ids(members: DataFrame, kind: str) -> DataFrame:
    """id, group_id: a short id of each set of members (id, member). Members are digested in 4096 parts by their hashes, and the
    parts' digests in their order, so no cell holds a large set."""
    part = F.substring(F.sha2("member", 256), 1, 3)
    p = members.groupBy("id", part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("member")), "|"), 256).alias("digest"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat("part", "digest"))), "|")
    return p.groupBy("id").agg(F.substring(F.sha2(F.concat(F.lit(f"{kind}|"), whole), 256), 1, 20).alias("group_id"))


@query("row_fingerprints", """SELECT s_suppkey AS id, sha256('{"s_name":"' || s_name || '","s_nationkey":"' || s_nationkey || '","s_suppkey":"' || s_suppkey || '"}') AS fingerprint FROM supplier""")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical hashes of rows."""
    return bind.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), fn.fingerprint("s_name", "s_suppkey", "s_nationkey").alias("fingerprint"))


@query("ring_areas", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size * (p_partkey % 10 + 1) AS DOUBLE) END AS area FROM part")
def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of rectangles as rings; every fourth ring is open and has none."""
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 10 + 1).cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    last = F.when(F.col("p_partkey") % 4 == 0, at(w, zero)).otherwise(at(zero, zero))
    return bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fn.ring_area(F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h), last)).alias("area"))


@query("csv_guarded", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '''=' || o_orderpriority WHEN o_orderkey % 3 = 1 THEN '''-' || o_orderpriority ELSE o_orderpriority END AS cell FROM orders")
def csv_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export cells that start like a formula get a quote."""
    k = F.col("o_orderkey") % 3
    raw = F.concat(F.when(k == 0, "=").when(k == 1, "-").otherwise(""), "o_orderpriority")
    return bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fn.csv_safe(raw).alias("cell"))


@query("json_properties", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (json_extract_string(props, '$.missing') IS NULL) AS not_recorded FROM events GROUP BY 1")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open JSON payloads as variants, absent keys as not recorded."""
    v = F.try_parse_json("props")
    e = bind.table(spark, sf_dir, "events").select("event_type", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("m"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_if(F.col("m").isNull()).alias("not_recorded"))


def issues(*rules: tuple[str, str, Column]) -> Column:
    """The rules (code, severity, condition) that a row breaks, as an array."""
    every = F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules))
    return F.filter(every, lambda x: x.isNotNull())


@query("row_validation", """WITH v AS (SELECT l_orderkey, l_returnflag = 'N' AND l_linestatus = 'F' AS a, l_quantity > 45 AS b, l_tax = 0 AS c, l_shipdate < o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
i AS (SELECT unnest([CASE WHEN a THEN 'not_done_with_result' END, CASE WHEN b THEN 'value_out_of_bounds' END, CASE WHEN c THEN 'drug_name_missing' END, CASE WHEN d THEN 'date_before_visit' END]) AS code, a OR d AS blocked FROM v) SELECT code, count(*) AS n, count(*) FILTER (blocked) AS quarantined FROM i WHERE code IS NOT NULL GROUP BY 1""")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of rows by code; an error quarantines its row, a warning does not."""
    l, o = bind.table(spark, sf_dir, "lineitem"), bind.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    found = issues(("not_done_with_result", "error", (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")), ("value_out_of_bounds", "warning", F.col("l_quantity") > 45), ("drug_name_missing", "warning", F.col("l_tax") == 0), ("date_before_visit", "error", F.col("l_shipdate") < F.col("o_orderdate")))
    r = l.join(o, l.l_orderkey == o.o_orderkey).select(found.alias("issues"))
    r = r.withColumn("blocked", F.exists("issues", lambda x: x.severity == "error"))
    return r.select(F.explode("issues").alias("i"), "blocked").groupBy("i.code").agg(F.count("*").alias("n"), F.count_if("blocked").alias("quarantined"))


@query("duplicate_cells", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a file declares unique and that are not."""
    return bind.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).where("copies > 1")


@query("batch_declared_count", "WITH b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS batch, count(*) AS rows_read, count(*) + CASE WHEN extract(month FROM date_trunc('month', min(o_orderdate))) = 2 THEN 1 ELSE 0 END AS declared FROM orders GROUP BY 1) SELECT batch, declared, rows_read, CASE WHEN declared <> rows_read THEN 'fatal' ELSE 'accepted' END AS outcome FROM b")
def batch_declared_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch whose envelope declares another count is refused as a whole (bound: February's)."""
    b = bind.table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("batch")).agg(F.count("*").alias("rows_read"))
    declared = F.col("rows_read") + F.when(F.month("batch") == 2, 1).otherwise(0)
    return b.select("batch", declared.alias("declared"), "rows_read", F.when(declared != F.col("rows_read"), "fatal").otherwise("accepted").alias("outcome"))


@query("latest_revisions", "SELECT user_id, event_type, max(struct_pack(t := ts, e := event_id)).e AS event_id, max(ts) AS ts, count(*) AS revisions FROM events GROUP BY 1, 2")
def latest_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last revision of each identity, by aggregation; later input wins ties."""
    return bind.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"), F.count("*").alias("revisions"))


@query("upsert_outcomes", """WITH cur AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT CASE WHEN new.k IS NULL THEN 'kept' WHEN cur.k IS NULL THEN 'inserted' WHEN new.v = cur.v THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM cur FULL JOIN new USING (k) GROUP BY 1""")
def upsert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load does to stored rows, by checksum."""
    o = bind.table(spark, sf_dir, "orders")
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    cur = o.where(k % 3 != 0).select(k.alias("k"), F.xxhash64(v).alias("was"))
    new = o.where(k % 2 == 0).select(k.alias("k"), F.xxhash64(F.when(k % 5 == 0, v + 1).otherwise(v)).alias("now"))
    outcome = F.when(F.col("now").isNull(), "kept").when(F.col("was").isNull(), "inserted").when(F.col("now") == F.col("was"), "unchanged").otherwise("updated")
    return cur.join(new, "k", "full").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("idempotent_append", "SELECT count(*) FILTER (o_orderkey % 4 <> 0) AS written, count(*) FILTER (o_orderkey % 4 = 0) AS unchanged FROM orders")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose fingerprint is stored are not written again: an anti join on null-safe keys."""
    o = bind.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", fn.fingerprint("o_orderkey", "o_custkey", "o_totalprice").alias("f"))
    stored = o.where("o_orderkey % 4 = 0").select(F.col("f").alias("sf"), F.col("o_custkey").alias("sk"))
    fresh = o.join(stored, F.col("f").eqNullSafe(F.col("sf")) & F.col("o_custkey").eqNullSafe(F.col("sk")), "left_anti").agg(F.count("*").alias("written"))
    return fresh.join(o.agg(F.count("*").alias("n")), F.lit(True)).select("written", (F.col("n") - F.col("written")).alias("unchanged"))  # one row each


@query("facility_resolution", f"""WITH {bind.CTES}, w AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'Supplier#00000000' || o_orderkey % 7 WHEN o_orderkey % 10 = 1 THEN 'unknown' ELSE 'X' || o_orderkey % 20 END AS code FROM orders), x AS (SELECT 'X' || facility_id AS alias, facility_id FROM facility)
SELECT CASE WHEN f.facility_id IS NOT NULL THEN 'code' WHEN x.facility_id IS NOT NULL THEN 'identifier' ELSE 'unresolved' END AS how, count(*) AS n, CAST(sum(coalesce(f.facility_id, x.facility_id)) AS BIGINT) AS checksum FROM w LEFT JOIN facility f ON f.facility_name = code LEFT JOIN x ON alias = code GROUP BY 1""")
def facility_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities by code, else by an external identifier."""
    k = F.col("o_orderkey")
    code = F.when(k % 10 == 0, F.concat(F.lit("Supplier#00000000"), k % 7)).when(k % 10 == 1, "unknown").otherwise(F.concat(F.lit("X"), k % 20))
    f = bind.facilities(spark, sf_dir)
    by_code = f.select(F.col("facility_name").alias("code"), F.col("facility_id").alias("a"))
    by_alias = f.select(F.concat(F.lit("X"), "facility_id").alias("code"), F.col("facility_id").alias("b"))
    r = bind.table(spark, sf_dir, "orders").select(code.alias("code")).join(by_code, "code", "left").join(by_alias, "code", "left")
    how = F.when(F.col("a").isNotNull(), "code").when(F.col("b").isNotNull(), "identifier").otherwise("unresolved")
    return r.groupBy(how.alias("how")).agg(F.count("*").alias("n"), F.sum(F.coalesce("a", "b")).alias("checksum"))


@query("absent_units", "SELECT c_custkey AS unit FROM customer EXCEPT SELECT o_custkey FROM orders")
def absent_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored units that a new release lacks."""
    c, o = bind.table(spark, sf_dir, "customer"), bind.table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.col("c_custkey").alias("unit")).distinct()


@query("requested_facilities", f"WITH {bind.CTES} SELECT facility_id, month FROM encounter UNION SELECT facility_id, month FROM stock")
def requested_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities with visits or imports, by month."""
    return bind.encounters(spark, sf_dir).select("facility_id", "month").union(bind.stock(spark, sf_dir).select("facility_id", "month")).distinct()


@query("scd2_revisions", "SELECT l_partkey AS unit, l_shipdate AS valid_from, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS valid_to, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS version FROM (SELECT DISTINCT l_partkey, l_shipdate FROM lineitem)")
def scd2_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a unit with their validity."""
    w = Window.partitionBy("unit").orderBy("valid_from")
    d = bind.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_shipdate").alias("valid_from")).distinct()
    return d.select("unit", "valid_from", F.lead("valid_from").over(w).alias("valid_to"), F.row_number().over(w).cast("long").alias("version"))


@query("metadata_candidates", "SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '(?i)\\bring\\b') THEN 'medicine' WHEN regexp_matches(p_name, '(?i)widget') THEN 'device' END AS proposal FROM part WHERE regexp_matches(p_name, '(?i)(\\bring\\b|widget)')")
def metadata_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals from names; nothing is mapped without approval."""
    p = F.col("p_name")
    proposal = F.when(p.rlike(r"(?i)\bring\b"), "medicine").when(p.rlike("(?i)widget"), "device")
    return bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), proposal.alias("proposal")).where("proposal IS NOT NULL")
