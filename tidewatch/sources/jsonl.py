"""Artefacts of JSON lines: visits and aggregate returns, parsed and checked with Spark's JSON functions.

read() takes files; lines() binds the driver's tables to such artefacts, a month an artefact, so that queries and their
SQL have the same input. A line is judged on its own; an artefact is refused as a whole if any of its lines is bad.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import stored
from tidewatch.sources import bind

#: Keys that name a person, in the form that normalised() gives to keys.
FORBIDDEN = ("patientname", "fullname", "surname", "nationalid", "phonenumber", "dateofbirth")
ENCOUNTER = "record_type string, source_row_id string, visit_date string, person long, fever string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """artefact (the file), line: blank lines are skipped; files are split and read in parallel."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("artefact"), F.col("value").alias("line"))
    return rows.where(F.trim("line") != "")


def normalised(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def walked(docs: DataFrame) -> DataFrame:
    """id, path, key, kind of every member at any depth of JSON values (id, v: variants). A round takes the members of all objects
    and arrays of the round before, so there are as many rounds as the deepest value has levels. Paths are as `$.a.b[2].c`;
    members of arrays have no key; kind is that of the member's value."""
    spark = docs.sparkSession
    step = """SELECT id, CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') ELSE concat(path, '.', e.key) END AS path, e.key, e.value AS v,
        CASE WHEN schema_of_variant(e.value) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant(e.value) LIKE 'ARRAY%' THEN 'array' ELSE lower(schema_of_variant(e.value)) END AS kind FROM {rows}, LATERAL variant_explode(v) e"""
    level, found = docs.select("id", F.lit("$").alias("path"), "v"), []
    while True:
        level = stored.written(spark.sql(step, rows=level), "members")
        found.append(level.select("id", "path", "key", "kind"))
        level = level.where("kind IN ('object', 'array')").select("id", "path", "v")
        if level.isEmpty():
            break
    return functools.reduce(DataFrame.union, found)


def forbidden_paths(lines: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """line_id (of a line's text), paths: where lines hold keys that name a person, at any depth and however they are escaped.

    A key without a backslash in its line is found in the text as it stands; only lines that may hold one are parsed and
    walked.
    """
    plain = F.regexp_extract_all("line", F.lit(r'"([^"\\]*)"\s*:'), F.lit(1))
    perhaps = F.col("line").contains("\\") | F.exists(plain, lambda k: normalised(k).isin(*forbidden))
    docs = lines.where(perhaps).select(line_id(), F.try_parse_json("line").alias("v")).dropDuplicates(["id"])
    found = walked(docs).where(F.col("key").isNotNull() & normalised(F.col("key")).isin(*forbidden))
    return found.groupBy(F.col("id").alias("line_id")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def line_id() -> Column:
    return F.sha2("line", 256).alias("id")


def judged(lines: DataFrame) -> DataFrame:
    """lines with the parsed row, the paths of forbidden keys, and fault: the first reason for which a line is bad, or null."""
    row = F.from_json("line", ENCOUNTER)
    whole = F.try_parse_json("line").isNotNull()
    d = lines.withColumn("line_id", line_id()).join(forbidden_paths(lines), "line_id", "left").drop("line_id")
    fault = F.when(~whole, "malformed_json").when(F.col("paths").isNotNull(), "forbidden_field")
    d = d.select("*", row.alias("row"), fault.alias("fault"))
    kind = F.when(F.col("row.record_type").isNull() | (F.col("row.record_type") != "encounter"), "wrong_record_type").when(F.coalesce(F.trim("row.source_row_id"), F.lit("")) == "", "missing_source_row_id")
    return d.withColumn("fault", F.coalesce("fault", kind))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artefact (a month), id, line: visits as JSON texts, some of them bad."""
    k = F.col("encounter_id")
    e = bind.encounters(spark, sf_dir)
    kind = F.when(k % 9973 == 0, "aggregate").otherwise("encounter")
    row = F.when(k % 1009 != 0, k.cast("string"))
    person = F.struct(F.lit("x").alias("Patient_Name"))
    extra = F.when(k % 1013 == 0, F.struct(person.alias("contact"), F.lit(None).cast("array<struct<Patient_Name: string>>").alias("seen"))).when(k % 1021 == 0, F.struct(F.lit(None).cast("struct<Patient_Name: string>").alias("contact"), F.array(F.struct(F.lit(None).cast("string").alias("Patient_Name")), person).alias("seen")))
    text = F.to_json(F.struct(kind.alias("record_type"), row.alias("source_row_id"), F.col("encounter_date").cast("string").alias("visit_date"), F.col("patient_id").alias("person"), "fever", extra.alias("extra")))
    # The second kind spells its key with an escape; a visit of both kinds is of the first.
    text = F.when((k % 1021 == 0) & (k % 1013 != 0), F.replace(text, F.lit("Patient_Name"), F.lit("patient\\u004eame"))).otherwise(text)
    return e.select(F.col("month").alias("artefact"), k.alias("id"), F.when(k % 1019 == 0, F.substring(text, 1, 20)).otherwise(text).alias("line"))
