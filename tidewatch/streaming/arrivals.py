"""Event arrivals as Structured Streaming, without loss: the figures are the same for one file, many files and any order.

Events are dealt to slots by a hash of their ids. A slot's state (transformWithState) holds the ids of the last days that
it has counted, and the newest time that it has seen; ids leave the state when they fall behind that time by `late`. A
repeated id within the horizon is dropped there. A row older than the horizon cannot be judged by the state: it is late
and goes, whole, to a table of its own, from which figures() folds it in as a correction unless its id was counted
before. No watermark filters rows in front of the state, so nothing is dropped unseen.

An id names one event: rows of one id are the same row. The sink writes under the batch's number, so a batch that runs
again after a failure writes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators import stored
from tidewatch.plans.registry import query
from tidewatch.streaming import stateful

LATE_DAYS = 2
EVENT = "event_id long, ts timestamp, event_type string, value double"
ROWS = f"{EVENT}, late boolean, batch long"


class Recent(StatefulProcessor):
    """Of a slot: the ids counted within `late` microseconds of the newest time, and that time."""

    def __init__(self, late: int) -> None:
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "newest long, ids binary, times binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.recent.get()
        newest, ids, times = (held[0], np.frombuffer(held[1], np.int64), np.frombuffer(held[2], np.int64)) if held else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        # Lateness is judged by the time that was newest before this batch, so the order within it has no effect.
        edge = None if newest is None else newest - self.late
        for pdf in rows:
            us = pdf["us"].to_numpy()
            late = us < edge if edge is not None else np.zeros(len(us), bool)
            fresh = ~late & ~np.isin(pdf["event_id"].to_numpy(), ids) & ~pdf["event_id"].duplicated().to_numpy()
            ids, times = np.concatenate([ids, pdf["event_id"].to_numpy()[fresh]]), np.concatenate([times, us[fresh]])
            newest = max(int(us.max()), newest) if newest is not None else int(us.max())
            out = pdf[fresh | late][["event_id", "ts", "event_type", "value"]]
            yield out.assign(late=late[fresh | late])
        kept = times >= newest - self.late
        self.recent.update((newest, ids[kept].tobytes(), times[kept].tobytes()))

    def close(self) -> None:
        pass


def judged(events: DataFrame, late_days: int, slots: int) -> DataFrame:
    """The rows of a stream that count, and the late ones, told apart by `late`."""
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").where("event_id IS NOT NULL AND ts IS NOT NULL")
    e = e.withColumns({"us": F.unix_micros("ts"), "slot": F.pmod(F.xxhash64("event_id"), F.lit(slots))})
    return e.groupBy("slot").transformWithStateInPandas(Recent(late_days * 86_400_000_000), f"{EVENT}, late boolean", "Append", "None")


def by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))


def run_available(spark: SparkSession, path: str, folder: str, files: int = 1000, late_days: int = LATE_DAYS, slots: int = 32) -> DataFrame:
    """Runs the stream over the files that a glob names, `files` a batch, and gives the figures. State and output are in
    `folder`; a later call with the same folder (and slots) goes on with new files."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        done = batch.sparkSession.read.schema(f"{EVENT}, late boolean").parquet(f"{folder}/rows/batch={number}")
        by_day(done.where("NOT late")).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    stateful.run(judged(stream, late_days, slots), write, f"{folder}/state", slots)
    return figures(spark, folder)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{folder}/rows")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Late rows whose ids were not counted before, once each: the corrections."""
    late = _rows(spark, folder).where("late").dropDuplicates(["event_id"])
    return late.join(_rows(spark, folder).where("NOT late").select("event_id"), "event_id", "left_anti")


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """day, event_type, n, total, late: the counts of all batches with their corrections, and how many rows came as such."""
    counts = spark.read.schema("day date, event_type string, n long, total long").parquet(f"{folder}/counts").select("day", "event_type", "n", "total", F.lit(0).cast("long").alias("late"))
    fixed = by_day(late_rows(spark, folder)).select("day", "event_type", "n", "total", F.col("n").alias("late"))
    return counts.union(fixed).groupBy("day", "event_type").agg(*(F.sum(c).alias(c) for c in ("n", "total", "late")))


_DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY ALL"


@query("streamed_daily_counts", _DAILY)
def streamed_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every day and type by a stream that ends when all files are read."""
    return run_available(spark, f"{sf_dir}/event[s].parquet", stored.own_folder(spark, "arrivals")).drop("late")


@query("streamed_scattered_counts", _DAILY)
def streamed_scattered_counts(spark: SparkSession, sf_dir: str, files: int = 24) -> DataFrame:
    """The same from events that come by days in no order, in many files and batches, most of them late."""
    folder = stored.own_folder(spark, "arrivals")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(files, F.sha2(F.col("ts").cast("date").cast("string"), 256)).write.parquet(f"{folder}/input")
    return run_available(spark, f"{folder}/input", folder, max(1, files // 6)).drop("late")
