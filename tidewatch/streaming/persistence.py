"""Runs of flagged months as keyed state: judgements come month by month, in any order and more than once.

A series' state (transformWithState) holds the flagged months within KEEP months of its newest one, so a month between
two runs joins them and a repeated one changes nothing. What falls behind leaves the state: a run that ended before the
horizon is closed and written once; one that reaches into it stays whole, as its first month. A flagged month that comes
behind the horizon is late, goes to the output as such, and found() folds it in for its series alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators import flags, statistics, stored
from tidewatch.plans.registry import query
from tidewatch.streaming import stateful

KEEP, SUSTAINED = 24, 2
#: first, last: numbers of months; kind: open, closed or late.
OUT = "district_id long, first int, last int, kind string"


def runs_of(months: np.ndarray, first: int | None) -> list[tuple[int, int]]:
    """Runs of ascending distinct months; `first` is where the run of the least one began."""
    if not len(months):
        return []
    cut = np.flatnonzero(np.diff(months) != 1)
    starts, ends = months[np.append(0, cut + 1)].tolist(), months[np.append(cut, len(months) - 1)].tolist()
    starts[0] = starts[0] if first is None else first
    return list(zip(starts, ends, strict=True))


class Runs(StatefulProcessor):
    """Of a series: the newest month seen, flagged months within the horizon, and where a run that began before it did so."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("months", "newest int, months binary, first int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        newest, months, first = (held[0], np.frombuffer(held[1], np.int32), held[2]) if held else (None, np.zeros(0, np.int32), None)
        came = np.concatenate([pdf["month"].to_numpy()[pdf["flagged"].to_numpy()] for pdf in rows] or [months[:0]]).astype(np.int32)
        edge = -(1 << 30) if newest is None else newest - self.keep
        late = np.unique(came[came < edge])
        months = np.union1d(months, came[came >= edge]).astype(np.int32)
        if len(months):
            newest = max(int(months[-1]), newest if newest is not None else int(months[-1]))
        runs = runs_of(months, first)
        # A closed run ends two months before the horizon or earlier: no month within it can extend the run. Of an open
        # one, at least the last month stays.
        closed = [r for r in runs if r[1] < newest - self.keep - 1]
        opened = runs[len(closed) :]
        out = [(key[0], a, b, "closed") for a, b in closed] + [(key[0], a, b, "open") for a, b in opened] + [(key[0], m, m, "late") for m in late.tolist()]
        if out:
            yield pd.DataFrame(out, columns=["district_id", "first", "last", "kind"])
        if newest is not None:
            left = months[months >= newest - self.keep - 1]
            began = next((a for a, b in opened if a < left[0] <= b), None)
            self.state.update((newest, left.tobytes(), began))

    def close(self) -> None:
        pass


def number(month: str) -> F.Column:
    return (F.year(month) * 12 + F.month(month) - 1).cast("int")


def run_available(spark: SparkSession, path: str, folder: str, files: int = 1, keep: int = KEEP, series: int = 16) -> DataFrame:
    """Runs the stream over files of judgements (district_id, month, flagged) and gives the runs; the state is in `folder`,
    in partitions for about so many series."""
    stream = spark.readStream.schema("district_id long, month date, flagged boolean").option("maxFilesPerTrigger", files).parquet(path)
    rows = stream.where("flagged").select("district_id", number("month").alias("month"), "flagged")
    runs = rows.groupBy("district_id").transformWithStateInPandas(Runs(keep), OUT, "Append", "None")
    stateful.run(runs, lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/runs/batch={k}"), f"{folder}/state", series)
    return found(spark, folder)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """district_id, first_month, last_month, periods, sustained of every run."""
    r = spark.read.schema(f"{OUT}, batch long").parquet(f"{folder}/runs")
    last = F.max(F.when(F.col("kind") == "open", F.col("batch"))).over(Window.partitionBy("district_id"))
    now = r.withColumn("last_open", last).where("kind <> 'open' OR batch = last_open").select("district_id", "first", "last", "kind")
    behind = now.where("kind = 'late'").select("district_id").distinct()
    whole = now.join(behind, "district_id", "left_anti").select("district_id", "first", "last")
    # Series with late months: their runs as months again, and runs anew.
    m = now.join(behind, "district_id", "left_semi").select("district_id", F.explode(F.sequence("first", "last")).alias("month")).distinct()
    island = F.col("month") - F.row_number().over(Window.partitionBy("district_id").orderBy("month"))
    again = m.withColumn("island", island).groupBy("district_id", "island").agg(F.min("month").alias("first"), F.max("month").alias("last")).drop("island")
    day = lambda c: F.make_date(F.floor(F.col(c) / 12).cast("int"), F.col(c) % 12 + 1, F.lit(1))
    n = (F.col("last") - F.col("first") + 1).cast("long")
    return whole.union(again).select("district_id", day("first").alias("first_month"), day("last").alias("last_month"), n.alias("periods"), (n >= SUSTAINED).alias("sustained"))


@query("streamed_persistence", f"""WITH {flags.CTES}, {statistics._SERIES}, {statistics._JUDGED}, f AS (SELECT district_id, month, extract(year FROM month) * 12 + extract(month FROM month) - row_number() OVER (PARTITION BY district_id ORDER BY month) AS island FROM j WHERE outcome = 'flagged')
SELECT district_id, min(month) AS first_month, max(month) AS last_month, count(*) AS periods, count(*) >= 2 AS sustained FROM f GROUP BY district_id, island""")
def streamed_persistence(spark: SparkSession, sf_dir: str, files: int = 6) -> DataFrame:
    """Runs of flagged months by a stream of judgements whose months come in no order, in several batches."""
    folder = stored.own_folder(spark, "persistence")
    j = statistics.judged(statistics.baselines(statistics.series(spark, sf_dir), ["district_id"]))
    j.select("district_id", "month", (F.col("outcome") == "flagged").alias("flagged")).repartition(files, F.sha2(F.col("month").cast("string"), 256)).write.parquet(f"{folder}/input")
    return run_available(spark, f"{folder}/input", folder)
