"""Tables in the folder that driver and executors share: intermediate ones, and evaluations under the hash of their inputs.

An evaluation's folder is named by a hash of its name, version, parameters and the files of its input tables (paths,
lengths, times). The first call writes it, later calls with the same inputs read it, in this session or another one. A
table is written aside and then renamed, so that a reader sees it whole or not at all; of two writers one wins.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LATER: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session in one process may leave it unset and gets a temporary one;
    on a cluster that is an error, as executors would not see a folder of the driver's."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        _LATER.append((spark, folder))
    return folder.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder, dropped when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _LATER.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own, read again: it cuts the lineage and outlives any executor."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_written() -> None:
    while _LATER:
        spark, path = _LATER.pop()
        try:
            target, files = _path(spark, path)
            files.delete(target, True)
        except Exception:  # the session may have ended before
            pass


atexit.register(drop_written)


def files_of(spark: SparkSession, path: str) -> list[list]:
    """Path, length and time of every file of a table."""
    target, files = _path(spark, path)
    found, out = files.listFiles(target, True), []
    while found.hasNext():
        f = found.next()
        out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def evaluation(spark: SparkSession, name: str, version: str, tables: list[str], build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """The table that build() gives for input tables (paths), written once under the hash of all that it depends on. Files
    that are written anew have other times, so a changed input makes another evaluation."""
    inputs = json.dumps([name, version, {t: files_of(spark, t) for t in tables}, parameters], sort_keys=True, default=str)
    path = f"{shared_folder(spark)}/evaluations/{name}-{hashlib.sha256(inputs.encode()).hexdigest()}"
    target, files = _path(spark, path)
    if not files.exists(target):
        aside = f"{shared_folder(spark)}/evaluations/_{uuid.uuid4().hex}"
        build().write.parquet(aside)
        # Where the folder came to be meanwhile, the rename fails, or puts this table beneath it under a name that readers skip.
        if files.exists(target) or not files.rename(_path(spark, aside)[0], target):
            files.delete(_path(spark, aside)[0], True)
    return spark.read.parquet(path)
