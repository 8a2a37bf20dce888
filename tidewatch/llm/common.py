"""What the operators of this subpackage share: tables, materialised stages, word rules, compact integer lists."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other characters than these (space, tab, line feed, vertical tab, form feed, return).
WORD_BREAK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A session in one process may leave it unset and gets
    a temporary folder of its own; on a cluster that is an error, as executors would not see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    return folder.rstrip("/")


_OWN: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage and outlives any executor.

    The table goes by drop_written(), or else when the driver's Python ends, as results that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    dropped_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_LATER: list[tuple[SparkSession, str]] = []


def dropped_later(spark: SparkSession, path: str) -> None:
    _LATER.append((spark, path))


def drop_written(keep: int = 0) -> None:
    """Drops what written() has made since there were `keep` tables; for use when all results that read them are written."""
    while len(_LATER) > keep:
        _drop(*_LATER.pop())


def n_written() -> int:
    return len(_LATER)


atexit.register(drop_written)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


def give_back() -> None:
    """Returns memory that Arrow and the C library hold but do not use, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forgetting(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow or mapInPandas, that calls `forget` and gives memory back when a task ends."""

    def ending(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return ending


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most so many rows, as texts may be long."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def words(text: Column) -> Column:
    """The words of a text (null: none), as a native array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold (null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as gaps: whole multiples of 256**k as runs of 255 and a byte, then k raw bytes a gap."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    if not len(gaps):
        return b""
    mean, k = float(values[-1]) / len(values), 0
    while mean >= 192 and k < 7:
        mean, k = mean / 256, k + 1
    high, low = gaps >> np.uint64(8 * k), gaps
    runs = high // np.uint64(255)
    ends = np.cumsum(runs + np.uint64(1)).astype(np.int64) - 1
    body = np.full(ends[-1] + 1, 255, np.uint8)
    body[ends] = high % np.uint64(255)
    raw = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].tobytes()
    return np.array([k, len(gaps)], "<i8").tobytes() + raw + body.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    k, n = np.frombuffer(data, "<i8", 2)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :k] = np.frombuffer(data, np.uint8, n * k, 16).reshape(n, k)
    body = np.frombuffer(data, np.uint8, offset=16 + n * k)
    sums = np.cumsum(body, dtype=np.uint64)[body != 255]
    high = np.diff(sums, prepend=np.uint64(0))
    gaps = (high << np.uint64(8 * k)) | raw.view("<u8").ravel() if k else high
    return np.cumsum(gaps, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
