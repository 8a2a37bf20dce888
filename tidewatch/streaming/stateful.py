"""Starting streams with keyed state, and what their sinks have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(rows: DataFrame, write: Callable[[DataFrame, int], None], state: str, keys: int) -> None:
    """Runs a stream with transformWithState over all that is there, a call of write a batch. Its state store is RocksDB, in no
    more partitions than about `keys` can fill, for this stream only; a state folder keeps the number that it began with."""
    conf = rows.sparkSession.conf
    own = {PROVIDER: ROCKSDB, PARTITIONS: str(min(keys, int(conf.get(PARTITIONS))))}
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        started = rows.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
        started.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)
