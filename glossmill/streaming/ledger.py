"""First rows of a stream by key, with the keys seen so far in the stream's own state.

A batch looks up the keys that it has, so what it reads doesn't grow with what came before. State lies in RocksDB on the
executors, with changes and snapshots in the checkpoint folder; it moves with its partition when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Sets the session's state store, which a stream takes over when it begins."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _nulls_first(value: object) -> tuple:
    """Sorts nulls (and NaN) before values."""
    return (0,) if value is None or value != value else (1, value)


class _FirstRows(StatefulProcessor):
    """Of a key that has no state: its least row by the order, once; the state then says that the key was seen.

    Keys have few rows each, so rows come as they are: a frame for each key costs many times what is done with it.
    """

    def __init__(self, names: list[str], order: list[str], expire_ms: int | None) -> None:
        self.at, self.expire_ms = [names.index(o) for o in order], expire_ms  # metadata columns of files come without their names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at boolean", self.expire_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        if self.seen.exists():
            for _ in rows:
                pass
            return
        best = min(rows, key=lambda r: [_nulls_first(r[i]) for i in self.at], default=None)
        if best is not None:
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, order: list[str], expire_hours: float | None = None) -> DataFrame:
    """The first row of each key, once over all batches: the least by ``order`` in the batch that brings the key first.

    With ``expire_hours`` a key is forgotten so long after it was seen, and counts as new. Rows of one key are read one at a time.
    A null key is a key. ``order`` should tell rows of a key apart, so that a batch that is run again gives the same.
    """
    keep_state_on_disk(stream.sparkSession)
    made = _FirstRows(stream.columns, order, int(expire_hours * 3_600_000) if expire_hours else None)
    return stream.groupBy(key).transformWithState(statefulProcessor=made, outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime" if expire_hours else "None")
