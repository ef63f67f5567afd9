"""Label updates with state per path: the last write wins, superseded rows are never written.

A path's newest update waits in the state store.  While newer ones come, they replace it;
when none has come for ``quiet``, a timer writes it once and drops the state.  So the
target has a row per path and burst of edits, and state only of paths in motion.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from clipsight.operators import review

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUES = "seq long, " + ", ".join(f"{c} string" for c in review.LABEL_COLUMNS)
SETTLED = f"rel_path string, {VALUES}, superseded long"


class LastWrite(StatefulProcessor):
    """Keeps the update with the highest ``seq`` of a path until no newer one has come for ``quiet_ms``."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", f"{VALUES}, superseded long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        due, seen = 0, 0
        for batch in rows:
            top = batch.loc[batch["seq"].idxmax()]
            seen += len(batch)
            due = max(due, int(batch["arrived_ms"].max()) + self.quiet_ms)
            if held is None or top["seq"] >= held[0]:
                values = [None if pd.isna(top[c]) else top[c] for c in review.LABEL_COLUMNS]
                held = (int(top["seq"]), *values, held[-1] if held else 0)
        self.newest.update((*held[:-1], held[-1] + seen))
        for timer in list(self.handle.listTimers()):
            due = max(due, timer)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.newest.get()
        self.newest.clear()
        names = ["rel_path", "seq", *review.LABEL_COLUMNS, "superseded"]
        yield pd.DataFrame([(key[0], *held[:-1], held[-1] - 1)], columns=names)

    def close(self) -> None:
        pass


def settle_labels(updates: DataFrame, target: str, checkpoint: str, quiet_s: int = 600, late: str = "1 hour") -> StreamingQuery:
    """Write the settled update of every path below ``target``; catches up with what is there and stops.

    ``updates`` is a stream with ``seq``, ``rel_path``, the label columns and
    ``arrived``, the time an update came in (up to ``late`` out of order).  Time runs
    with the stream: updates that nothing has followed for ``quiet_s`` and ``late`` wait
    in the state for the next run.
    """
    spark = updates.sparkSession
    marked = updates.withColumn("arrived_ms", F.unix_millis(F.col("arrived").cast("timestamp"))).withWatermark("arrived", late)
    settled = marked.groupBy("rel_path").transformWithStateInPandas(
        statefulProcessor=LastWrite(quiet_s * 1000), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # the query keeps the setting it was started with
    try:
        return (
            settled.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def settled_labels(spark: SparkSession, target: str) -> DataFrame:
    """(rel_path, seq, label columns): the settled label of every path."""
    return review.last_per_key(spark.read.schema(SETTLED).parquet(target).drop("superseded"), "rel_path", "seq")
