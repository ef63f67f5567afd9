"""Incremental forms of resume, metrics and label updates.

The same operators run on streams of files; ``availableNow`` makes each call a
catch-up run that picks up what is new since the last one and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clipsight.operators import evaluate, review
from clipsight.sources import readers
from clipsight.sources.label_store import BUCKETS, LabelStore


def new_files(spark: SparkSession, root: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Stream of the rows in files that have not been processed yet."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(root)


def process_pending(
    source: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Apply a row-wise workflow to what is new and append it to ``target``.

    The checkpoint takes the place of the anti-join against finished outputs.
    """
    return (
        work(source)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_metrics(predictions: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Confusion counts kept as streaming state, one row per experiment.

    Only the changed experiments of a batch are written, under ``batch=N``; the
    highest batch per experiment is current (see ``latest_metrics``).
    """
    counts = predictions.groupBy("exp_name").agg(*evaluate.confusion())

    def save(changed: DataFrame, batch: int) -> None:
        evaluate.with_scores(changed).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def latest_metrics(spark: SparkSession, target: str) -> DataFrame:
    return review.last_per_key(spark.read.parquet(target), "exp_name", "batch").drop("batch")


def apply_label_updates(updates: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS, compact_at: int = 8) -> StreamingQuery:
    """Upsert streamed label updates (``seq``, ``rel_path``, label columns) into the ``LabelStore`` below ``folder``.

    A batch writes its own rows; buckets with ``compact_at`` deltas are folded
    afterwards.  Replaying a batch after a failure gives the same store: its paths are
    then present and are overwritten with the same values.
    """
    def merge(batch: DataFrame, _: int) -> None:
        store = LabelStore(batch.sparkSession, folder, buckets)
        store.update(batch)
        store.compact(compact_at)

    return (
        updates.select("seq", "rel_path", *[F.col(c) for c in review.LABEL_COLUMNS])
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )


def label_updates(spark: SparkSession, root: str) -> DataFrame:
    """Stream of label updates dropped as JSON lines below ``root``."""
    schema = "seq long, " + ", ".join(f"{c} string" for c in readers.LABEL_NAMES)
    return new_files(spark, root, schema, "json")
