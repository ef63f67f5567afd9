"""Manual review: flags, label store with upserts, walking the unskipped clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsight.functions import text
from clipsight.operators.skew import has_heavy_key, lookup_join, task_rows

LABEL_COLUMNS = ["label", "heuristic", "comment"]


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` per key.

    ``max_by`` keeps one candidate per map task and key, so a key with a large
    share of the rows costs no more than any other.
    """
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def parse_flags(log: DataFrame) -> DataFrame:
    """``(rel_path, detail)`` from log lines (``line_no``, ``line``); the last line per path wins."""
    hits = log.select(
        text.log_path(F.col("line")).alias("rel_path"), text.log_detail(F.col("line")).alias("detail"), "line_no"
    ).filter("rel_path is not null")
    return last_per_key(hits, "rel_path", "line_no").select("rel_path", "detail")


def with_heuristic(clips: DataFrame, flags: DataFrame) -> DataFrame:
    """Add ``heuristic`` (FLAGGED / OK) and the flag's ``detail``."""
    listed = flags.withColumn("_flagged", F.lit(True))
    return (
        lookup_join(clips, listed, ["rel_path"])
        .withColumn("heuristic", F.when(F.col("_flagged"), F.lit("FLAGGED")).otherwise(F.lit("OK")))
        .drop("_flagged")
    )


def with_labels(clips: DataFrame, store: DataFrame) -> DataFrame:
    """Add the stored label of each clip (the last row of its path)."""
    latest = last_per_key(store, "rel_path", "row_no").drop("row_no")
    return lookup_join(clips, latest, ["rel_path"])


def upsert_labels(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply updates to the label store (``row_no``, ``rel_path``, label columns).

    Every stored row of an updated path is overwritten in place; paths new to the
    store are appended in update order.  Several updates of one path: the last
    ``seq`` counts, placed where the first one was appended.
    """
    latest = (
        updates.groupBy("rel_path")
        .agg(F.max_by(F.struct(*LABEL_COLUMNS), "seq").alias("u"), F.min("seq").alias("first_seq"))
    )
    # One pass: a stored row without update, with one, or an update without a stored row.
    met = store.join(latest, "rel_path", "full_outer")
    start = store.agg((F.coalesce(F.max("row_no"), F.lit(-1)) + 1).alias("_start"))
    chosen = lambda c: F.when(F.col("u").isNull(), F.col(c)).otherwise(F.col(f"u.{c}")).alias(c)
    return met.select(
        F.coalesce("row_no", (start.scalar() + F.col("first_seq")).cast("long")).alias("row_no"),
        "rel_path",
        *[chosen(c) for c in LABEL_COLUMNS],
    )


def next_previous(queue: DataFrame, folder: str, rows_per_task: int | None = None, large: bool | None = None) -> DataFrame:
    """Add positions of the neighbouring unskipped clips and the landing position.

    ``queue`` has ``folder``, a dense ``pos`` within it, and ``skipped``.
    ``next_pos`` / ``prev_pos`` are NULL at the ends.  ``landing_pos`` is where a
    jump forward to the clip ends up: itself, else the next, else the previous
    unskipped clip, else itself; ``landing_back_pos`` the same for a jump back,
    which looks back first.  Folders longer than ``rows_per_task`` are cut into blocks
    of positions; what lies beyond a block comes from one row per block.  ``large``
    says whether there are any, where the caller knows.
    """
    rows_per_task = task_rows(queue, rows_per_task)
    pos = F.when(~F.col("skipped"), F.col("pos"))
    if not (has_heavy_key(queue, [folder], rows_per_task) if large is None else large):
        run = Window.partitionBy(folder).orderBy("pos")
        out = queue.withColumns(
            {
                "next_pos": F.first(pos, ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing)),
                "prev_pos": F.last(pos, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)),
            }
        )
    else:
        blocks = queue.withColumn("_b", F.floor(F.col("pos") / rows_per_task))
        run = Window.partitionBy(folder, "_b").orderBy("pos")
        ends = blocks.groupBy(folder, "_b").agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
        along = Window.partitionBy(folder).orderBy("_b")
        beyond = ends.select(
            folder,
            "_b",
            F.min("_lo").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
            F.max("_hi").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        )
        near = blocks.withColumns(
            {
                "_next": F.first(pos, ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing)),
                "_prev": F.last(pos, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)),
            }
        )
        out = (
            near.join(beyond, [folder, "_b"])
            .withColumns({"next_pos": F.coalesce("_next", "_after"), "prev_pos": F.coalesce("_prev", "_before")})
            .drop("_b", "_next", "_prev", "_after", "_before")
        )
    return out.withColumns(
        {
            "landing_pos": F.coalesce(pos, "next_pos", "prev_pos", "pos"),
            "landing_back_pos": F.coalesce(pos, "prev_pos", "next_pos", "pos"),
        }
    )


def passed_over(queue: DataFrame) -> DataFrame:
    """Skipped clips with the step that passes over them: from ``prev_pos`` to ``next_pos``.

    One row per skipped clip, so a long run of skipped clips is never collected.
    """
    return queue.filter("skipped").select("folder", "prev_pos", "next_pos", "pos", "rel_path")
