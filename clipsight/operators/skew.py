"""Joins and ordered scans that hold up when one key has a large share of the rows.

* ``lookup_join`` joins a fact table to a table with few rows per key.  Adaptive
  execution measures the shuffled sides: it broadcasts a small one and splits a
  skewed one, so nothing is evaluated to decide beforehand.
* ``ordered_segments`` / ``positions`` number rows in order per key.  Keys that
  fit one task use a plain window; otherwise rows are range-partitioned on
  (key, order), so a heavy key covers several consecutive segments, and each
  segment's offset comes from a tiny table (at most two rows per segment).
* ``asof_join`` finds the last row at or before a time by sorting both sides
  together along the same segments.

``spark.clipsight.rowsPerTask`` sets how many rows of a key one task may take.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsight.session import ensure_checkpoint_dir

ROWS_PER_TASK = 4_000_000


def task_rows(df: DataFrame, given: int | None = None) -> int:
    """Rows of one key that a single task may be asked to take."""
    return int(df.sparkSession.conf.get("spark.clipsight.rowsPerTask", str(ROWS_PER_TASK))) if given is None else given


def lookup_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", *, bounded: bool = False) -> DataFrame:
    """Join ``facts`` to ``lookup`` on ``on`` (``left``, ``inner``, ``left_semi`` or ``left_anti``).

    ``bounded=True`` states that the lookup is a fixed small table.
    """
    return facts.join(F.broadcast(lookup) if bounded else lookup, list(on), how)


def has_heavy_key(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> bool:
    """Whether any key has more rows than one task should take (counts combine on the map side)."""
    rows = task_rows(df, rows)
    return not df.select(*keys).groupBy(*keys).count().filter(F.col("count") > rows).limit(1).isEmpty()


def ordered_segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows_per_task: int | None = None
) -> tuple[DataFrame, bool]:
    """Add ``_seg`` so that (keys, _seg) is a bounded run of each key's order.

    Returns the frame and whether any key spans several segments.  The range
    split points come from sampling, so the split rows are checkpointed: later
    stages must all see the same segments, also after an executor is lost.
    """
    rows_per_task = task_rows(df, rows_per_task)
    if not has_heavy_key(df, keys, rows_per_task):
        return df.withColumn("_seg", F.lit(0)), False
    ensure_checkpoint_dir(df.sparkSession)
    pieces = max(2, -(-df.count() // rows_per_task) * 2)
    ranged = df.repartitionByRange(pieces, *keys, *order).withColumn("_seg", F.spark_partition_id())
    return ranged.checkpoint(), True


def spanning(summary: DataFrame, keys: Sequence[str], seg: str = "_seg") -> DataFrame:
    """Summary rows of the keys that cover more than one segment (at most two per segment)."""
    several = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return summary.join(several, list(keys), "left_semi")


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "pos",
    total: str | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Dense 0-based position per key in the given (unique) order; optionally the key's row count."""
    return positions_and_size(df, keys, order, name, total, rows_per_task)[0]


def positions_and_size(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "pos",
    total: str | None = None,
    rows_per_task: int | None = None,
) -> tuple[DataFrame, bool]:
    """The same, and whether any key is too large for one task: later steps need not ask again."""
    keys = list(keys)
    rows, split = ordered_segments(df, keys, order, rows_per_task)
    run = Window.partitionBy(*keys, "_seg")
    out = rows.withColumn(name, (F.row_number().over(run.orderBy(*order)) - 1).cast("long"))
    if total:
        out = out.withColumn(total, F.count(F.lit(1)).over(run))
    if not split:
        return out.drop("_seg"), False
    # One row per (spanning key, segment): bounded by twice the number of segments.
    sizes = spanning(rows.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_rows")), keys)
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(
        *keys,
        "_seg",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(by_key).alias("_all"),
    )
    out = out.join(carry, [*keys, "_seg"], "left").withColumn(
        name, F.col(name) + F.coalesce("_before", F.lit(0))
    )
    if total:
        out = out.withColumn(total, F.coalesce("_all", F.col(total)))
    return out.drop("_seg", "_before", "_all"), True


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, name: str, rows_per_task: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` from a key's first row in the given (unique) order to this one."""
    keys = list(keys)
    rows, split = ordered_segments(df, keys, order, rows_per_task)
    run = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(name, F.sum(value).over(run))
    if not split:
        return out.drop("_seg")
    sums = spanning(rows.groupBy(*keys, "_seg").agg(F.sum(value).alias("_sum")), keys)
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_seg", F.sum("_sum").over(before).alias("_before"))
    out = out.join(carry, [*keys, "_seg"], "left")
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_seg", "_before")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    time: str,
    order: Sequence[str] = (),
    clamp: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """``left`` with ``found``: the row of ``right`` of the same key that is last at or before ``time``.

    Both sides are sorted together by (key, time), the right one first, and its last
    row is carried along: rows in and out are those of the two tables, whatever the
    times.  A heavy key covers several range segments; what a segment ends with is
    handed on in one row.  Of right rows at the same time the greatest by ``order``
    counts.  Without a row at or before it ``found`` is null, or with ``clamp`` the
    key's first row.  Rows of ``left`` without key or time find nothing.
    """
    value = F.struct(*[c for c in right.columns if c != key])
    kind = right.select(value.alias("v")).schema["v"].dataType
    own = left.select(F.struct("*").alias("v")).schema["v"].dataType
    tie = F.struct(F.lit(0).alias("_"), *order)
    tie_kind = right.select(tie.alias("v")).schema["v"].dataType
    asked = left.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(tie_kind).alias("_tie"),
                        F.struct("*").alias("_row"), F.lit(None).cast(kind).alias("_found"))
    given = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), F.lit(None).cast(own).alias("_row"), value.alias("_found"))
    known = F.col("_key").isNotNull() & F.col("_t").isNotNull()
    along = ["_t", "_side", "_tie"]
    rows, split = ordered_segments(asked.filter(known).unionAll(given), ["_key"], along, rows_per_task)
    run = Window.partitionBy("_key", "_seg").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_found", F.last("_found", ignorenulls=True).over(run))
    if split:
        # At most two rows per segment: what it ends with goes to the next ones of its key.
        place = F.when(F.col("_side") == 0, F.struct(*along))
        ends = rows.groupBy("_key", "_seg").agg(F.max_by("_found", place).alias("_end"))
        before = Window.partitionBy("_key").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        carry = spanning(ends, ["_key"]).select("_key", "_seg", F.last("_end", ignorenulls=True).over(before).alias("_before"))
        out = out.join(carry, ["_key", "_seg"], "left").withColumn("_found", F.coalesce("_found", "_before")).drop("_before")
    out = out.filter("_side = 1")
    if clamp:
        first = given.groupBy("_key").agg(F.min_by("_found", F.struct("_t", "_tie")).alias("_first"))
        out = lookup_join(out, first, ["_key"]).withColumn("_found", F.coalesce("_found", "_first"))
    found = out.select("_row.*", F.col("_found").alias("found"))
    return found.unionAll(left.filter(F.col(key).isNull() | F.col(time).isNull()).withColumn("found", F.lit(None).cast(kind)))
