"""Series in long form: one row per sample (``key``, ``i``, ``v``, ``h``), ``i`` dense from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsight.functions import series as S
from clipsight.operators.skew import asof_join, has_heavy_key, lookup_join


def explode_series(clips: DataFrame, key: str, series: str, hz: float) -> DataFrame:
    """Array form to long form with the time axis ``t = i / hz``."""
    return clips.select(key, F.posexplode(series).alias("i", "s")).select(
        key, F.col("i").cast("long").alias("i"), (F.col("i") / F.lit(float(hz))).alias("t"), "s.v", "s.h"
    )


def collect_series(samples: DataFrame, key: str) -> DataFrame:
    """Long form back to one array per clip: each clip must fit a row, else keep the long form."""
    pair = F.struct("i", F.struct("v", "h").alias("s"))
    return samples.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["s"]).alias("series")
    )


def window_means(samples: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """``(key, n, start_v, end_v, max_abs_h)`` from the start and end windows.

    The windows depend on a clip's length.  With clips that fit a task, one
    shuffle by clip serves the length, the windows and the means.  A longer clip
    is not gathered: lengths are aggregated first (combining on the map side)
    and reach the samples through ``lookup_join``.
    """
    used = samples.select(key, "i", "v", F.abs("h").alias("_abs_h"))
    if not has_heavy_key(used, [key], rows_per_task):
        clip = Window.partitionBy(key)
        sized = used.withColumns(
            {"n": F.count(F.lit(1)).over(clip), "max_abs_h": F.max("_abs_h").over(clip)}
        )
    else:
        sizes = used.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("_abs_h").alias("max_abs_h"))
        sized = lookup_join(used, sizes, [key], "inner")
    bounded = sized.withColumn("b", S.window_bounds(F.col("n")))
    i, v = F.col("i"), F.col("v")
    in_start = (i >= F.col("b.i0")) & (i < F.col("b.i1"))
    in_end = (i >= F.col("b.j0")) & (i < F.col("b.j1"))
    return (
        bounded.filter(in_start | in_end)
        .groupBy(key)
        .agg(
            F.max("n").alias("n"),
            F.avg(F.when(in_start, v)).alias("start_v"),
            F.avg(F.when(in_end, v)).alias("end_v"),
            F.max("max_abs_h").alias("max_abs_h"),
        )
    )


def trim_to_duration(samples: DataFrame, hz: float, duration: str = "duration_s") -> DataFrame:
    """Drop samples after the clip's end; the first sample stays, unusable durations keep all."""
    d = F.col(duration)
    if hz <= 0:
        return samples
    inside = F.col("i") / F.lit(float(hz)) <= d + S.d(S.TIME_SLACK)
    return samples.filter(d.isNull() | (d <= 0) | (F.col("i") == 0) | inside)


def axis_range(samples: DataFrame, key: str) -> DataFrame:
    """Speed axis per clip: the nominal range, widened to the data."""
    return samples.groupBy(key).agg(
        F.least(S.d(S.NOMINAL_LO), F.min("v")).alias("y_lo"),
        F.greatest(S.d(S.NOMINAL_HI), F.max("v")).alias("y_hi"),
    )


# Axis titles of the two series.
AXIS_TITLES = {"velocity": "Velocity (mph)", "heading": "Heading (deg)"}


def unpivot_series(samples: DataFrame, key: str) -> DataFrame:
    """Speed and heading as two labelled series in one ``value`` column."""
    long = samples.select(key, "i", F.col("v").alias("velocity"), F.col("h").alias("heading")).unpivot(
        [key, "i"], ["velocity", "heading"], "series", "value"
    )
    titles = F.create_map(*[F.lit(x) for pair in AXIS_TITLES.items() for x in pair])
    return long.withColumn("y_label", titles[F.col("series")])


def cursor_samples(samples: DataFrame, cursors: DataFrame, key: str, hz: float) -> DataFrame:
    """Clamp each cursor time to the series and add the last sample at or before it.

    The sample index follows from the clamped time, so the lookup is an equi-join
    on (key, i) instead of a range join.
    """
    ends = samples.groupBy(key).agg(F.max("i").alias("_last"))
    rate = F.lit(float(hz))
    clamped = lookup_join(cursors, ends, [key], "inner").withColumn(
        "cursor_t", F.greatest(S.d(0), F.least(F.col("t"), F.col("_last") / rate))
    )
    # The product may fall on either side of a whole number; the times decide.
    guess = F.floor(F.col("cursor_t") * rate).cast("long")
    at = F.least(
        F.when((guess + 1) / rate <= F.col("cursor_t"), guess + 1)
        .when(guess / rate > F.col("cursor_t"), guess - 1)
        .otherwise(guess),
        F.col("_last"),
    )
    # Many cursors past the end of one clip meet at its last sample, hence no plain join.
    placed = clamped.withColumn("i", at).drop("_last")
    return lookup_join(placed, samples.select(key, "i", "v", "h"), [key, "i"], "inner")


def cursor_samples_at(
    samples: DataFrame, cursors: DataFrame, key: str, time: str = "t", order: Sequence[str] = (), rows_per_task: int | None = None
) -> DataFrame:
    """The same for series whose samples stand at any times: cursors with ``cursor_t`` and the sample's columns.

    A cursor before the first sample takes the first, one after the last the last;
    cursors of clips without samples are left out.  ``order`` decides between
    samples of the same time, the greatest counts.
    """
    ends = samples.filter(F.col(time).isNotNull()).groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    clamped = lookup_join(cursors, ends, [key], "inner").withColumn("cursor_t", F.greatest("_lo", F.least(F.col(time), F.col("_hi")))).drop("_lo", "_hi")
    met = asof_join(clamped.withColumnRenamed(time, "_asked").withColumn(time, F.col("cursor_t")), samples, key, time, order, rows_per_task=rows_per_task)
    values = [c for c in samples.columns if c not in (key, time)]
    return met.drop(time).withColumnRenamed("_asked", time).select(*cursors.columns, "cursor_t", *[F.col(f"found.`{c}`").alias(c) for c in values])
