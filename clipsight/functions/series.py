"""Expressions over one clip's samples held as an array in its row (no shuffle).

A pose is ``struct<px,pz,fx,fz>`` (metres; X right, Z ahead) and a sample is
``struct<v,h>`` (mph, degrees).  Clips are short (tens of samples), so these run
inside the scan stage.  For long series use ``operators.kinematics`` /
``operators.trajectory`` on one row per sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factor, start-speed span, windows and thresholds of the check.
MPH_PER_MPS = 2.2369362921
START_STEPS = 5
EDGE_LO, EDGE_HI = 0.05, 0.2
DECELERATE_BELOW = 0.6
ACCELERATE_ABOVE = 1.4
MAINTAIN_LO, MAINTAIN_HI = 0.6, 1.6
STEER_DEGREES = 5.0
NOMINAL_LO, NOMINAL_HI = 0.0, 20.0
TINY = 1e-6
TIME_SLACK = 1e-9

SAMPLE_TYPE = "array<struct<v:double,h:double>>"


def d(x: float) -> Column:
    return F.lit(float(x))


def yaw(fx: Column, fz: Column) -> Column:
    return F.atan2(fx, fz)


def turn(step: Column) -> Column:
    """Whole turns to add so that a yaw step stays within half a turn.

    Counting turns as integers keeps running sums exact in any order.
    """
    return F.when(step > math.pi, -1).when(step < -math.pi, 1).otherwise(0)


def ground_step(px0: Column, pz0: Column, px1: Column, pz1: Column) -> Column:
    dx, dz = px1 - px0, pz1 - pz0
    return F.sqrt(dx * dx + dz * dz)


def mph(distance: Column, hz: Column) -> Column:
    return distance * hz * d(MPH_PER_MPS)


def stride_for(native_hz: Column, target_hz: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(native_hz / target_hz)).cast("int")


def _steps(poses: Column, steps: Column) -> Column:
    """The first ``steps`` pairs of neighbouring poses as ``struct<dist,yaw,turn>``.

    Neighbours are zipped rather than looked up by index: arrays captured in a
    lambda would be evaluated again for every element.
    """
    count = steps.cast("int")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(
            ground_step(a["px"], a["pz"], b["px"], b["pz"]).alias("dist"),
            yaw(a["fx"], a["fz"]).alias("yaw"),
            turn(yaw(b["fx"], b["fz"]) - yaw(a["fx"], a["fz"])).alias("turn"),
        )

    return F.zip_with(F.slice(poses, F.lit(1), count), F.slice(poses, F.lit(2), count), pair)


def poses_to_series(poses: Column, hz: float) -> Column:
    """Samples of a pose array; one fewer than the poses, empty below two poses."""
    none = F.array().cast(SAMPLE_TYPE)
    start = F.struct(none.alias("out"), F.lit(0).alias("turns"), F.lit(None).cast("double").alias("yaw0"))

    def add(acc: Column, step: Column) -> Column:
        yaw0 = F.coalesce(acc["yaw0"], step["yaw"])
        sample = F.struct(
            F.round(mph(step["dist"], d(hz)), 4).alias("v"),
            F.round(F.degrees(step["yaw"] - yaw0) + acc["turns"] * d(360), 4).alias("h"),
        )
        return F.struct(
            F.concat(acc["out"], F.array(sample)).alias("out"),
            (acc["turns"] + step["turn"]).alias("turns"),
            yaw0.alias("yaw0"),
        )

    n = F.size(poses)
    return F.when(n >= 2, F.aggregate(_steps(poses, n - 1), start, add, lambda acc: acc["out"])).otherwise(none)


def every(poses: Column, stride: int) -> Column:
    return F.filter(poses, lambda p, i: i % stride == 0)


def start_speed(poses: Column, hz: float) -> Column:
    """Mean speed of the first steps at the native rate; 0 for a single pose."""
    used = F.least(F.size(poses) - 1, F.lit(START_STEPS))
    total = F.aggregate(_steps(poses, used), d(0), lambda acc, s: acc + s["dist"])
    return F.when(used >= 1, mph(total / used, d(hz))).otherwise(d(0))


def window_bounds(n: Column) -> Column:
    """Half-open start and end windows of n samples (half-even rounding, at least one sample)."""
    def edge(share: float) -> Column:
        return F.rint(n.cast("double") * d(share)).cast("long")

    i0, j0 = edge(EDGE_LO), edge(1.0 - EDGE_HI)
    i1 = F.greatest(i0 + 1, edge(EDGE_HI))
    j1 = F.greatest(j0 + 1, edge(1.0 - EDGE_LO))

    def first(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(x, n - 1))

    def last(x: Column) -> Column:
        return F.greatest(F.lit(1), F.least(x, n))

    return F.struct(
        first(i0).alias("i0"), last(i1).alias("i1"), first(j0).alias("j0"), last(j1).alias("j1")
    )


def mean_between(values: Column, lo: Column, hi: Column) -> Column:
    part = F.slice(values, (lo + 1).cast("int"), (hi - lo).cast("int"))
    return F.aggregate(part, d(0), lambda acc, x: acc + x) / F.size(part)


def series_summary(series: Column) -> Column:
    """``struct<start_v,end_v,max_abs_h>``; zeros for an empty series."""
    n = F.size(series)
    b = window_bounds(n.cast("long"))
    v = F.transform(series, lambda s: s["v"])
    h = F.transform(series, lambda s: F.abs(s["h"]))
    empty = n < 1
    return F.struct(
        F.when(empty, d(0)).otherwise(mean_between(v, b["i0"], b["i1"])).alias("start_v"),
        F.when(empty, d(0)).otherwise(mean_between(v, b["j0"], b["j1"])).alias("end_v"),
        F.when(empty, d(0)).otherwise(F.array_max(h)).alias("max_abs_h"),
    )


def trim_to(series: Column, hz: Column, duration: Column) -> Column:
    """Samples within the clip's duration, never fewer than one; unchanged without a usable duration."""
    kept = F.filter(series, lambda s, i: (i == 0) | (i / hz <= duration + d(TIME_SLACK)))
    usable = duration.isNotNull() & (duration > 0) & (hz > 0)
    return F.when(usable, kept).otherwise(series)


def end_start_ratio(start_v: Column, end_v: Column) -> Column:
    return end_v / F.greatest(start_v, d(TINY))


def speed_ok(speed: Column, ratio: Column) -> Column:
    """Whether the speed change meets the expectation; no expectation always passes."""
    return (
        F.when(speed == "decelerate", ratio < d(DECELERATE_BELOW))
        .when(speed == "accelerate", ratio > d(ACCELERATE_ABOVE))
        .when(speed == "maintain", ratio.between(d(MAINTAIN_LO), d(MAINTAIN_HI)))
        .otherwise(F.lit(True))
    )


def steer_ok(steer: Column, max_abs_h: Column) -> Column:
    return ~(F.coalesce(steer, F.lit(False)) & (max_abs_h < d(STEER_DEGREES)))


def series_text(series: Column) -> Column:
    """``[[v, h], ...]`` and a line break: numbers of up to four decimals, never with an exponent."""
    def number(x: Column) -> Column:
        return F.regexp_replace(x.cast("decimal(30,4)").cast("string"), r"(\.\d+?)0+$", "$1")

    rows = F.transform(series, lambda s: F.concat(F.lit("["), number(s["v"]), F.lit(", "), number(s["h"]), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]\n"))
