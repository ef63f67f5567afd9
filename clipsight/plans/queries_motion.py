"""Queries over poses and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipsight.functions import documents as D
from clipsight.operators import batch, checks, kinematics, trajectory
from clipsight.operators.skew import asof_join, lookup_join, positions
from clipsight.plans import inputs as I
from clipsight.plans import workflows
from clipsight.plans.queries_catalog import (
    CUT_SQL,
    EXPECT_SQL,
    FOLDER,
    LAST_SENTENCE_SQL,
    LEVELS_SQL,
    NEAREST_SQL,
    STEM,
)
from clipsight.plans.registry import Tables, register, with_inputs


def _series_sql(poses: str, hz: int) -> str:
    """Speed and heading of a pose table (clip, i, px, pz, fx, fz)."""
    return f"""
SELECT clip, i, round(sqrt((px1 - px) * (px1 - px) + (pz1 - pz) * (pz1 - pz)) * {hz} * 2.2369362921E0, 4) AS v,
       round(degrees(yaw - yaw0) + 360.0E0 * turns, 4) AS h
FROM (SELECT *, sum(turn) OVER (PARTITION BY clip ORDER BY i) AS turns,
             first_value(yaw) OVER (PARTITION BY clip ORDER BY i) AS yaw0
      FROM (SELECT *, CASE WHEN yaw - lag(yaw) OVER w > pi() THEN -1 WHEN yaw - lag(yaw) OVER w < -pi() THEN 1 ELSE 0 END AS turn,
                   lead(px) OVER w AS px1, lead(pz) OVER w AS pz1
            FROM (SELECT *, atan2(fx, fz) AS yaw FROM {poses})
            WINDOW w AS (PARTITION BY clip ORDER BY i)))
WHERE px1 IS NOT NULL
"""


register(
    "kinematics_native",
    lambda t: kinematics.speed_heading(t.derive(I.POSES), "clip"),
    with_inputs(_series_sql("(SELECT *, k AS i FROM poses)", 10), poses=I.POSES),
)
register(
    "kinematics_5hz",
    lambda t: kinematics.speed_heading(t.derive(I.POSES), "clip", hz=5, stride=2),
    with_inputs(_series_sql("(SELECT *, k // 2 AS i FROM poses WHERE k % 2 = 0)", 5), poses=I.POSES),
)
register(
    "both_rates",
    lambda t: kinematics.both_rates(t.derive(I.POSES), "clip"),
    with_inputs(
        f"""
SELECT clip, i, v, h, 10 AS hz FROM ({_series_sql("(SELECT *, k AS i FROM poses)", 10)})
UNION ALL SELECT clip, i, v, h, 5 AS hz FROM ({_series_sql("(SELECT *, k // 2 AS i FROM poses WHERE k % 2 = 0)", 5)})
""",
        poses=I.POSES,
    ),
)
register(
    "initial_speed",
    lambda t: kinematics.start_speed(t.derive(I.POSES), "clip").withColumn("init_v", F.round("init_v", 4)),
    with_inputs(
        """
SELECT clip, round(coalesce(avg(sqrt((px1 - px) * (px1 - px) + (pz1 - pz) * (pz1 - pz))) * 10 * 2.2369362921E0, 0.0E0), 4) AS init_v
FROM (SELECT *, lead(px) OVER w AS px1, lead(pz) OVER w AS pz1 FROM poses WINDOW w AS (PARTITION BY clip ORDER BY k))
WHERE k < 5 GROUP BY clip
""",
        poses=I.POSES,
    ),
)


def series_in_rows(t: Tables):
    """The same kinematics with each clip's poses held in its row (61 by the way clips are cut)."""
    pose = F.struct("k", F.struct("px", "pz", "fx", "fz").alias("p"))
    clips = t.derive(I.POSES).groupBy("clip").agg(
        F.transform(F.sort_array(F.collect_list(pose)), lambda x: x["p"]).alias("poses")
    )
    moved = kinematics.with_series(clips)
    return moved.select("clip", F.posexplode("series_5hz").alias("i", "s")).select(
        "clip", F.col("i").cast("long").alias("i"), "s.v", "s.h"
    )


register(
    "series_in_rows",
    series_in_rows,
    with_inputs(_series_sql("(SELECT *, k // 2 AS i FROM poses WHERE k % 2 = 0)", 5), poses=I.POSES),
)


def poses_from_actions(t: Tables):
    """Vectors of 64 numbers read as seven 9-number steps."""
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda k: F.slice(F.col("embedding"), k * 9 + 1, F.lit(9)).cast("array<double>")
    )
    moved = kinematics.poses_from_actions(t.derive(I.ACTIONS_LONG).select("vec_id", steps.alias("action")))
    return moved.select("vec_id", F.posexplode("poses").alias("k", "p")).select(
        "vec_id", "k", *[F.round(F.col(f"p.{c}") + 0.0, 4).alias(c) for c in ("px", "pz", "fx", "fz")]
    )


# Gram-Schmidt per step, then a recursive running product.
VECTOR_STEPS_SQL = """
  SELECT vec_id, k, list_transform(embedding[k * 9 + 1 : k * 9 + 9], lambda x: CAST(x AS DOUBLE)) AS s
  FROM embeddings, (SELECT unnest(range(7)) AS k)
"""
PRODUCT_SQL = """
n1 AS (SELECT *, sqrt(s[4]*s[4] + s[5]*s[5] + s[6]*s[6]) AS la FROM raw),
a AS (SELECT vec_id, k, s[1]*1.35E0 AS tx, s[2]*1.35E0 AS ty, s[3]*1.35E0 AS tz, s[4]/la AS ax, s[5]/la AS ay, s[6]/la AS az,
             s[7] AS ux, s[8] AS uy, s[9] AS uz FROM n1),
b0 AS (SELECT *, ax*ux + ay*uy + az*uz AS d FROM a),
b1 AS (SELECT *, ux - d*ax AS wx, uy - d*ay AS wy, uz - d*az AS wz FROM b0),
b AS (SELECT *, wx / sqrt(wx*wx + wy*wy + wz*wz) AS bx1, wy / sqrt(wx*wx + wy*wy + wz*wz) AS by1, wz / sqrt(wx*wx + wy*wy + wz*wz) AS bz1 FROM b1),
step AS (SELECT vec_id, k, tx, ty, tz, ax, ay, az, bx1, by1, bz1,
                ay*bz1 - az*by1 AS cx1, az*bx1 - ax*bz1 AS cy1, ax*by1 - ay*bx1 AS cz1 FROM b),
walk AS (
  SELECT vec_id, CAST(0 AS BIGINT) AS k, 0.0E0 AS px, 0.0E0 AS py, 0.0E0 AS pz,
         1.0E0 AS r11, 0.0E0 AS r12, 0.0E0 AS r13, 0.0E0 AS r21, 1.0E0 AS r22, 0.0E0 AS r23,
         0.0E0 AS r31, 0.0E0 AS r32, 1.0E0 AS r33
  FROM (SELECT DISTINCT vec_id FROM raw)
  UNION ALL
  SELECT w.vec_id, w.k + 1,
         px + r11*tx + r12*ty + r13*tz, py + r21*tx + r22*ty + r23*tz, pz + r31*tx + r32*ty + r33*tz,
         r11*ax + r12*ay + r13*az, r11*bx1 + r12*by1 + r13*bz1, r11*cx1 + r12*cy1 + r13*cz1,
         r21*ax + r22*ay + r23*az, r21*bx1 + r22*by1 + r23*bz1, r21*cx1 + r22*cy1 + r23*cz1,
         r31*ax + r32*ay + r33*az, r31*bx1 + r32*by1 + r33*bz1, r31*cx1 + r32*cy1 + r33*cz1
  FROM walk w JOIN step s ON w.vec_id = s.vec_id AND w.k = s.k)
"""
WALK_SQL = f"WITH RECURSIVE raw AS ({VECTOR_STEPS_SQL}), {PRODUCT_SQL}"
POSES_SQL = WALK_SQL + """
SELECT vec_id, CAST(k AS INT) AS k, round(px, 4) + 0.0E0 AS px, round(pz, 4) + 0.0E0 AS pz,
       round(r13, 4) + 0.0E0 AS fx, round(r33, 4) + 0.0E0 AS fz FROM walk
"""
register("poses_from_actions", poses_from_actions, POSES_SQL)


def poses_from_steps(t: Tables):
    """The vectors strung into three long tracks, the first with three fifths of all steps; short blocks."""
    vec, first = F.col("vec_id"), F.floor(F.col("vec_id") / 5)
    long = vec % 5 < 3
    steps = t.embeddings.select(
        F.when(long, 0).otherwise(vec % 5).cast("long").alias("track"),
        F.when(long, first * 3 + vec % 5).otherwise(first).alias("place"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.slice(F.col("embedding"), k * 9 + 1, F.lit(9)))).alias("j", "action"),
    )
    moved = kinematics.poses_from_steps(steps.withColumn("k", F.col("place") * 7 + F.col("j")), "track", block_rows=256)
    return moved.select("track", "k", *[F.round(F.col(c) + 0.0, 4).alias(c) for c in ("px", "pz", "fx", "fz")])


register(
    "poses_from_steps",
    poses_from_steps,
    f"""
WITH RECURSIVE raw AS MATERIALIZED (
  SELECT CASE WHEN vec_id % 5 < 3 THEN 0 ELSE vec_id % 5 END AS vec_id,
         7 * CASE WHEN vec_id % 5 < 3 THEN vec_id // 5 * 3 + vec_id % 5 ELSE vec_id // 5 END + k AS k, s
  FROM ({VECTOR_STEPS_SQL})),
{PRODUCT_SQL}
SELECT vec_id AS track, k, round(px, 4) + 0.0E0 AS px, round(pz, 4) + 0.0E0 AS pz, round(r13, 4) + 0.0E0 AS fx, round(r33, 4) + 0.0E0 AS fz FROM walk
""",
    writes=True,
)

# A third of the users share one clip; a cursor stands some time before or after every other event.
IRREGULAR_SQL = "SELECT CASE user_id % 3 WHEN 0 THEN 0 ELSE user_id END AS clip, ts AS t, event_id, value AS v FROM events"
CURSORS_SQL = """
SELECT event_id AS cursor, CASE user_id % 3 WHEN 0 THEN 0 ELSE user_id + event_id // 2 % 2 END AS clip,
       ts + to_microseconds((event_id * 7919003) % 40000000000 - 20000000000) AS t
FROM events WHERE event_id % 2 = 0
"""


def _irregular(t: Tables):
    user = F.col("user_id")
    return t.events.select(F.when(user % 3 == 0, 0).otherwise(user).cast("long").alias("clip"), F.col("ts").alias("t"), "event_id", F.col("value").alias("v"))


def _cursors(t: Tables):
    user, event = F.col("user_id"), F.col("event_id")
    shift = (event * 7919003) % 40_000_000_000 - 20_000_000_000
    other = user + F.floor(event / 2) % 2
    return t.events.filter(event % 2 == 0).select(
        event.alias("cursor"), F.when(user % 3 == 0, 0).otherwise(other).cast("long").alias("clip"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + shift).cast(t.events.schema["ts"].dataType).alias("t"))


def asof_samples(t: Tables):
    met = asof_join(_cursors(t), _irregular(t), "clip", "t", ["event_id"])
    return met.select("cursor", "clip", F.col("found.event_id").alias("event_id"), F.col("found.v").alias("v"))


register(
    "asof_samples",
    asof_samples,
    f"""
SELECT c.cursor, c.clip, s.event_id, s.v
FROM ({CURSORS_SQL}) c
ASOF LEFT JOIN (SELECT clip, t, max(event_id) AS event_id, max_by(v, event_id) AS v FROM ({IRREGULAR_SQL}) GROUP BY clip, t) s
  ON c.clip = s.clip AND c.t >= s.t
""",
)
register(
    "cursor_irregular",
    lambda t: trajectory.cursor_samples_at(_irregular(t), _cursors(t), "clip", order=["event_id"]).select(
        "cursor", "clip", F.unix_micros(F.col("cursor_t").cast("timestamp")).alias("at_us"), "event_id", "v"),
    f"""
WITH samples AS (SELECT clip, t, max(event_id) AS event_id, max_by(v, event_id) AS v FROM ({IRREGULAR_SQL}) GROUP BY clip, t),
ends AS (SELECT clip, min(t) AS lo, max(t) AS hi FROM samples GROUP BY clip),
cursors AS (SELECT cursor, clip, greatest(lo, least(t, hi)) AS t FROM ({CURSORS_SQL}) JOIN ends USING (clip))
SELECT c.cursor, c.clip, epoch_us(c.t) AS at_us, s.event_id, s.v FROM cursors c ASOF JOIN samples s ON c.clip = s.clip AND c.t >= s.t
""",
)

MEANS_SQL = """
SELECT clip, n, max_abs_h, avg(v) FILTER (WHERE i >= i0 AND i < i1) AS start_v, avg(v) FILTER (WHERE i >= j0 AND i < j1) AS end_v
FROM (SELECT *, greatest(0, least(a0, n - 1)) AS i0, greatest(1, least(greatest(a0 + 1, a1), n)) AS i1,
             greatest(0, least(b0, n - 1)) AS j0, greatest(1, least(greatest(b0 + 1, b1), n)) AS j1
      FROM (SELECT *, CAST(round_even(n * 0.05E0, 0) AS BIGINT) AS a0, CAST(round_even(n * 0.2E0, 0) AS BIGINT) AS a1,
                   CAST(round_even(n * (1.0E0 - 0.2E0), 0) AS BIGINT) AS b0, CAST(round_even(n * (1.0E0 - 0.05E0), 0) AS BIGINT) AS b1
            FROM (SELECT *, count(*) OVER (PARTITION BY clip) AS n, max(abs(h)) OVER (PARTITION BY clip) AS max_abs_h FROM samples)))
GROUP BY clip, n, max_abs_h
"""
CHECKED_SQL = """
SELECT *, round(ratio, 4) AS shown_ratio,
       CASE exp_speed WHEN 'decelerate' THEN ratio < 0.6E0 WHEN 'accelerate' THEN ratio > 1.4E0
                      WHEN 'maintain' THEN ratio BETWEEN 0.6E0 AND 1.6E0 ELSE true END AS speed_ok,
       NOT (exp_steer AND max_abs_h < 5.0E0) AS steer_ok
FROM (SELECT m.*, e.exp_speed, e.exp_steer, end_v / greatest(start_v, 1e-6) AS ratio
      FROM means m JOIN expected e ON m.clip = e.clip)
"""


def checked(t: Tables):
    means = trajectory.window_means(t.derive(I.SAMPLES), "clip")
    return checks.check_motion(lookup_join(means, t.derive(I.EXPECTED), ["clip"], "inner"))


register(
    "traj_windows",
    lambda t: trajectory.window_means(t.derive(I.SAMPLES), "clip").withColumns(
        {c: F.round(c, 6) for c in ("start_v", "end_v", "max_abs_h")}
    ),
    with_inputs(
        "SELECT clip, n, round(start_v, 6) AS start_v, round(end_v, 6) AS end_v, round(max_abs_h, 6) AS max_abs_h FROM means",
        samples=I.SAMPLES,
        means=MEANS_SQL,
    ),
)
register(
    "traj_check",
    lambda t: checked(t).select("clip", F.round("ratio", 4).alias("ratio"), "speed_ok", "steer_ok", "motion_ok"),
    with_inputs(
        "SELECT clip, shown_ratio AS ratio, speed_ok, steer_ok, speed_ok AND steer_ok AS motion_ok FROM checked",
        samples=I.SAMPLES,
        expected=I.EXPECTED,
        means=MEANS_SQL,
        checked=CHECKED_SQL,
    ),
)


def status_rows(t: Tables):
    """Status of every clip; some clips have no series or no sentence."""
    named = checked(t).withColumns(
        {
            "rel_path": F.concat(F.lit("clip_"), F.col("clip").cast("string"), F.lit(".mp4")),
            "has_prediction": F.col("clip") % 11 != 0,
            "sentence": F.when(F.col("clip") % 7 != 0, F.concat(F.lit("Line "), F.col("clip").cast("string"))),
            "init_v": F.col("start_v") * 2,
        }
    )
    return checks.assign_status(named)


STATUS_SQL = """
SELECT *, CASE WHEN clip % 11 = 0 THEN 'no_prediction' WHEN clip % 7 = 0 THEN 'no_sentence'
               WHEN exp_speed IS NULL AND NOT exp_steer THEN 'unclassified'
               WHEN speed_ok AND steer_ok THEN 'matched' ELSE 'mismatched' END AS kind
FROM checked
"""
register(
    "traj_status_tally",
    lambda t: checks.status_tally(status_rows(t)),
    with_inputs(
        """
SELECT CASE kind WHEN 'matched' THEN 'MATCH' WHEN 'no_sentence' THEN 'NOTE' WHEN 'unclassified' THEN 'NOTE' ELSE 'FLAG' END AS status,
       count(*) AS n
FROM kinds GROUP BY 1
""",
        samples=I.SAMPLES,
        expected=I.EXPECTED,
        means=MEANS_SQL,
        checked=CHECKED_SQL,
        kinds=STATUS_SQL,
    ),
)
register(
    "status_lines",
    lambda t: status_rows(t).select("rel_path", "case", checks.status_line().alias("line")),
    with_inputs(
        """
WITH worded AS (
  SELECT *, 'clip_' || CAST(clip AS VARCHAR) || '.mp4' AS rel_path, '"Line ' || CAST(clip AS VARCHAR) || '"' AS quoted,
         printf('init_v=%.1f start_v=%.1f end_v=%.1f max|heading|=%.1fdeg', round(start_v * 2, 1), round(start_v, 1),
                round(end_v, 1), round(max_abs_h, 1)) AS numbers,
         coalesce(exp_speed, '-') || CASE WHEN exp_steer THEN '+steer' ELSE '' END AS wanted,
         CASE WHEN NOT speed_ok THEN
           CASE exp_speed WHEN 'decelerate' THEN 'expected deceleration' WHEN 'accelerate' THEN 'expected acceleration'
                          ELSE 'expected ~constant speed' END || printf(', end/start velocity=%.2f', round(ratio, 2)) END AS r1,
         CASE WHEN NOT steer_ok THEN printf('expected steering, max|heading|=%.1fdeg', round(max_abs_h, 1)) END AS r2
  FROM kinds)
SELECT rel_path, kind AS "case",
       CASE kind WHEN 'no_prediction' THEN 'FLAG  ' || rel_path || ': no prediction output (clip_' || CAST(clip AS VARCHAR) || '/sample_outputs.json)'
                 WHEN 'no_sentence' THEN 'NOTE  ' || rel_path || ': no matching prompt sentence; ' || numbers
                 WHEN 'unclassified' THEN 'NOTE  ' || rel_path || ': unclassified prompt; ' || numbers || ' :: ' || quoted
                 WHEN 'matched' THEN 'MATCH ' || rel_path || ': expected=' || wanted || ' ' || numbers
                 ELSE 'FLAG  ' || rel_path || ': expected=' || wanted || ' ' || numbers || ' | ' || concat_ws('; ', r1, r2)
                      || ' :: ' || quoted END AS line
FROM worded
""",
        samples=I.SAMPLES,
        expected=I.EXPECTED,
        means=MEANS_SQL,
        checked=CHECKED_SQL,
        kinds=STATUS_SQL,
    ),
)

register(
    "traj_trim",
    lambda t: trajectory.trim_to_duration(
        t.derive(I.SAMPLES).withColumn("duration_s", F.when(F.col("clip") % 5 != 0, F.col("clip") % 7 - F.lit(0.5))), 10
    ).select("clip", "i", F.round("v", 4).alias("v")),
    with_inputs(
        """
SELECT clip, i, round(v, 4) AS v
FROM (SELECT *, CASE WHEN clip % 5 <> 0 THEN clip % 7 - 0.5E0 END AS dur FROM samples)
WHERE dur IS NULL OR dur <= 0 OR i = 0 OR i / 10.0E0 <= dur + 1e-9
""",
        samples=I.SAMPLES,
    ),
)
register(
    "axis_range",
    lambda t: trajectory.axis_range(t.derive(I.SAMPLES), "clip").withColumns(
        {"y_lo": F.round("y_lo", 4), "y_hi": F.round("y_hi", 4)}
    ),
    with_inputs(
        "SELECT clip, round(least(0.0E0, min(v)), 4) AS y_lo, round(greatest(20.0E0, max(v)), 4) AS y_hi FROM samples GROUP BY clip",
        samples=I.SAMPLES,
    ),
)
register(
    "series_unpivot",
    lambda t: trajectory.unpivot_series(t.derive(I.SAMPLES), "clip").withColumn("value", F.round("value", 4)),
    with_inputs(
        """
SELECT clip, i, 'velocity' AS series, round(v, 4) AS value, 'Velocity (mph)' AS y_label FROM samples
UNION ALL SELECT clip, i, 'heading', round(h, 4), 'Heading (deg)' FROM samples
""",
        samples=I.SAMPLES,
    ),
)

CURSORS = "SELECT event_id, CAST((event_id - event_id % 60) / 60 AS BIGINT) AS clip, value / 20.0E0 - 2.0E0 AS t FROM {events}"
register(
    "cursor_clamp",
    lambda t: trajectory.cursor_samples(t.derive(I.SAMPLES), t.derive(CURSORS), "clip", 10).select(
        "event_id", "i", F.round("cursor_t", 4).alias("cursor_t"), F.round("v", 4).alias("v")
    ),
    with_inputs(
        """
SELECT c.event_id, s.i, round(c.cursor_t, 4) AS cursor_t, round(s.v, 4) AS v
FROM (SELECT event_id, c.clip, greatest(0.0E0, least(t, last_i / 10.0E0)) AS cursor_t
      FROM cursors c JOIN (SELECT clip, max(i) AS last_i FROM samples GROUP BY clip) e ON c.clip = e.clip) c
ASOF JOIN (SELECT clip, i, v, i / 10.0E0 AS at FROM samples) s ON c.clip = s.clip AND c.cursor_t >= s.at
""",
        samples=I.SAMPLES,
        cursors=CURSORS,
    ),
)


def user_positions(t: Tables):
    """Dense position and time of each event in its user's own order."""
    placed = positions(t.derive("SELECT event_id, user_id, ts FROM {events}"), ["user_id"], ["ts", "event_id"], "i", "n")
    return placed.select("event_id", "i", "n", F.round(F.col("i") / F.lit(10.0), 4).alias("t"))


register(
    "time_axis",
    user_positions,
    """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
       count(*) OVER (PARTITION BY user_id) AS n,
       round((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 10.0E0, 4) AS t
FROM events
""",
)


def traj_parse_errors(t: Tables):
    parsed = t.derive(I.TRAJECTORY_TEXTS).select("event_id", D.trajectory(F.col("txt")).alias("p"))
    return parsed.select(
        "event_id", "p.error", F.size("p.series").cast("long").alias("n"), F.round(F.get("p.series", F.lit(0))["h"], 4).alias("h0")
    )


register(
    "traj_parse_errors",
    traj_parse_errors,
    with_inputs(
        """
WITH q AS (SELECT event_id, replace(txt, 'NaN', '"NaN"') AS txt FROM texts),
j AS (SELECT event_id, txt, CASE WHEN json_valid(txt) THEN CAST(txt AS JSON) END AS doc FROM q),
r AS (SELECT *, CASE WHEN json_type(doc) = 'ARRAY' THEN CAST(doc AS JSON[]) END AS items FROM j),
c AS (SELECT *, list_transform(items, lambda x: [TRY_CAST(json_extract_string(x, '$[0]') AS DOUBLE),
                                                 TRY_CAST(json_extract_string(x, '$[1]') AS DOUBLE)]) AS cells FROM r),
e AS (SELECT *, CASE WHEN txt IS NULL THEN 'missing' WHEN doc IS NULL THEN 'unreadable'
                     WHEN items IS NULL OR len(items) = 0 THEN 'empty_or_invalid'
                     WHEN len(list_filter(cells, lambda x: x[1] IS NULL OR x[2] IS NULL)) > 0 THEN 'invalid_rows' END AS error FROM c)
SELECT event_id, error, CASE WHEN error IS NULL THEN len(cells) END AS n,
       CASE WHEN error IS NULL THEN round(cells[1][2], 4) END AS h0
FROM e
""",
        texts=I.TRAJECTORY_TEXTS,
    ),
)

register(
    "frame_sampling",
    lambda t: batch.sample_frames(t.derive(I.FRAMES), "clip", "native_fps", 10).select("clip", "idx", "step"),
    with_inputs(
        """
WITH s AS (SELECT clip, idx, CAST(greatest(1, round_even(coalesce(nullif(native_fps, 0.0E0), 10.0E0) / 10, 0)) AS INT) AS step FROM frames),
k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS rn, count(*) OVER (PARTITION BY clip) AS n FROM s WHERE idx % step = 0)
SELECT clip, idx, step FROM k WHERE NOT (n % 2 = 1 AND n > 1 AND rn = n)
""",
        frames=I.FRAMES,
    ),
)
register(
    "clip_duration",
    lambda t: t.derive(I.PROBES).select(
        "p_partkey",
        F.round(
            D.clip_duration(F.col("duration"), F.col("nb_frames"), F.col("avg_rate"), F.col("real_rate")), 4
        ).alias("duration_s"),
    ),
    with_inputs(
        """
SELECT p_partkey, round(CASE WHEN TRY_CAST(duration AS DOUBLE) > 0 THEN TRY_CAST(duration AS DOUBLE)
                             WHEN avg_rate = '24/1' THEN CAST(nb_frames AS DOUBLE) / 24
                             WHEN avg_rate = '' THEN CAST(nb_frames AS DOUBLE) / (30000.0E0 / 1001.0E0) END, 4) AS duration_s
FROM probes
""",
        probes=I.PROBES,
    ),
)


MOTION_CLIPS = """
SELECT 'final/set_0/misc/prompt_' || CAST(doc_id % 12 AS STRING) || '_v' || CAST(doc_id AS STRING) || '.mp4' AS rel_path
FROM {documents}
"""
MOTION_NAME = "'final__set_0__misc__prompt_' || CAST(vec_id % 12 AS STRING) || '_v' || CAST(vec_id AS STRING)"


def motion_check(t: Tables):
    """Whole workflow: vectors as predicted steps, documents as prompt files."""
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda k: F.slice(F.col("embedding"), k * 9 + 1, F.lit(9)).cast("array<double>")
    )
    actions = t.embeddings.select(F.expr(MOTION_NAME).alias("name"), steps.alias("action"))
    done = workflows.motion_check(t.derive(MOTION_CLIPS), actions, t.derive(I.PROMPT_LINES))
    return done.select(
        "rel_path", "status", "case", "exp_speed", "exp_steer", "n",
        *[F.round(c, 6).alias(c) for c in ("init_v", "start_v", "end_v", "max_abs_h")],
    )


register(
    "motion_check",
    motion_check,
    with_inputs(
        f"""
WITH RECURSIVE walked AS ({WALK_SQL} SELECT vec_id, k, px, pz, r13 AS fx, r33 AS fz FROM walk),
poses AS (SELECT {MOTION_NAME.replace("STRING", "VARCHAR")} AS clip, k AS i, px, pz, fx, fz FROM walked),
samples AS ({_series_sql("poses", 10)}),
means AS ({MEANS_SQL}),
starts AS (SELECT clip, avg(d) * 10 * 2.2369362921E0 AS init_v
           FROM (SELECT clip, i, sqrt((lead(px) OVER w - px) ** 2 + (lead(pz) OVER w - pz) ** 2) AS d FROM poses
                 WINDOW w AS (PARTITION BY clip ORDER BY i)) WHERE i < 5 GROUP BY clip),
told AS (SELECT n.folder, k.line_no, {LAST_SENTENCE_SQL} AS sentence
         FROM nearest n JOIN cuts k ON n.prompt_dir = k.dir AND n.prompt_file = k.filename),
expected AS (SELECT *, {EXPECT_SQL} FROM (SELECT *, lower(sentence) AS s FROM told)),
joined AS (
  SELECT c.rel_path, m.clip, m.n, m.start_v, m.end_v, m.max_abs_h, e.sentence, e.exp_speed, e.exp_steer, z.init_v,
         m.end_v / greatest(m.start_v, 1e-6) AS ratio
  FROM (SELECT rel_path, {FOLDER} AS folder, CAST(regexp_extract({STEM}, '^prompt_(\\d+)', 1) AS INT) AS prompt_idx,
               replace(replace(rel_path, '.mp4', ''), '/', '__') AS name FROM clips) c
  LEFT JOIN means m ON m.clip = c.name LEFT JOIN starts z ON z.clip = c.name
  LEFT JOIN expected e ON e.folder = c.folder AND e.line_no = c.prompt_idx),
judged AS (
  SELECT *, CASE WHEN clip IS NULL THEN 'no_prediction' WHEN sentence IS NULL THEN 'no_sentence'
                 WHEN exp_speed IS NULL AND NOT exp_steer THEN 'unclassified'
                 WHEN (CASE exp_speed WHEN 'decelerate' THEN ratio < 0.6E0 WHEN 'accelerate' THEN ratio > 1.4E0
                                      WHEN 'maintain' THEN ratio BETWEEN 0.6E0 AND 1.6E0 ELSE true END)
                      AND NOT (exp_steer AND max_abs_h < 5.0E0) THEN 'matched' ELSE 'mismatched' END AS "case"
  FROM joined)
SELECT rel_path, "case", CASE "case" WHEN 'matched' THEN 'MATCH' WHEN 'no_sentence' THEN 'NOTE' WHEN 'unclassified' THEN 'NOTE' ELSE 'FLAG' END AS status,
       exp_speed, coalesce(exp_steer, false) AS exp_steer, CASE WHEN clip IS NOT NULL THEN 3 END AS n,
       round(init_v, 6) AS init_v, round(start_v, 6) AS start_v, round(end_v, 6) AS end_v, round(max_abs_h, 6) AS max_abs_h
FROM judged
""".replace("WITH RECURSIVE walked", "WITH walked", 1),
        clips=MOTION_CLIPS,
        lines=I.PROMPT_LINES,
        levels=LEVELS_SQL,
        nearest=NEAREST_SQL,
        cuts=CUT_SQL.format(text="text", source="lines"),
    ),
)
