"""Queries over the review store, flag logs and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipsight.functions import paths
from clipsight.operators import catalog, review
from clipsight.operators.skew import positions_and_size
from clipsight.plans import inputs as I
from clipsight.plans.queries_catalog import SKIPPED_SQL
from clipsight.plans.registry import Tables, register, with_inputs

FLAGS_SQL = """
SELECT rel_path, detail FROM (
  SELECT trim(regexp_extract(line, '^FLAG\\s+(.+?):(.*)$', 1)) AS rel_path,
         trim(regexp_extract(line, '^FLAG\\s+(.+?):(.*)$', 2)) AS detail,
         row_number() OVER (PARTITION BY regexp_extract(line, '^FLAG\\s+(.+?):(.*)$', 1) ORDER BY line_no DESC) AS rn
  FROM log WHERE line LIKE 'FLAG %') WHERE rn = 1
"""

register(
    "flag_log_parse",
    lambda t: review.parse_flags(t.derive(I.LOG_LINES)),
    with_inputs("SELECT * FROM flags", log=I.LOG_LINES, flags=FLAGS_SQL),
)

USER_CLIPS = "SELECT DISTINCT 'clip_' || CAST(user_id AS STRING) || '.mp4' AS rel_path FROM {events}"
register(
    "heuristic_status",
    lambda t: review.with_heuristic(t.derive(USER_CLIPS), review.parse_flags(t.derive(I.LOG_LINES))),
    with_inputs(
        """
SELECT c.rel_path, f.detail, CASE WHEN f.rel_path IS NOT NULL THEN 'FLAGGED' ELSE 'OK' END AS heuristic
FROM clips c LEFT JOIN flags f ON c.rel_path = f.rel_path
""",
        log=I.LOG_LINES,
        flags=FLAGS_SQL,
        clips=USER_CLIPS,
    ),
)
register(
    "label_last",
    lambda t: review.last_per_key(t.derive(I.LABEL_STORE), "rel_path", "row_no"),
    with_inputs(
        "SELECT * FROM store QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY row_no DESC) = 1", store=I.LABEL_STORE
    ),
)
register(
    "label_lookup",
    lambda t: review.with_labels(
        t.derive("SELECT DISTINCT 'clip_' || CAST(c_custkey AS STRING) || '.mp4' AS rel_path FROM {customer}"),
        t.derive(I.LABEL_STORE),
    ),
    with_inputs(
        """
SELECT c.rel_path, s.label, s.heuristic, s.comment
FROM (SELECT DISTINCT 'clip_' || CAST(c_custkey AS VARCHAR) || '.mp4' AS rel_path FROM customer) c
LEFT JOIN (SELECT * FROM store QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY row_no DESC) = 1) s
  ON c.rel_path = s.rel_path
""",
        store=I.LABEL_STORE,
    ),
)
register(
    "label_upsert",
    lambda t: review.upsert_labels(t.derive(I.LABEL_STORE), t.derive(I.LABEL_UPDATES)),
    with_inputs(
        """
WITH latest AS (SELECT *, min(seq) OVER (PARTITION BY rel_path) AS first_seq FROM updates
                QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY seq DESC) = 1)
SELECT s.row_no, s.rel_path, coalesce(u.label, s.label) AS label, coalesce(u.heuristic, s.heuristic) AS heuristic,
       coalesce(u.comment, s.comment) AS comment
FROM store s LEFT JOIN latest u ON s.rel_path = u.rel_path
UNION ALL
SELECT (SELECT max(row_no) + 1 FROM store) + first_seq, rel_path, label, heuristic, comment
FROM latest WHERE rel_path NOT IN (SELECT rel_path FROM store)
""",
        store=I.LABEL_STORE,
        updates=I.LABEL_UPDATES,
    ),
)


def queue(t: Tables):
    """The queue, and whether a folder is too large for one task."""
    clips = t.derive(I.CLIP_PATHS).select("rel_path", paths.parent(F.col("rel_path")).alias("folder"))
    placed, large = positions_and_size(clips, ["folder"], [paths.components(F.col("rel_path"))], "pos", "n_in_folder")
    return catalog.mark_skipped(placed, t.derive(I.SKIP_LIST)), large


def neighbours(t: Tables):
    rows, large = queue(t)
    return review.next_previous(rows, "folder", large=large)


QUEUE_SQL = """
SELECT rel_path, folder, skipped, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY folder) AS n_in_folder
FROM marked WINDOW w AS (PARTITION BY folder ORDER BY string_split(rel_path, '/'))
"""
register(
    "queue_position",
    lambda t: queue(t)[0].select("rel_path", "pos", "n_in_folder", "skipped"),
    with_inputs(
        "SELECT rel_path, pos, n_in_folder, skipped FROM queue",
        clips=I.CLIP_PATHS,
        skip=I.SKIP_LIST,
        marked=SKIPPED_SQL,
        queue=QUEUE_SQL,
    ),
)
NEIGHBOURS_SQL = """
SELECT *, min(free) OVER (PARTITION BY folder ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_pos,
       max(free) OVER (PARTITION BY folder ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_pos
FROM (SELECT *, CASE WHEN NOT skipped THEN pos END AS free FROM queue)
"""
register(
    "next_unskipped",
    lambda t: neighbours(t).select("rel_path", "pos", "next_pos", "prev_pos", "landing_pos", "landing_back_pos"),
    with_inputs(
        "SELECT rel_path, pos, next_pos, prev_pos, coalesce(free, next_pos, prev_pos, pos) AS landing_pos, "
        "coalesce(free, prev_pos, next_pos, pos) AS landing_back_pos FROM near",
        clips=I.CLIP_PATHS,
        skip=I.SKIP_LIST,
        marked=SKIPPED_SQL,
        queue=QUEUE_SQL,
        near=NEIGHBOURS_SQL,
    ),
)
register(
    "passed_over",
    lambda t: review.passed_over(neighbours(t)),
    with_inputs(
        "SELECT folder, prev_pos, next_pos, pos, rel_path FROM near WHERE skipped",
        clips=I.CLIP_PATHS,
        skip=I.SKIP_LIST,
        marked=SKIPPED_SQL,
        queue=QUEUE_SQL,
        near=NEIGHBOURS_SQL,
    ),
)
