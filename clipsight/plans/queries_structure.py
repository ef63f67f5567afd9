"""Queries over folder trees, segments on a time axis, document structure, phrases, stored states and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.functions import exact, paths
from clipsight.operators import intervals, phrases, states, structure, tree
from clipsight.plans import inputs as I
from clipsight.plans import queries_catalog  # noqa: F401 - two queries here have the SQL of two of its own
from clipsight.plans.queries_evaluate import predictions
from clipsight.plans.registry import QUERIES, Tables, register, with_inputs
from clipsight.session import work_folder

register("tree_rollup", lambda t: tree.browsable_folders(t.derive(I.CLIP_PATHS)), QUERIES["folder_rollup"].sql, writes=True)
register(
    "tree_nearest",
    lambda t: tree.nearest_prompt_file(
        t.derive(I.CLIP_PATHS).select(paths.parent(F.col("rel_path")).alias("folder")), t.derive(I.PROMPT_LINES).select("dir", "filename").distinct()),
    QUERIES["nearest_prompt_file"].sql,
    writes=True,
)

# ---------------------------------------------------------------- segments

# A third of the segments belong to one clip; they stand in any order, overlap, nest and leave gaps.
SEGMENTS = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0 ELSE CAST((event_id - event_id % 40) / 40 AS BIGINT) END AS clip,
       (event_id * 7919) % 90001 AS lo, (event_id * 7919) % 90001 + event_id % 13 * 40 - 20 AS hi
FROM {events}
"""
SEGMENT_CLIPS = "SELECT DISTINCT CAST((event_id - event_id % 40) / 40 AS BIGINT) AS clip, CAST(90000 + (event_id - event_id % 40) / 40 % 5 * 100 - 100 AS BIGINT) AS length FROM {events}"
SWEPT_SQL = "SELECT clip, lo, hi, max(hi) OVER (PARTITION BY clip ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segments WHERE lo <= hi"

register(
    "segment_gaps",
    lambda t: intervals.gaps_and_overlaps(t.derive(SEGMENTS), t.derive(SEGMENT_CLIPS), "clip"),
    with_inputs(
        """
SELECT clip, kind, "from", CASE kind WHEN 'gap' THEN least("to", length) ELSE "to" END AS "to"
FROM (SELECT clip, 'gap' AS kind, coalesce(reach, 0) AS "from", lo AS "to" FROM swept WHERE lo > coalesce(reach, 0)
      UNION ALL SELECT clip, 'overlap', lo, least(hi, reach) FROM swept WHERE reach IS NOT NULL AND least(hi, reach) > lo
      UNION ALL SELECT clip, 'gap', coalesce(hi, 0), length FROM clips LEFT JOIN (SELECT clip, max(hi) AS hi FROM swept GROUP BY clip) USING (clip)) x
JOIN clips USING (clip) WHERE "from" < CASE kind WHEN 'gap' THEN least("to", length) ELSE "to" END
""",
        segments=SEGMENTS,
        clips=SEGMENT_CLIPS,
        swept=SWEPT_SQL,
    ),
)
register(
    "segment_coverage",
    lambda t: intervals.covered_share(t.derive(SEGMENTS), t.derive(SEGMENT_CLIPS), "clip").withColumn("share", F.round("share", 9)),
    with_inputs(
        """
SELECT clip, coalesce(n, 0) AS n_segments, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(coalesce(covered, 0) / length, 9) AS share
FROM clips LEFT JOIN (SELECT clip, count(*) AS n, sum(greatest(0, least(hi, length) - greatest(lo, coalesce(reach, 0)))) AS covered
                      FROM swept JOIN clips USING (clip) GROUP BY clip) USING (clip)
""",
        segments=SEGMENTS,
        clips=SEGMENT_CLIPS,
        swept=SWEPT_SQL,
    ),
)

# ---------------------------------------------------------------- documents

TREE_BASE = """
SELECT c_custkey AS prompt_idx, '{{"name":"' || c_name || '","items":["a","b",{{"k":' || CAST(c_nationkey AS STRING) || '}}],"light":{{"sky":"clear","hours":[1,2]}},' ||
       '"fps":24,"empty":[]}}' AS json
FROM {customer}
"""
TREE_VARIANTS = """
SELECT 'doc_' || CAST(o_orderkey AS STRING) AS file, o_custkey AS prompt_idx, o_orderstatus AS folder,
       '{{"name":"' || CASE o_orderkey % 4 WHEN 0 THEN 'other' ELSE 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END || '","items":' ||
       CASE o_orderkey % 5 WHEN 0 THEN '["b","a",{{"k":1}}]' WHEN 1 THEN '["a"]' WHEN 2 THEN '[{{"k":1}},"a","b","c"]' WHEN 3 THEN '{{"a":"b"}}'
                           ELSE '["a","b",{{"k":2}}]' END ||
       ',"light":' || CASE o_orderkey % 3 WHEN 0 THEN '{{"sky":null}}' WHEN 1 THEN '{{"sky":"clear","hours":[1,2],"wind":true}}' ELSE '"off"' END ||
       ',"fps":' || CASE o_orderkey % 7 WHEN 0 THEN '24.5' WHEN 1 THEN '"24"' ELSE '24' END || CASE o_orderkey % 11 WHEN 0 THEN '' ELSE ',"empty":[]}}' END AS json
FROM {orders}
"""
_TYPE = "CASE type WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(type) END"
_ROWS = f"SELECT {{keep}}, t.fullkey AS path, {_TYPE.replace('type', 't.type')} AS type, t.value ->> '$' AS value FROM {{table}} d, json_tree(CASE WHEN json_valid(d.json) THEN d.json END) t"

register(
    "document_differences",
    lambda t: structure.differences(t.derive(TREE_VARIANTS), t.derive(TREE_BASE)).withColumns(
        {c: F.when(F.col(c).rlike(r"^[\[{]"), F.lit("...")).otherwise(F.col(c)) for c in ("was", "now")}),
    with_inputs(
        """
WITH expected AS (SELECT file, path, type AS t0, value AS v0 FROM (SELECT DISTINCT file, prompt_idx FROM variants) JOIN olds USING (prompt_idx)),
present AS (SELECT file, path, type AS t1, value AS v1 FROM news WHERE prompt_idx IN (SELECT prompt_idx FROM base)),
met AS (SELECT file, path, t0, t1, v0, v1,
               CASE WHEN t0 IS NULL THEN 'added' WHEN t1 IS NULL THEN 'removed'
                    WHEN t0 <> t1 OR t1 NOT IN ('object', 'array') AND v0 IS DISTINCT FROM v1 THEN 'changed' END AS change
        FROM expected FULL JOIN present USING (file, path)),
spots AS (SELECT file, prompt_idx, path, regexp_extract(path, '^(.*)\\[\\d+\\]$', 1) AS arr, CAST(regexp_extract(path, '\\[(\\d+)\\]$', 1) AS INT) AS place, type, value FROM news WHERE path LIKE '%]'),
before AS (SELECT prompt_idx, regexp_extract(path, '^(.*)\\[\\d+\\]$', 1) AS arr, CAST(regexp_extract(path, '\\[(\\d+)\\]$', 1) AS INT) AS place, type, value FROM olds WHERE path LIKE '%]'),
moved AS (
  SELECT s.file, s.path, 'moved' AS change, s.arr || '[' || CAST(min(b.place) AS VARCHAR) || ']' AS was, s.value AS now
  FROM spots s JOIN before b ON s.prompt_idx = b.prompt_idx AND s.arr = b.arr AND s.type = b.type AND s.value IS NOT DISTINCT FROM b.value
  GROUP BY s.file, s.path, s.arr, s.value, s.place HAVING count(*) FILTER (WHERE b.place = s.place) = 0)
SELECT file, path, change, CASE WHEN left(was, 1) IN ('[', '{') AND change <> 'moved' THEN '...' ELSE was END AS was,
       CASE WHEN left(now, 1) IN ('[', '{') THEN '...' ELSE now END AS now
FROM (SELECT file, path, change, v0 AS was, v1 AS now FROM met WHERE change IS NOT NULL UNION ALL SELECT * FROM moved)
""",
        variants=TREE_VARIANTS,
        base=TREE_BASE,
        news=_ROWS.format(keep="d.file, d.prompt_idx", table="variants"),
        olds=_ROWS.format(keep="d.prompt_idx", table="base"),
    ),
)
register(
    "schema_drift",
    lambda t: structure.schema_drift(t.derive(TREE_VARIANTS), "folder", "file").withColumn("share", F.round("share", 9)),
    with_inputs(
        """
WITH seen AS (SELECT DISTINCT folder, regexp_replace(path, '\\[\\d+\\]', '[*]', 'g') AS field, file, type FROM news),
merged AS (SELECT folder, field, list_sort(list_distinct(list(type))) AS types, count(DISTINCT file) AS n_files, min(file) AS first_file FROM seen GROUP BY ALL),
held AS (SELECT *, regexp_extract(field, '^(.*?)(?:\\.[^.\\[\\]]*|\\[\\*\\])$', 1) AS above FROM merged),
shared AS (SELECT h.*, h.n_files / coalesce(m.n_files, h.n_files) AS share FROM held h LEFT JOIN merged m ON h.folder = m.folder AND h.above = m.field)
SELECT folder, field, array_to_string(types, ',') AS types, n_files, round(share, 9) AS share, first_file, len(types) > 1 OR share < 1 AS drifts,
       CASE WHEN len(list_filter(types, lambda x: x <> 'null')) = 0 THEN 'null'
            WHEN len(list_filter(types, lambda x: x <> 'null')) = 1 THEN list_filter(types, lambda x: x <> 'null')[1]
            WHEN len(list_filter(types, lambda x: x NOT IN ('null', 'integer', 'number'))) = 0 THEN 'number' ELSE 'mixed' END AS merged
FROM shared
""",
        variants=TREE_VARIANTS,
        news=_ROWS.format(keep="d.file, d.folder", table="variants"),
    ),
)

# ---------------------------------------------------------------- phrases


def phrase_hits(t: Tables) -> DataFrame:
    """Every two neighbouring words of the benchmark items as a phrase between blanks, counted in all documents."""
    words = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.lit(" "), F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" ")))
    listed = t.benchmark.filter(F.size(words) > 1).select(F.explode(pairs).alias("phrase"))
    return phrases.phrase_counts(t.documents, listed, "doc_id")


register(
    "phrase_hits",
    phrase_hits,
    """
WITH listed AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')))) AS i FROM benchmark)),
placed AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest(range(2, len(string_split(text, ' ')) - 1)) AS i FROM documents))
SELECT doc_id, ' ' || a || ' ' || b || ' ' AS phrase, count(*) AS hits FROM placed JOIN listed USING (a, b) GROUP BY ALL
""",
    writes=True,
)

# Phrases of which no end is a beginning, so that plain replacement counts them too.
PHRASE_RULES = """
SELECT CAST(p_partkey % 150 AS INT) AS prompt_idx, 'r' || CAST(p_partkey AS STRING) AS rule,
       CASE p_partkey % 11 WHEN 0 THEN 'th' WHEN 1 THEN 'he ' WHEN 2 THEN 'que' WHEN 3 THEN 'ei' WHEN 4 THEN 'ing' WHEN 5 THEN 'la' WHEN 6 THEN 'ció'
                           WHEN 7 THEN 'der' WHEN 8 THEN 'au' WHEN 9 THEN ', e' ELSE '. D' END AS phrase,
       CAST(0 AS BIGINT) AS least, CAST(p_partkey % 40 AS BIGINT) AS most
FROM {part}
"""
PHRASE_DOCS = "SELECT doc_id, CAST(doc_id % 150 AS INT) AS prompt_idx, text FROM {documents}"
register(
    "phrase_checks",
    lambda t: phrases.phrase_checks(t.derive(PHRASE_DOCS), t.derive(PHRASE_RULES), "doc_id"),
    with_inputs(
        """
SELECT doc_id, rule, hits, hits BETWEEN least AND most AS ok
FROM (SELECT d.doc_id, r.rule, r.least, r.most, (length(text) - length(replace(text, phrase, ''))) // length(phrase) AS hits
      FROM docs d JOIN rules r ON d.prompt_idx = r.prompt_idx)
""",
        docs=PHRASE_DOCS,
        rules=PHRASE_RULES,
    ),
    writes=True,
)

# ---------------------------------------------------------------- stored states


def stored_metrics(t: Tables) -> DataFrame:
    """States of four days, two of them first with half of their answers, merged on reading."""
    folder = work_folder(t.spark)
    rows = predictions(t).withColumn("day", F.date_add(F.lit("2024-03-01").cast("date"), (F.col("doc_id") % 4).cast("int")))
    states.write_states(states.day_states(rows.filter("doc_id % 8 < 4 or doc_id % 4 < 2")), folder)
    states.write_states(states.day_states(rows.filter("doc_id % 4 >= 2")), folder)
    merged = states.stored_metrics(t.spark, folder)
    near = rows.filter("prediction <> 'Error'").join(merged.select("exp_name", "p50"), "exp_name").groupBy("exp_name").agg(
        F.avg((F.col("seconds") <= F.col("p50")).cast("int")).between(0.45, 0.6).alias("p50_close"))
    shown = [F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "avg_seconds")]
    return merged.join(near, "exp_name").select("exp_name", "total_videos", "tp", "fp", "tn", "fn", "n_scored", *shown, "p50_close")


register("stored_metrics", stored_metrics, f"SELECT *, true AS p50_close FROM ({QUERIES['eval_metrics'].sql})", writes=True)

# ---------------------------------------------------------------- rounding

# Many ties: eighths and sixteenths, also of negative and of small numbers.
TIES = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN CAST(event_id % 4001 - 2000 AS DOUBLE) / 16.0E0 WHEN 2 THEN CAST(event_id AS DOUBLE) / 8.0E0
                 ELSE value / 1024.0E0 END AS x
FROM {events}
"""
register(
    "exact_text",
    lambda t: t.derive(TIES).select("event_id", exact.fixed_text(F.col("x"), 1).alias("one"), exact.fixed_text(F.col("x"), 2).alias("two"), (exact.round_half_even(F.col("x"), 3) + F.lit(0.0)).alias("three")),
    with_inputs("SELECT event_id, printf('%.1f', x) AS one, printf('%.2f', x) AS two, CAST(printf('%.3f', x) AS DOUBLE) + 0.0E0 AS three FROM ties", ties=TIES),
)
