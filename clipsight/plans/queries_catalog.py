"""Queries over clip paths and prompt files."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipsight.functions import paths, text
from clipsight.operators import catalog, checks
from clipsight.plans import inputs as I
from clipsight.plans.registry import register, with_inputs
from clipsight.sources import listing, writers

# Parts of a path as the reference database says them.
FILE = "regexp_extract(rel_path, '[^/]*$')"
STEM = "regexp_replace(regexp_extract(rel_path, '[^/]*$'), '\\.mp4$', '')"
FOLDER = "regexp_replace(rel_path, '/[^/]*$', '')"

register(
    "label_by_path",
    lambda t: catalog.labelled(t.derive(I.CLIP_PATHS)).select("rel_path", "true_label"),
    with_inputs(
        """
SELECT rel_path, CASE WHEN contains(lower(rel_path), 'negative_scenario') THEN 1 ELSE 0 END AS true_label
FROM clips WHERE contains(lower(rel_path), 'negative_scenario') OR contains(lower(rel_path), 'positive_scenario')
""",
        clips=I.CLIP_PATHS,
    ),
)
register(
    "path_parts",
    lambda t: catalog.describe_paths(t.derive(I.CLIP_PATHS)).drop("event_id"),
    with_inputs(
        f"""
SELECT rel_path, {FOLDER} AS folder, {FILE} AS file_name, {STEM} AS stem,
       replace(regexp_replace(rel_path, '\\.mp4$', ''), '/', '__') AS run_name,
       CAST(regexp_extract({STEM}, '^prompt_(\\d+)_v', 1) AS INT) AS prompt_idx,
       CAST(regexp_extract({STEM}, '_v(\\d+)$', 1) AS INT) AS variant_no,
       CASE WHEN contains(rel_path, 'negative_scenario') THEN 1 WHEN contains(rel_path, 'positive_scenario') THEN 0 END AS true_label
FROM clips
""",
        clips=I.CLIP_PATHS,
    ),
)
register(
    "run_name_collisions",
    lambda t: catalog.run_name_collisions(
        t.derive("SELECT CASE WHEN event_id % 2 = 0 THEN 'a/' ELSE 'a__' END || CAST(user_id AS STRING) || '.mp4' AS rel_path FROM {events}")
    ),
    """
SELECT 'a__' || CAST(user_id AS VARCHAR) AS run_name, count(DISTINCT event_id % 2) AS n_paths FROM events
GROUP BY user_id HAVING count(DISTINCT event_id % 2) > 1
""",
)
register(
    "output_path",
    lambda t: t.derive(I.CLIP_PATHS).select(
        "rel_path",
        paths.trajectory_path(F.col("rel_path"), F.lit("downsampled")).alias("low_rate"),
        paths.trajectory_path(F.col("rel_path"), F.lit("full_fps")).alias("full_rate"),
        paths.with_suffix(F.col("rel_path"), ".json").alias("document"),
        paths.rate_of_mode(F.when(F.col("event_id") % 2 == 0, F.lit("full_fps")).otherwise(F.lit("downsampled"))).alias("hz"),
    ),
    with_inputs(
        """
SELECT rel_path, replace(rel_path, '.mp4', '.txt') AS low_rate, replace(rel_path, '.mp4', '_10fps.txt') AS full_rate,
       replace(rel_path, '.mp4', '.json') AS document, CASE WHEN event_id % 2 = 0 THEN 10.0E0 ELSE 5.0E0 END AS hz
FROM clips
""",
        clips=I.CLIP_PATHS,
    ),
)
register(
    "subtree_filter",
    lambda t: catalog.in_folder(t.derive(I.CLIP_PATHS), " /final\\set_1/ ").select("rel_path"),
    with_inputs("SELECT rel_path FROM clips WHERE starts_with(rel_path, 'final/set_1/')", clips=I.CLIP_PATHS),
)
ANCESTORS_SQL = f"""
SELECT DISTINCT rel_path, array_to_string(parts[1:n], '/') AS folder
FROM (SELECT rel_path, string_split({FOLDER}, '/') AS parts, unnest(range(1, len(string_split({FOLDER}, '/')) + 1)) AS n FROM clips)
"""
register(
    "folder_rollup",
    lambda t: catalog.browsable_folders(t.derive(I.CLIP_PATHS)),
    with_inputs("SELECT folder, count(*) AS n_clips FROM above GROUP BY folder", clips=I.CLIP_PATHS, above=ANCESTORS_SQL),
)
register(
    "corpus_counts",
    lambda t: catalog.corpus_counts(t.derive(I.CLIP_PATHS)),
    with_inputs(
        f"""
SELECT folder, prompt_idx, count(*) AS n_files
FROM (SELECT {FOLDER} AS folder, CAST(regexp_extract({STEM}, '^prompt_(\\d+)', 1) AS INT) AS prompt_idx FROM clips)
GROUP BY ROLLUP (folder, prompt_idx)
""",
        clips=I.CLIP_PATHS,
    ),
)

# Every candidate directory and file name of a folder, ranked by brute force.
NEAREST_SQL = f"""
SELECT folder, prompt_dir, prompt_file FROM (
  SELECT c.folder, l.dir AS prompt_dir, l.filename AS prompt_file,
         row_number() OVER (PARTITION BY c.folder ORDER BY lvl, sib, l.filename = 'prompt.txt') AS rn
  FROM (SELECT folder, lvl, 0 AS sib, here AS dir FROM levels
        UNION ALL SELECT folder, lvl, 1, regexp_replace(here, '_variants?$', '') FROM levels
        WHERE regexp_matches(here, '_variants?$')) c
  JOIN (SELECT DISTINCT dir, filename FROM lines) l ON c.dir = l.dir)
WHERE rn = 1
"""
LEVELS_SQL = f"""
SELECT folder, lvl, array_to_string(parts[1:len(parts) - lvl], '/') AS here
FROM (SELECT folder, parts, unnest(range(0, len(parts) + 1)) AS lvl
      FROM (SELECT DISTINCT {FOLDER} AS folder, string_split({FOLDER}, '/') AS parts FROM clips))
"""
# The reference database's patterns know ASCII blanks only, and no look-behind.
LAST_SENTENCE_SQL = """
CASE WHEN bare = '' THEN '' WHEN cut = '' THEN regexp_extract(bare, '^\\s*(\\([^()]*\\))', 1)
     ELSE coalesce(trim(list_filter(string_split(regexp_replace(cut, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
                                    lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')[-1],
                        ' ' || chr(9) || chr(10) || chr(13)), cut) END
"""
CUT_SQL = """
SELECT *, regexp_replace(bare, '(\\s*\\([^()]*\\))+\\s*$', '') AS cut
FROM (SELECT *, regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '') AS bare FROM {source})
"""

register(
    "nearest_prompt_file",
    lambda t: catalog.nearest_prompt_file(
        t.derive(I.CLIP_PATHS).select(paths.parent(F.col("rel_path")).alias("folder")),
        t.derive(I.PROMPT_LINES).select("dir", "filename").distinct(),
    ),
    with_inputs("SELECT * FROM nearest", clips=I.CLIP_PATHS, lines=I.PROMPT_LINES, levels=LEVELS_SQL, nearest=NEAREST_SQL),
)
register(
    "prompt_sentence",
    lambda t: catalog.with_prompt_sentence(t.derive(I.CLIP_PATHS).select("rel_path"), t.derive(I.PROMPT_LINES)),
    with_inputs(
        f"""
SELECT c.rel_path, c.folder, c.prompt_idx, s.prompt_dir, s.prompt_file, s.sentence
FROM (SELECT rel_path, {FOLDER} AS folder, CAST(regexp_extract({STEM}, '^prompt_(\\d+)', 1) AS INT) AS prompt_idx FROM clips) c
LEFT JOIN (SELECT n.folder, n.prompt_dir, n.prompt_file, k.line_no, {LAST_SENTENCE_SQL} AS sentence
           FROM nearest n JOIN cuts k ON n.prompt_dir = k.dir AND n.prompt_file = k.filename) s
  ON c.folder = s.folder AND c.prompt_idx = s.line_no
""",
        clips=I.CLIP_PATHS,
        lines=I.PROMPT_LINES,
        levels=LEVELS_SQL,
        nearest=NEAREST_SQL,
        cuts=CUT_SQL.format(text="text", source="lines"),
    ),
)
register(
    "last_sentence",
    lambda t: t.derive(I.SENTENCES).select("doc_id", text.last_sentence(F.col("prompt_text")).alias("sentence")),
    with_inputs(
        f"SELECT doc_id, {LAST_SENTENCE_SQL} AS sentence FROM cuts",
        sentences=I.SENTENCES,
        cuts=CUT_SQL.format(text="prompt_text", source="sentences"),
    ),
)


def _any_of(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(s, '{p}')" for p in phrases) + ")"


EXPECT_SQL = f"""
CASE WHEN {_any_of(text.ACCELERATE)} THEN 'accelerate' WHEN {_any_of(text.KEEPS_GOING)} THEN 'maintain'
     WHEN {_any_of(text.RESUMES)} THEN 'maintain' WHEN {_any_of(text.DECELERATE)} THEN 'decelerate'
     WHEN {_any_of(text.MAINTAIN)} THEN 'maintain' END AS exp_speed, {_any_of(text.STEER)} AS exp_steer
"""
register(
    "expectation_classify",
    lambda t: checks.with_expectation(t.derive(I.SENTENCES), "prompt_text").drop("prompt_text"),
    with_inputs(
        f"SELECT doc_id, {EXPECT_SQL} FROM (SELECT doc_id, lower(prompt_text) AS s FROM sentences)", sentences=I.SENTENCES
    ),
)
register(
    "pending_anti",
    lambda t: catalog.pending(t.derive(I.CLIP_PATHS), t.derive(I.DONE_PATHS), "rel_path").select("rel_path"),
    with_inputs(
        "SELECT rel_path FROM clips WHERE rel_path NOT IN (SELECT rel_path FROM done)", clips=I.CLIP_PATHS, done=I.DONE_PATHS
    ),
)
TREE_SQL = """
CASE WHEN list_contains(string_split(rel_path, '/'), 'negative_scenarios_variants') THEN 'negative'
     WHEN list_contains(string_split(rel_path, '/'), 'positive_scenarios_variants') THEN 'positive' END
"""
SKIPPED_SQL = f"""
SELECT c.*, EXISTS (SELECT 1 FROM skip s WHERE s.tree = c.tree AND s.file_name = c.file_name) AS skipped
FROM (SELECT rel_path, {FOLDER} AS folder, {TREE_SQL} AS tree, {FILE} AS file_name FROM clips) c
"""
register(
    "skip_filter",
    lambda t: catalog.keep_unskipped(t.derive(I.CLIP_PATHS), t.derive(I.SKIP_LIST)).select("rel_path"),
    with_inputs(
        "SELECT rel_path FROM marked WHERE NOT skipped", clips=I.CLIP_PATHS, skip=I.SKIP_LIST, marked=SKIPPED_SQL
    ),
)
register(
    "allowed_prompts",
    lambda t: catalog.allowed_prompts(
        t.derive(I.CLIP_PATHS).withColumn("prompt_idx", text.prompt_index(paths.stem(F.col("rel_path")))),
        t.derive("SELECT CAST(r_regionkey AS INT) AS prompt_idx FROM {region}"),
    ).select("rel_path"),
    with_inputs(
        f"""
SELECT rel_path FROM clips WHERE CAST(regexp_extract({STEM}, '^prompt_(\\d+)', 1) AS INT) IN
  (SELECT r_regionkey FROM region)
""",
        clips=I.CLIP_PATHS,
    ),
)
register(
    "job_lines",
    lambda t: writers.job_lines(t.derive(I.CLIP_PATHS), "/data/clips"),
    with_inputs(
        """
SELECT '{"action_chunk_size":60,"domain_name":"av","fps":10,"image_size":480,"view_point":"ego_view","model_mode":"inverse_dynamics","name":"'
       || replace(replace(rel_path, '.mp4', ''), '/', '__') ||
       '","prompt":"You are an autonomous vehicle planning system.","seed":0,"vision_path":"/data/clips/' || rel_path || '"}' AS value
FROM clips
""",
        clips=I.CLIP_PATHS,
    ),
)
register(
    "upload_manifest",
    lambda t: writers.upload_manifest(t.derive(I.CLIP_PATHS), "/data/clips"),
    with_inputs(
        """
SELECT '/data/clips/' || replace(rel_path, '.mp4', s) AS local_path, replace(rel_path, '.mp4', s) AS path_in_repo
FROM clips, (SELECT unnest(['.txt', '_10fps.txt']) AS s)
""",
        clips=I.CLIP_PATHS,
    ),
)


_URIS = """
SELECT event_id, '{root}/' || event_type || '/' || CASE WHEN event_id % 3 = 0 THEN '100{percent}_' ELSE 'a{plus}b{blank}' END
       || CAST(user_id AS {text}) || '.mp4' AS uri FROM {table}
"""
_ROOTS = {"file": ("file:///data/my{blank}clips", "/data/my clips"), "hdfs": ("hdfs://nn:8020/clips", "hdfs://nn:8020/clips"),
          "s3a": ("s3a://bucket/clips", "s3a://bucket/clips/")}


def relative_paths(t: Tables):
    """Paths below their roots, from encoded and from bare URIs of several stores."""
    parts = []
    for store, (uri_root, root) in _ROOTS.items():
        for encoded in (True, False):
            marks = {"percent": "%25", "plus": "+", "blank": "%20"} if encoded else {"percent": "%", "plus": "+", "blank": " "}
            uris = t.derive(_URIS.format(root=uri_root.format(**marks), **marks, text="STRING", table="{events}"))
            parts.append(uris.select("event_id", F.lit(store).alias("store"), F.lit(encoded).alias("encoded"),
                                     listing.relative(F.col("uri"), root, encoded).alias("rel_path")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


register(
    "relative_paths",
    relative_paths,
    """
SELECT event_id, store, encoded, event_type || '/' || CASE WHEN event_id % 3 = 0 THEN '100%_' ELSE 'a+b ' END || CAST(user_id AS VARCHAR) || '.mp4' AS rel_path
FROM events, (VALUES ('file'), ('hdfs'), ('s3a')) s(store), (VALUES (true), (false)) e(encoded)
""",
)

register(
    "folder_order",
    lambda t: catalog.folder_order(t.derive(I.CLIP_PATHS)),
    with_inputs(
        f"SELECT folder, row_number() OVER (ORDER BY folder) - 1 AS place FROM (SELECT DISTINCT {FOLDER} AS folder FROM clips)",
        clips=I.CLIP_PATHS,
    ),
)
register(
    "prompt_order",
    lambda t: catalog.prompt_order(t.derive("SELECT CAST(c_custkey AS STRING) AS prompt_idx FROM {customer}")),
    "SELECT c_custkey AS prompt_idx, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer",
)
register(
    "run_manifest",
    lambda t: writers.run_manifest(
        t.derive(I.CLIP_PATHS).withColumn("n", F.when(F.length("rel_path") % 3 != 0, F.length("rel_path"))), "/runs", "flags.txt"
    ),
    with_inputs(
        """
WITH listed AS (
  SELECT replace(rel_path, '.mp4', s) AS path_in_repo
  FROM clips, (SELECT unnest(['.txt', '_10fps.txt']) AS s) WHERE length(rel_path) % 3 <> 0
  UNION ALL SELECT 'flags.txt')
SELECT '/runs/' || path_in_repo AS local_path, path_in_repo FROM listed
""",
        clips=I.CLIP_PATHS,
    ),
)
