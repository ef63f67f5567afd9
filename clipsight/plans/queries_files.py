"""Files end to end: every query writes its files from the given tables and reads them back.

They go below a new folder of the shared work folder, which its owner clears.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.functions import documents as D
from clipsight.functions import paths
from clipsight.operators import batch, catalog, evaluate, kinematics, review
from clipsight.plans import inputs as I
from clipsight.plans import queries_review, registry  # noqa: F401 - some queries here have the SQL of others
from clipsight.plans.queries_evaluate import PREDICTIONS_SQL, experiments_of, predictions
from clipsight.plans.queries_motion import CHECKED_SQL, MEANS_SQL, STATUS_SQL, status_rows
from clipsight.plans.registry import QUERIES, Tables, with_inputs
from clipsight.session import work_folder
from clipsight.sources import readers, writers
from clipsight.sources.label_store import LabelStore
from clipsight.streaming import incremental, keyed



def register(name: str, run: Callable[[Tables], DataFrame], sql: str) -> None:
    registry.register(name, run, sql, writes=True)


# ---------------------------------------------------------------- small files

CLIP_FILES = """
SELECT s_suppkey,
       'set_' || CAST(s_nationkey AS STRING) || CASE s_suppkey % 3 WHEN 0 THEN '/_held/.back' WHEN 1 THEN '/positive scenarios' ELSE '' END ||
       '/clip+' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 4 WHEN 3 THEN '.txt' ELSE '.mp4' END AS rel_path
FROM {supplier}
"""


def catalogue_files(t: Tables) -> DataFrame:
    """Empty files among hidden and odd names, listed level by level."""
    root = work_folder(t.spark)
    writers.write_files(t.derive(CLIP_FILES).withColumn("value", F.lit("")), root, "rel_path")
    return catalog.require_rows(readers.catalogue(t.spark, root), "clips")


register("catalogue_files", catalogue_files, with_inputs("SELECT rel_path FROM clips WHERE rel_path LIKE '%.mp4'", clips=CLIP_FILES))


def prompt_files(t: Tables) -> DataFrame:
    """Prompt files of up to twelve lines."""
    root = work_folder(t.spark)
    line = F.struct("line_no", F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("text"))
    texts = t.derive(I.PROMPT_LINES).groupBy("dir", "filename").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    whole = F.concat(F.array_join(F.col("lines.text"), "\n"), F.lit("\n"))
    writers.write_files(texts.select(F.concat_ws("/", "dir", "filename").alias("out_path"), whole.alias("value")), root)
    return readers.prompt_lines(t.spark, root)


register(
    "prompt_files",
    prompt_files,
    with_inputs(
        """
SELECT dir, filename, CAST(row_number() OVER (PARTITION BY dir, filename ORDER BY line_no) - 1 AS INT) AS line_no,
       regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') AS text FROM lines
""",
        lines=I.PROMPT_LINES,
    ),
)

PROMPT_LIST = "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '  ' ELSE ' ' || s_name || chr(9) END AS value FROM {supplier}"


def prompt_intake(t: Tables) -> DataFrame:
    """A prompt list with blank lines."""
    root = work_folder(t.spark)
    t.derive(PROMPT_LIST).orderBy("s_suppkey").select("value").coalesce(1).write.text(root)
    return readers.prompt_intake(t.spark, root)


register(
    "prompt_intake",
    prompt_intake,
    with_inputs("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS index, trim(value, ' ' || chr(9)) AS prompt FROM list WHERE trim(value) <> ''", list=PROMPT_LIST),
)

DOCUMENT_FILES = """
SELECT s_suppkey,
       CASE s_suppkey % 6 WHEN 0 THEN '{{"fps": 24' WHEN 1 THEN '[1]' ELSE
       '{{"subjects": [{{"description": "' || s_name || '", "number_of_legs": ' || CAST(s_suppkey % 5 AS STRING) || '}}], "duration": "' ||
       CAST(s_nationkey AS STRING) || 's", "fps": 24, "later": {{}}}}' END AS json
FROM {supplier}
"""


def document_files(t: Tables) -> DataFrame:
    """Prompt documents, some broken or no objects, under a fixed schema."""
    root = work_folder(t.spark)
    named = t.derive(DOCUMENT_FILES).select(F.format_string("d%d/prompt_%d.json", F.col("s_suppkey") % 3, "s_suppkey").alias("out_path"), F.col("json").alias("value"))
    writers.write_files(named, root)
    first = F.get("doc.subjects", F.lit(0))
    return readers.documents(t.spark, root).select(
        "rel_path", F.col("doc.fps").alias("fps"), F.col("doc.duration").alias("duration"), first["description"].alias("subject"), first["number_of_legs"].alias("legs"))


register(
    "document_files",
    document_files,
    with_inputs(
        """
SELECT 'd' || CAST(s_suppkey % 3 AS VARCHAR) || '/prompt_' || CAST(s_suppkey AS VARCHAR) || '.json' AS rel_path,
       CAST(doc ->> '$.fps' AS INT) AS fps, doc ->> '$.duration' AS duration, doc ->> '$.subjects[0].description' AS subject,
       CAST(doc ->> '$.subjects[0].number_of_legs' AS INT) AS legs
FROM (SELECT s_suppkey, CASE WHEN json_valid(json) THEN CAST(json AS JSON) END AS doc FROM docs)
""",
        docs=DOCUMENT_FILES,
    ),
)


def action_files(t: Tables) -> DataFrame:
    """Model outputs of nested numbers; only the actions are read."""
    root = work_folder(t.spark)
    steps = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.slice(F.col("embedding"), k * 9 + 1, F.lit(9)))
    content = F.struct(F.lit("text").alias("kind"), steps.alias("action"))
    output = F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct(content.alias("content"))).alias("outputs")))
    writers.write_files(t.embeddings.select(F.format_string("clip_%d/sample_outputs.json", "vec_id").alias("out_path"), output.alias("value")), root)
    read = readers.actions(t.spark, root).select("name", F.posexplode("action").alias("k", "step"))
    return read.select("name", "k", F.size("step").alias("n"), F.get("step", F.lit(8)).cast("float").cast("double").alias("last"))


register(
    "action_files",
    action_files,
    """
SELECT 'clip_' || CAST(vec_id AS VARCHAR) AS name, CAST(k AS INT) AS k, CAST(9 AS INT) AS n, CAST(embedding[k * 9 + 9] AS DOUBLE) AS last
FROM embeddings, (SELECT unnest(range(7)) AS k)
""",
)

SERIES_FILES = """
SELECT s_suppkey, 'set/clip_' || CAST(s_suppkey AS STRING) || '.mp4' AS rel_path,
       CASE s_suppkey % 7
         WHEN 0 THEN '[[' || CAST(s_suppkey AS STRING) || ', 1.5], [3, 4]]'
         WHEN 1 THEN 'oops ' || CAST(s_suppkey AS STRING)
         WHEN 2 THEN '[]'
         WHEN 4 THEN '[[1, 2], [3, "x"]]'
         WHEN 5 THEN '' WHEN 6 THEN ' walks on ' || CAST(s_suppkey AS STRING) || ' ' END AS txt
FROM {supplier}
"""


def _series_files(t: Tables) -> tuple[DataFrame, str]:
    """Files next to clips: sound, broken, empty, absent (a null), and bytes that are no text."""
    root, rows = work_folder(t.spark), t.derive(SERIES_FILES)
    value = F.when(F.col("s_suppkey") % 14 == 6, F.unhex(F.lit("5B5BFF"))).otherwise(F.encode("txt", "UTF-8"))
    named = rows.filter("txt is not null").select(paths.with_suffix(F.col("rel_path"), ".txt").alias("out_path"), value.alias("value"))
    writers.write_files(named, root)
    return rows.select("rel_path"), root


def trajectory_files(t: Tables) -> DataFrame:
    clips, root = _series_files(t)
    found = readers.trajectories(t.spark, root, clips, "downsampled")
    return found.select("rel_path", "error", F.size("series").cast("long").alias("n"), F.get("series", F.lit(0))["v"].alias("v0"))


register(
    "trajectory_files",
    trajectory_files,
    with_inputs(
        """
SELECT rel_path, CASE s_suppkey % 7 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'empty_or_invalid' WHEN 3 THEN 'missing' WHEN 4 THEN 'invalid_rows'
                   WHEN 5 THEN 'unreadable' WHEN 6 THEN 'unreadable' END AS error,
       CASE s_suppkey % 7 WHEN 0 THEN 2 END AS n, CASE s_suppkey % 7 WHEN 0 THEN CAST(s_suppkey AS DOUBLE) END AS v0
FROM files
""",
        files=SERIES_FILES,
    ),
)


def sidecar_files(t: Tables) -> DataFrame:
    clips, root = _series_files(t)
    return readers.sidecar_texts(t.spark, root, clips).select("rel_path", "action_text", "error")


register(
    "sidecar_files",
    sidecar_files,
    with_inputs(
        """
SELECT rel_path, CASE WHEN s_suppkey % 14 <> 6 THEN trim(txt) END AS action_text,
       CASE WHEN txt IS NULL OR s_suppkey % 14 = 6 THEN 'no action sequence' END AS error
FROM files
""",
        files=SERIES_FILES,
    ),
)


def pretty_files(t: Tables) -> DataFrame:
    """Indented documents, made compact again."""
    root = work_folder(t.spark)
    writers.write_pretty(t.derive(I.VARIANT_DOCUMENTS).withColumnRenamed("file", "rel_path"), root)
    read = t.spark.read.parquet(root)
    return read.select("rel_path", D.compact(F.col("value")).alias("json"), (F.size(F.split("value", "\n")) > 20).alias("indented"))


register("pretty_files", pretty_files, with_inputs("SELECT file AS rel_path, json, true AS indented FROM docs", docs=I.VARIANT_DOCUMENTS))

# ---------------------------------------------------------------- tables in exchange formats

LABEL_FILE = """
SELECT event_id AS row_no, 'clip_' || CAST(user_id AS STRING) || '.mp4' AS rel_path,
       CASE event_id % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'Invalid' WHEN 2 THEN '' ELSE 'Valid' END AS label,
       CASE WHEN event_type = 'error' THEN 'FLAGGED' ELSE 'null' END AS heuristic,
       'say "' || event_type || '", twice' || chr(10) || CAST(event_id AS STRING) AS comment
FROM {events}
"""


def label_files(t: Tables) -> DataFrame:
    """Part files with quotes, line breaks and words for no value; rows in the order of the files."""
    root = work_folder(t.spark)
    writers.export_labels(t.derive(LABEL_FILE), root)
    return readers.labels(t.spark, root)


register(
    "label_files",
    label_files,
    with_inputs(
        """
SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, rel_path, CASE WHEN label = 'NA' THEN '' ELSE label END AS label,
       CASE heuristic WHEN 'null' THEN '' ELSE heuristic END AS heuristic, comment FROM store
""",
        store=LABEL_FILE,
    ),
)

def skip_files(t: Tables) -> DataFrame:
    """A list per tree with blanks and repeated names; a list that is not there is empty."""
    root, rows = work_folder(t.spark), t.derive(I.SKIP_LIST)
    value = F.when(F.col("file_name").like("%\\_v07.mp4"), " ").otherwise(F.concat(F.lit("  "), "file_name", F.lit(" ")))
    rows.select("tree", value.alias("value")).write.partitionBy("tree").text(root)
    lists = [readers.skip_list(t.spark, f"{root}/tree={tree}", tree) for tree in ("negative", "positive", "other")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


register("skip_files", skip_files, with_inputs("SELECT DISTINCT tree, file_name FROM skips WHERE file_name NOT LIKE '%\\_v07.mp4' ESCAPE '\\'", skips=I.SKIP_LIST))


def report_files(t: Tables) -> DataFrame:
    """Reports as header and result lines, read back and joined."""
    root, answered = work_folder(t.spark), predictions(t)
    writers.write_reports(evaluate.report_headers(answered, experiments_of(t)), evaluate.results(answered), root)
    headers = readers.report_headers(t.spark, root).select(
        "exp_name", F.col("environment.hostname").alias("host"), "summary.total_videos", F.round("metrics.Accuracy", 9).alias("accuracy"))
    return readers.report_results(t.spark, root).drop("raw_output").join(headers, "exp_name")


register(
    "report_files",
    report_files,
    with_inputs(
        """
WITH rates AS (
  SELECT exp_name, CAST(count(*) AS INT) AS total_videos,
         round(count(*) FILTER (WHERE (prediction = 'Anomaly') = (true_label = 1) AND prediction <> 'Error') / count(*) FILTER (WHERE prediction <> 'Error'), 9) AS accuracy
  FROM predictions GROUP BY exp_name)
SELECT exp_name, file, CASE true_label WHEN 1 THEN 'Anomaly' ELSE 'Normal' END AS true_label, prediction,
       CASE WHEN prediction <> 'Error' THEN (prediction = 'Anomaly') = (true_label = 1) END AS correct,
       CASE WHEN prediction <> 'Error' THEN round(seconds, 3) ELSE 0.0 END AS inference_time_s, 'local' AS host, total_videos, accuracy
FROM predictions JOIN rates USING (exp_name)
""",
        responses=I.RESPONSES,
        truth=I.TRUTH,
        predictions=PREDICTIONS_SQL,
    ),
)


def flag_report(t: Tables) -> DataFrame:
    """The flag report written, and its paths and counts read back."""
    root = work_folder(t.spark)
    writers.write_flag_report(status_rows(t), root)
    lines = readers.log_lines(t.spark, root)
    flags = review.parse_flags(lines).select("rel_path", F.lit("flag").alias("kind"))
    title = lines.filter(F.col("line").startswith(writers.FLAG_TITLE)).select(
        F.regexp_extract("line", r"\((\d+) issue", 1).alias("rel_path"), F.lit("title").alias("kind"))
    return flags.unionByName(title)


register(
    "flag_report",
    flag_report,
    with_inputs(
        """
WITH flagged AS (SELECT 'clip_' || CAST(clip AS VARCHAR) || '.mp4' AS rel_path FROM kinds WHERE kind NOT IN ('matched', 'no_sentence', 'unclassified'))
SELECT rel_path, 'flag' AS kind FROM flagged UNION ALL SELECT CAST(count(*) AS VARCHAR), 'title' FROM flagged
""",
        samples=I.SAMPLES,
        expected=I.EXPECTED,
        means=MEANS_SQL,
        checked=CHECKED_SQL,
        kinds=STATUS_SQL,
    ),
)


def series_files(t: Tables) -> DataFrame:
    """Series of both rates written as one table and read by rate."""
    root = work_folder(t.spark)
    pose = F.struct("k", F.struct("px", "pz", "fx", "fz").alias("p"))
    clips = t.derive(I.POSES).groupBy("clip").agg(F.transform(F.sort_array(F.collect_list(pose)), lambda x: x["p"]).alias("poses"))
    named = kinematics.with_series(clips).withColumn("rel_path", F.format_string("run/clip_%d.mp4", "clip"))
    writers.write_trajectories(named, root)
    both = [readers.trajectory_table(t.spark, root, named.select("clip", "rel_path"), mode).withColumn("hz", F.lit(hz))
            for mode, hz in ((paths.FULL_RATE_MODE, paths.NATIVE_HZ), ("downsampled", paths.TARGET_HZ))]
    read = both[0].unionByName(both[1]).select("clip", "hz", F.posexplode("series").alias("i", "s"))
    return read.select("clip", F.col("hz").cast("int").alias("hz"), F.col("i").cast("long").alias("i"), "s.v", "s.h")


register("series_files", series_files, QUERIES["both_rates"].sql)

# ---------------------------------------------------------------- label store and streams


def label_store(t: Tables) -> DataFrame:
    """Two updates as deltas, the buckets with both of them folded, then merged on reading."""
    store = LabelStore(t.spark, work_folder(t.spark), buckets=16)
    store.replace(t.derive(I.LABEL_STORE))
    updates = t.derive(I.LABEL_UPDATES)
    store.update(updates.filter("seq % 2 = 0"))
    store.update(updates.filter("seq % 2 = 1"))
    store.compact(2)
    store.update(updates.filter("seq % 2 = 0").withColumn("comment", F.lit("again")))
    return store.current()


def _updated_sql(store: str, updates: str) -> str:
    return f"""
SELECT s.row_no, s.rel_path, coalesce(u.label, s.label) AS label, coalesce(u.heuristic, s.heuristic) AS heuristic, coalesce(u.comment, s.comment) AS comment
FROM {store} s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY seq DESC) AS rn FROM {updates}) u ON s.rel_path = u.rel_path AND rn = 1
UNION ALL
SELECT (SELECT max(row_no) + 1 FROM {store}) + min(seq), rel_path, max_by(label, seq), max_by(heuristic, seq), max_by(comment, seq)
FROM {updates} WHERE rel_path NOT IN (SELECT rel_path FROM {store}) GROUP BY rel_path
"""


register(
    "label_store",
    label_store,
    with_inputs(
        f"""
WITH even AS (SELECT * FROM updates WHERE seq % 2 = 0), odd AS (SELECT * FROM updates WHERE seq % 2 = 1),
again AS (SELECT seq, rel_path, label, heuristic, 'again' AS comment FROM even),
s1 AS ({_updated_sql("store", "even")}), s2 AS ({_updated_sql("s1", "odd")})
{_updated_sql("s2", "again")}
""",
        store=I.LABEL_STORE,
        updates=I.LABEL_UPDATES,
    ),
)


def label_settled(t: Tables) -> DataFrame:
    """Last labels from a stream with state per path, caught up with in two runs from one checkpoint."""
    root = work_folder(t.spark)
    rows = t.derive(I.LABEL_STORE.replace("event_id AS row_no,", "event_id AS seq, ts AS arrived,")).withColumn("arrived", F.col("arrived").cast("timestamp"))
    half = t.events.agg(F.max("event_id") / 2).scalar()
    # A last update, a day later, lets the time of the stream pass all others.
    end = rows.agg(F.max("seq").alias("seq"), F.max("arrived").alias("arrived")).select(
        F.col("seq") + 1, F.col("arrived") + F.expr("interval 1 day"), F.lit("").alias("rel_path"), *[F.lit("").alias(c) for c in review.LABEL_COLUMNS])
    schema = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    for part in (rows.filter(F.col("seq") < half), rows.filter(F.col("seq") >= half).unionAll(end)):
        part.write.mode("append").parquet(f"{root}/updates")
        updates = incremental.new_files(t.spark, f"{root}/updates", schema)
        keyed.settle_labels(updates, f"{root}/settled", f"{root}/checkpoint").awaitTermination()
    return keyed.settled_labels(t.spark, f"{root}/settled").filter("rel_path <> ''").withColumnRenamed("seq", "row_no")


register("label_settled", label_settled, QUERIES["label_last"].sql)


def metrics_stream(t: Tables) -> DataFrame:
    """Confusion counts kept by a stream over files that arrive in two lots."""
    root = work_folder(t.spark)
    rows = predictions(t).select("doc_id", "exp_name", "prediction", "pred_label", "true_label", "seconds")
    for lot in (0, 1):
        rows.filter(F.col("doc_id") % 2 == lot).write.mode("append").parquet(f"{root}/answers")
        schema = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
        incremental.running_metrics(incremental.new_files(t.spark, f"{root}/answers", schema), f"{root}/metrics", f"{root}/checkpoint").awaitTermination()
    shown = [F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "avg_seconds")]
    return incremental.latest_metrics(t.spark, f"{root}/metrics").select("exp_name", "total_videos", "tp", "fp", "tn", "fn", "n_scored", *shown)


register("metrics_stream", metrics_stream, QUERIES["eval_metrics"].sql)

# ---------------------------------------------------------------- calls with a journal


def _refusing(prompt: str) -> str:
    if len(prompt) % 7 == 0:
        raise ValueError("refused")
    return f"{len(prompt)}/{prompt.count(' ')}"


def batch_journal(t: Tables) -> DataFrame:
    """Retried, absent and journalled calls: the second pass finds the answers of the first."""
    rows = t.derive("SELECT conv_id * 1000 + turn AS row_id, CASE role WHEN 'system' THEN NULL ELSE text END AS text FROM {conversations}")
    options = {"max_retries": 2, "base_delay_s": 0.0, "absent": "nothing asked", "concurrency": 4, "partitions": 8, "journal": work_folder(t.spark)}
    batch.enrich(rows, "row_id", "text", _refusing, **options).write.format("noop").mode("overwrite").save()
    return batch.enrich(rows, "row_id", "text", _refusing, **options).select("row_id", "output", "error", "tries")


register(
    "batch_journal",
    batch_journal,
    """
SELECT conv_id * 1000 + turn AS row_id,
       CASE WHEN role <> 'system' AND length(text) % 7 <> 0 THEN CAST(length(text) AS VARCHAR) || '/' || CAST(length(text) - length(replace(text, ' ', '')) AS VARCHAR) END AS output,
       CASE WHEN role = 'system' THEN 'nothing asked' WHEN length(text) % 7 = 0 THEN 'refused' END AS error,
       CAST(CASE WHEN role = 'system' THEN 0 WHEN length(text) % 7 = 0 THEN 3 ELSE 1 END AS INT) AS tries
FROM conversations
""",
)
