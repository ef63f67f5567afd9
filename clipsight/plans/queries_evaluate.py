"""Queries over model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipsight.functions import text
from clipsight.operators import batch, evaluate
from clipsight.plans import inputs as I
from clipsight.plans.registry import Tables, register, with_inputs

# The three steps of the verdict, as the reference database says them.
VERDICT_SQL = """
CASE WHEN raw_output IS NULL THEN 'Unknown'
     WHEN regexp_extract(lower(raw_output), 'classification:\\s*(anomaly|normal)', 1) = 'anomaly' THEN 'Anomaly'
     WHEN regexp_extract(lower(raw_output), 'classification:\\s*(anomaly|normal)', 1) = 'normal' THEN 'Normal'
     WHEN contains(lower(raw_output), 'anomaly') AND NOT contains(lower(raw_output), 'normal') THEN 'Anomaly'
     WHEN contains(lower(raw_output), 'normal') AND NOT contains(lower(raw_output), 'anomaly') THEN 'Normal'
     WHEN contains(lower(raw_output), 'normal') THEN
       CASE WHEN instr(reverse(lower(raw_output)), 'ylamona') + 7 < instr(reverse(lower(raw_output)), 'lamron') + 6
            THEN 'Anomaly' ELSE 'Normal' END
     ELSE 'Unknown' END
"""

PREDICTIONS_SQL = f"""
SELECT r.*, t.true_label, CASE WHEN is_error THEN 'Error' ELSE {VERDICT_SQL} END AS prediction
FROM responses r JOIN truth t ON r.doc_id = t.doc_id
"""


def predictions(t: Tables):
    # Joined before parsing: answers without a ground truth are not parsed.
    return evaluate.with_prediction(evaluate.with_truth(t.derive(I.RESPONSES), t.derive(I.TRUTH), "doc_id"))


def eval_metrics(t: Tables):
    m = evaluate.metrics(predictions(t), "exp_name")
    shown = [F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "avg_seconds")]
    return m.select("exp_name", "total_videos", "tp", "fp", "tn", "fn", "n_scored", *shown)


register(
    "eval_metrics",
    eval_metrics,
    with_inputs(
        """
WITH cells AS (
  SELECT exp_name, count(*) AS total_videos,
         count(*) FILTER (WHERE prediction = 'Anomaly' AND true_label = 1) AS tp,
         count(*) FILTER (WHERE prediction = 'Anomaly' AND true_label = 0) AS fp,
         count(*) FILTER (WHERE prediction IN ('Normal', 'Unknown') AND true_label = 0) AS tn,
         count(*) FILTER (WHERE prediction IN ('Normal', 'Unknown') AND true_label = 1) AS fn,
         coalesce(avg(seconds) FILTER (WHERE prediction <> 'Error'), 0.0) AS avg_seconds
  FROM predictions GROUP BY exp_name),
ratios AS (
  SELECT *, tp + fp + tn + fn AS n_scored,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
  FROM cells)
SELECT exp_name, total_videos, tp, fp, tn, fn, n_scored, round(precision, 4) AS precision, round(recall, 4) AS recall,
       round(CASE WHEN n_scored > 0 THEN (tp + tn) / n_scored ELSE 0.0 END, 4) AS accuracy,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 4) AS f1,
       round(avg_seconds, 4) AS avg_seconds
FROM ratios
""",
        responses=I.RESPONSES,
        truth=I.TRUTH,
        predictions=PREDICTIONS_SQL,
    ),
)

register(
    "eval_counts",
    lambda t: evaluate.class_counts(predictions(t), "exp_name"),
    with_inputs(
        """
SELECT exp_name, count(*) FILTER (WHERE prediction = 'Anomaly') AS n_anomaly,
       count(*) FILTER (WHERE prediction = 'Normal') AS n_normal,
       count(*) FILTER (WHERE prediction = 'Unknown') AS n_unknown,
       count(*) FILTER (WHERE prediction = 'Error') AS n_error
FROM predictions GROUP BY exp_name
""",
        responses=I.RESPONSES,
        truth=I.TRUTH,
        predictions=PREDICTIONS_SQL,
    ),
)

register(
    "verdict_parse",
    lambda t: t.derive(I.RESPONSES).select("doc_id", text.verdict(F.col("raw_output")).alias("verdict")),
    with_inputs(f"SELECT doc_id, {VERDICT_SQL} AS verdict FROM responses", responses=I.RESPONSES),
)

register(
    "result_rows",
    lambda t: evaluate.results(predictions(t)).drop("raw_output"),
    with_inputs(
        """
SELECT exp_name, file, CASE true_label WHEN 1 THEN 'Anomaly' ELSE 'Normal' END AS true_label, prediction,
       CASE WHEN prediction <> 'Error'
            THEN (prediction = 'Anomaly') = (true_label = 1) END AS correct,
       CASE WHEN prediction <> 'Error' THEN round(seconds, 3) ELSE 0.0 END AS inference_time_s
FROM predictions
""",
        responses=I.RESPONSES,
        truth=I.TRUTH,
        predictions=PREDICTIONS_SQL,
    ),
)


def experiments_of(t: Tables):
    """One row per experiment with what its report header says of the run."""
    names = t.derive("SELECT DISTINCT 'exp_' || CAST(doc_id % 3 AS STRING) AS exp_name FROM {documents}")
    return names.select(
        "exp_name",
        F.struct("exp_name", F.lit("no_action").alias("mode")).alias("experiment"),
        F.create_map(F.lit("hostname"), F.lit("local")).alias("environment"),
        F.create_map(F.lit("exp_name"), "exp_name").alias("cli_args"),
        F.create_map(F.lit("fps"), F.lit("4")).alias("inference_params"),
    )


def experiment_report(t: Tables):
    """Every result row of the reports next to all figures of its report's header."""
    experiments = experiments_of(t)
    answered = predictions(t)
    headers = evaluate.report_headers(answered, experiments).select(
        "exp_name", "experiment.mode", F.col("environment.hostname").alias("host"), F.col("inference_params.fps").alias("fps"), "summary.*", "metrics.*"
    )
    for name in ("F1-Score", "Avg Inference Time"):
        headers = headers.withColumn(name, F.round(F.col(f"`{name}`"), 9))
    return evaluate.results(answered).join(headers, "exp_name")


register(
    "experiment_report",
    experiment_report,
    with_inputs(
        """
WITH cells AS (
  SELECT exp_name, count(*) AS total_videos, count(*) FILTER (WHERE prediction = 'Anomaly') AS "Anomaly",
         count(*) FILTER (WHERE prediction = 'Normal') AS "Normal", count(*) FILTER (WHERE prediction = 'Unknown') AS "Unknown",
         count(*) FILTER (WHERE prediction = 'Error') AS "Error",
         count(*) FILTER (WHERE prediction <> 'Error' AND prediction = 'Anomaly' AND true_label = 1) AS "TP",
         count(*) FILTER (WHERE prediction <> 'Error' AND prediction = 'Anomaly' AND true_label = 0) AS "FP",
         count(*) FILTER (WHERE prediction <> 'Error' AND prediction <> 'Anomaly' AND true_label = 0) AS "TN",
         count(*) FILTER (WHERE prediction <> 'Error' AND prediction <> 'Anomaly' AND true_label = 1) AS "FN",
         round(coalesce(avg(seconds) FILTER (WHERE prediction <> 'Error'), 0.0), 9) AS "Avg Inference Time"
  FROM predictions GROUP BY exp_name),
rates AS (
  SELECT *, "TP" + "FP" + "TN" + "FN" AS "count", CASE WHEN "TP" + "FP" > 0 THEN "TP" / ("TP" + "FP") ELSE 0.0 END AS "Precision",
         CASE WHEN "TP" + "FN" > 0 THEN "TP" / ("TP" + "FN") ELSE 0.0 END AS "Recall" FROM cells)
SELECT p.exp_name, p.file, CASE p.true_label WHEN 1 THEN 'Anomaly' ELSE 'Normal' END AS true_label, p.prediction,
       CASE WHEN p.prediction <> 'Error' THEN (p.prediction = 'Anomaly') = (p.true_label = 1) END AS correct, p.raw_output,
       CASE WHEN p.prediction <> 'Error' THEN round(p.seconds, 3) ELSE 0.0 END AS inference_time_s,
       'no_action' AS mode, 'local' AS host, '4' AS fps, total_videos, "Anomaly", "Normal", "Unknown", "Error", "TP", "FP", "TN", "FN",
       "count", "Precision", "Recall", "Avg Inference Time", CASE WHEN "count" > 0 THEN ("TP" + "TN") / "count" ELSE 0.0 END AS "Accuracy",
       round(CASE WHEN "Precision" + "Recall" > 0 THEN 2 * "Precision" * "Recall" / ("Precision" + "Recall") ELSE 0.0 END, 9) AS "F1-Score"
FROM predictions p JOIN rates r ON p.exp_name = r.exp_name
""",
        responses=I.RESPONSES,
        truth=I.TRUTH,
        predictions=PREDICTIONS_SQL,
    ),
)


EXPERIMENT_TIMES = "SELECT event_type, min(ts) AS t0, max(ts) AS t1 FROM {events} GROUP BY event_type"
register(
    "experiment_times",
    lambda t: t.derive(EXPERIMENT_TIMES).select(
        "event_type",
        evaluate.experiment_folder(
            F.col("event_type"), F.col("event_type") == "click", F.when(F.col("event_type") == "view", "reason1").otherwise(""), F.col("t0")
        ).alias("folder"),
        evaluate.run_seconds(F.col("t0"), F.col("t1")).alias("duration_s"),
    ),
    with_inputs(
        """
SELECT event_type, event_type || CASE event_type WHEN 'click' THEN '_action' WHEN 'view' THEN '_reason1' ELSE '' END || '_'
       || strftime(t0, '%Y%m%d-%H%M%S') AS folder, round((epoch_us(t1) - epoch_us(t0)) / 1e6, 1) AS duration_s
FROM runs
""",
        runs=EXPERIMENT_TIMES,
    ),
)


def prompt_assembly(t: Tables):
    rows = t.derive(
        "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'plain' ELSE 'tagged' END AS family, "
        "CASE WHEN event_type = 'click' THEN 'action_grounding' ELSE 'no_action' END AS mode, props FROM {events}"
    )
    return rows.select("event_id", text.question(F.col("family"), F.col("mode"), F.col("props")).alias("prompt"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


register(
    "prompt_assembly",
    prompt_assembly,
    f"""
SELECT event_id,
       CASE WHEN event_type = 'click'
            THEN CASE WHEN user_id % 2 = 0 THEN {_sql_text(text.PLAIN_WITH_ACTION)}
                      ELSE {_sql_text(text.TAGGED_WITH_ACTION)} END || {_sql_text(text.STATE_PREFIX)} || props
            WHEN user_id % 2 = 0 THEN {_sql_text(text.PLAIN_WITHOUT_ACTION)}
            ELSE {_sql_text(text.TAGGED_WITHOUT_ACTION)} END AS prompt
FROM events
""",
)


def _answer(prompt: str) -> str:
    """Stand-in for a model call: refuses some prompts."""
    if len(prompt) % 7 == 0:
        raise ValueError("refused: " + prompt)
    return f"{len(prompt)}/{prompt.count(' ')}"


def batch_enrich(t: Tables):
    done = batch.enrich(t.derive(I.CONVERSATION_ROWS), "row_id", "text", _answer)
    return done.select("row_id", "output", "error", "tries")


BATCH_SQL = """
SELECT row_id, CASE WHEN length(text) % 7 <> 0
                    THEN CAST(length(text) AS VARCHAR) || '/' || CAST(length(text) - length(replace(text, ' ', '')) AS VARCHAR) END AS output,
       CASE WHEN length(text) % 7 = 0 THEN 'refused: ' || text END AS error, 1 AS tries
FROM convs
"""
register("batch_enrich", batch_enrich, with_inputs(BATCH_SQL, convs=I.CONVERSATION_ROWS))

register(
    "batch_tally",
    lambda t: batch.tally(batch.enrich(t.derive(I.CONVERSATION_ROWS), "row_id", "text", _answer)),
    with_inputs(
        """
SELECT count(*) AS n_total, count(*) FILTER (WHERE length(text) % 7 <> 0) AS n_done,
       count(*) FILTER (WHERE length(text) % 7 = 0) AS n_failed,
       CASE WHEN count(*) FILTER (WHERE length(text) % 7 = 0) > 0 THEN 1 ELSE 0 END AS status
FROM convs
""",
        convs=I.CONVERSATION_ROWS,
    ),
)

register(
    "parallelism_check",
    lambda t: evaluate.bad_parallelism(
        t.derive("SELECT o_orderkey, CAST(o_custkey % 8 + 1 AS INT) AS tp, CAST(o_orderkey % 9 AS INT) AS gpus FROM {orders}")
    ),
    """
SELECT o_orderkey, CAST(o_custkey % 8 + 1 AS INT) AS tp, CAST(o_orderkey % 9 AS INT) AS gpus FROM orders
WHERE o_custkey % 8 + 1 > o_orderkey % 9 OR (o_orderkey % 9) % (o_custkey % 8 + 1) <> 0
""",
)
