"""The four workflows over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.functions import documents as D
from clipsight.functions import paths, series, text
from clipsight.operators import batch, catalog, checks, corpus, evaluate, kinematics, review
from clipsight.operators.skew import lookup_join, positions_and_size
from clipsight.sources import writers


def motion_check(clips: DataFrame, actions: DataFrame, prompt_lines: DataFrame, frame: str = "local") -> DataFrame:
    """Predicted actions -> series -> comparison with the prompt sentence.

    ``clips(rel_path)``, ``actions(name, action)``, ``prompt_lines(dir, filename,
    line_no, text)``.  A clip's samples stay in its row, so the kinematics need
    no shuffle; the plan shuffles once for clips x actions and joins the
    sentences by directory and line.
    """
    moved = kinematics.with_series(
        kinematics.poses_from_actions(actions, frame=frame).drop("action")
    ).withColumn("has_prediction", F.lit(True))
    named = catalog.require_rows(clips, "clips").withColumn("name", paths.run_name(F.col("rel_path")))
    joined = named.join(moved, "name", "left").withColumn("has_prediction", F.coalesce("has_prediction", F.lit(False)))
    told = catalog.with_prompt_sentence(joined, prompt_lines)
    summary = told.withColumn("m", series.series_summary(F.col("series_10hz")))
    numbers = summary.select(
        "rel_path", "has_prediction", "sentence", "init_v", "series_10hz", "series_5hz",
        F.least(F.size("series_10hz"), F.size("series_5hz")).alias("n"),
        "m.start_v", "m.end_v", "m.max_abs_h",
    )
    return checks.assign_status(checks.check_motion(checks.with_expectation(numbers))).withColumn(
        "line", checks.status_line()
    )


def pending_jobs(clips: DataFrame, done: DataFrame) -> DataFrame:
    """Clips that still need a model run."""
    named = clips.withColumn("name", paths.run_name(F.col("rel_path")))
    return catalog.pending(named, done, "name")


def evaluate_model(
    clips: DataFrame,
    sidecars: DataFrame | None,
    fn: Callable[[str], str],
    *,
    exp_name: str,
    family: str = "plain",
    mode: str = "no_action",
    **options,
) -> DataFrame:
    """Labelled clips -> prompt -> model answer -> prediction rows.

    ``sidecars(rel_path, action_text)`` is needed in the action-grounded mode; a
    clip without one becomes an error row.  Feed the result to
    ``evaluate.metrics`` / ``evaluate.report``.
    """
    rows = catalog.require_rows(catalog.labelled(clips), "labelled clips")
    if sidecars is not None:
        rows = rows.join(sidecars.select("rel_path", "action_text"), "rel_path", "left")
    else:
        rows = rows.withColumn("action_text", F.lit(None).cast("string"))
    asked = rows.withColumn("prompt", text.question(F.lit(family), F.lit(mode), F.col("action_text")))
    # A row without a prompt passes through as an error: the inputs are read once.
    answered = batch.enrich(asked, "rel_path", "prompt", fn, keep=["true_label"], absent="no action sequence", **options).select(
        "rel_path", "true_label", F.coalesce("output", "error").alias("raw_output"),
        F.col("error").isNotNull().alias("is_error"), F.col("elapsed_s").alias("seconds"),
    )
    rows = answered.withColumns({"exp_name": F.lit(exp_name), "file": F.col("rel_path")})
    return evaluate.with_prediction(rows)


def evaluate_and_report(
    clips: DataFrame,
    sidecars: DataFrame | None,
    fn: Callable[[str], str],
    experiments: DataFrame,
    target: str,
    *,
    exp_name: str,
    **options,
) -> DataFrame:
    """Run the model once per clip, keep the answers, write the report, return the metrics."""
    answers = writers.stored(
        evaluate_model(clips, sidecars, fn, exp_name=exp_name, **options), f"{target}/answers"
    )
    writers.write_reports(evaluate.report_headers(answers, experiments), evaluate.results(answers), f"{target}/reports")
    return evaluate.metrics(answers, "exp_name")


def review_queue(
    clips: DataFrame, prompt_lines: DataFrame, flags: DataFrame, store: DataFrame, skip: DataFrame
) -> DataFrame:
    """Everything a reviewer sees per clip: sentence, flag, stored label, position and neighbours."""
    # Placed first: numbering needs only the paths, and its size check stays cheap.
    foldered = clips.withColumn("folder", paths.parent(F.col("rel_path")))
    placed, large = positions_and_size(foldered, ["folder"], [paths.components(F.col("rel_path"))], "pos", "n_in_folder")
    near = review.next_previous(catalog.mark_skipped(placed, skip), "folder", large=large)
    told = catalog.with_prompt_sentence(near, prompt_lines)
    flagged = review.with_heuristic(told, flags)
    return review.with_labels(flagged, store.select("row_no", "rel_path", "label", "comment"))


def prepare_prompts(prompts: DataFrame, fn: Callable[[str], str], **options) -> DataFrame:
    """Prompt lines ``(index, prompt)`` -> generated documents, unwrapped and compacted, errors kept."""
    made = batch.enrich(catalog.require_rows(prompts, "prompts"), "index", "prompt", fn, **options)
    docs = corpus.unwrapped(made.withColumnRenamed("error", "call_error"), "output")
    return docs.select(
        "index",
        D.compact(F.col("document")).alias("document"),
        F.coalesce("call_error", "error").alias("error"),
        "elapsed_s",
    )


def clips_with_duration(clips: DataFrame, probes: DataFrame) -> DataFrame:
    """Add ``duration_s`` from probed container fields."""
    picked = probes.select(
        "rel_path",
        D.clip_duration(F.col("duration"), F.col("nb_frames"), F.col("avg_frame_rate"), F.col("r_frame_rate")).alias("duration_s"),
    )
    return lookup_join(clips, picked, ["rel_path"])
