"""Score model answers: verdicts, confusion counts, metrics, report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsight.functions import paths, text
from clipsight.operators.skew import lookup_join

# Classes a prediction can take, in report order.
CLASSES = ["Anomaly", "Normal", "Unknown", "Error"]


def with_prediction(answers: DataFrame, raw: str = "raw_output", error: str | None = "is_error") -> DataFrame:
    """Add ``prediction`` and ``pred_label`` (anomaly 1, anything else 0, NULL for error rows)."""
    parsed = text.verdict(F.col(raw))
    if error:
        parsed = F.when(F.col(error), F.lit("Error")).otherwise(parsed)
    return answers.withColumn("prediction", parsed).withColumn(
        "pred_label",
        F.when(F.col("prediction") == "Error", F.lit(None).cast("int")).otherwise(
            (F.col("prediction") == "Anomaly").cast("int")
        ),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def confusion() -> list[Column]:
    """Mergeable aggregates; error rows count only in ``total_videos`` and ``n_error``."""
    ok = F.col("prediction") != "Error"

    def cell(pred: int, true: int) -> Column:
        return F.count_if(ok & (F.col("pred_label") == pred) & (F.col("true_label") == true))

    return [
        F.count(F.lit(1)).alias("total_videos"),
        cell(1, 1).alias("tp"),
        cell(1, 0).alias("fp"),
        cell(0, 0).alias("tn"),
        cell(0, 1).alias("fn"),
        F.coalesce(F.avg(F.when(ok, F.col("seconds"))), F.lit(0.0)).alias("avg_seconds"),
    ]


def with_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the confusion counts; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        counts.withColumn("n_scored", tp + fp + tn + fn)
        .withColumns(
            {
                "accuracy": _ratio(tp + tn, F.col("n_scored")),
                "precision": _ratio(tp, tp + fp),
                "recall": _ratio(tp, tp + fn),
            }
        )
        .withColumn(
            "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
    )


def metrics(predictions: DataFrame, *group: str) -> DataFrame:
    """One row of metrics per group; partial counts are combined before the shuffle."""
    return with_scores(predictions.groupBy(*group).agg(*confusion()))


def class_counts(predictions: DataFrame, *group: str) -> DataFrame:
    """Rows per class and group, zeros kept."""
    return predictions.groupBy(*group).agg(*class_columns())


def class_columns() -> list[Column]:
    return [F.count_if(F.col("prediction") == c).alias(f"n_{c.lower()}") for c in CLASSES]


def with_truth(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Join predictions to ground truth (``key``, ``true_label``)."""
    return lookup_join(predictions, truth.select(key, "true_label"), [key], "inner")


def results(predictions: DataFrame) -> DataFrame:
    """Result rows of a report; ``correct`` is NULL and the time 0 for error rows."""
    ok = F.col("prediction") != "Error"
    return predictions.select(
        "exp_name",
        "file",
        F.when(F.col("true_label") == 1, F.lit("Anomaly")).otherwise(F.lit("Normal")).alias("true_label"),
        "prediction",
        F.when(ok, F.col("pred_label") == F.col("true_label")).alias("correct"),
        "raw_output",
        F.when(ok, F.round("seconds", 3)).otherwise(F.lit(0.0)).alias("inference_time_s"),
    )


def report_headers(predictions: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row per experiment: its own structs or maps (all columns of ``experiments``), summary and metrics.

    ``experiments`` has one row per ``exp_name``, with ``experiment``,
    ``environment``, ``cli_args`` and ``inference_params``.  The result rows stay a
    table of their own (``results``), so no row grows with an experiment.
    """
    scored = with_scores(predictions.groupBy("exp_name").agg(*confusion(), *class_columns()))
    summed = scored.select(
        "exp_name",
        F.struct(
            F.col("total_videos"), *[F.col(f"n_{c.lower()}").alias(c) for c in CLASSES]
        ).alias("summary"),
        F.when(
            F.col("n_scored") > 0,
            F.struct(
                F.col("accuracy").alias("Accuracy"),
                F.col("tp").alias("TP"),
                F.col("fp").alias("FP"),
                F.col("tn").alias("TN"),
                F.col("fn").alias("FN"),
                F.col("precision").alias("Precision"),
                F.col("recall").alias("Recall"),
                F.col("f1").alias("F1-Score"),
                F.col("avg_seconds").alias("Avg Inference Time"),
                F.col("n_scored").alias("count"),
            ),
        ).alias("metrics"),
    )
    return lookup_join(experiments, summed, ["exp_name"], "inner")


def listed(results: DataFrame) -> DataFrame:
    """Result rows in the order of a report: by experiment, then by path components."""
    return results.orderBy("exp_name", paths.components(F.col("file")))


def nested_report(headers: DataFrame, results: DataFrame) -> DataFrame:
    """Headers with their result rows as one array in report order, for exports known to be small."""
    row = F.struct("file", "true_label", "prediction", "correct", "raw_output", "inference_time_s")
    ordered = F.sort_array(F.collect_list(F.struct(paths.components(F.col("file")).alias("at"), row.alias("row"))))
    rows = results.groupBy("exp_name").agg(F.transform(ordered, lambda x: x["row"]).alias("results"))
    return lookup_join(headers, rows, ["exp_name"])


def explode_results(reports: DataFrame) -> DataFrame:
    """Result rows of nested reports, with their ``position`` in the report."""
    return reports.select(F.col("experiment.exp_name").alias("exp_name"), F.posexplode("results").alias("position", "r")).select("exp_name", "position", "r.*")


def experiment_folder(name: Column, action: Column, family_suffix: Column, at: Column) -> Column:
    """``name[_action][_suffix]_yyyyMMdd-HHmmss``."""
    return F.concat(
        name,
        F.when(action, F.lit("_action")).otherwise(F.lit("")),
        F.when(family_suffix != "", F.concat(F.lit("_"), family_suffix)).otherwise(F.lit("")),
        F.lit("_"),
        F.date_format(at, "yyyyMMdd-HHmmss"),
    )


def run_seconds(start: Column, end: Column) -> Column:
    """Length of a run in seconds, to a tenth."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(micros / 1e6, 1)


def bad_parallelism(experiments: DataFrame) -> DataFrame:
    """Experiments whose tensor-parallel size does not divide the number of GPUs."""
    tp, gpus = F.col("tp"), F.col("gpus")
    return experiments.filter((tp > gpus) | (gpus % tp != 0))
