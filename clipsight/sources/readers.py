"""Readers for the file formats of the workflow.

All of them list and read files on the executors and give the path relative to
``root``.  An absent optional file is an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from clipsight.functions import documents as D
from clipsight.functions import paths, strip
from clipsight.sources import listing

# Header of the label file, in column order.
LABEL_HEADER = ['Video filepath relative to "data/datasets/generated_vids"', "Valid/Invalid",
                "Heuristic Validation", "Comment"]
LABEL_NAMES = ["rel_path", "label", "heuristic", "comment"]
# Texts a CSV reader takes for "no value".
NULL_TOKENS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

RESULT_FIELDS = ("file:STRING, true_label:STRING, prediction:STRING, correct:BOOLEAN, raw_output:STRING, "
                 "inference_time_s:DOUBLE")
# Fields of a stored experiment report.
HEADER_SCHEMA = """
exp_name STRING,
experiment STRUCT<exp_name:STRING, mode:STRING, backend:STRING, timestamp:STRING, start_time:STRING,
  end_time:STRING, duration_s:DOUBLE, num_gpus:INT>,
environment MAP<STRING, STRING>,
cli_args MAP<STRING, STRING>,
inference_params MAP<STRING, STRING>,
summary STRUCT<total_videos:INT, Anomaly:INT, Normal:INT, Unknown:INT, Error:INT>,
metrics STRUCT<Accuracy:DOUBLE, TP:INT, FP:INT, TN:INT, FN:INT, Precision:DOUBLE, Recall:DOUBLE,
  `F1-Score`:DOUBLE, `Avg Inference Time`:DOUBLE, count:INT>
"""
REPORT_SCHEMA = f"{HEADER_SCHEMA}, results ARRAY<STRUCT<{RESULT_FIELDS}>>"


def catalogue(spark: SparkSession, root: str, pattern: str = "*.mp4", folder: str = "") -> DataFrame:
    """``rel_path`` of every matching file below ``root`` (or its sub-folder); contents are not read."""
    return listing.files(spark, root, pattern, folder).select("rel_path")


def whole_texts(spark: SparkSession, root: str, pattern: str, files: DataFrame | None = None) -> DataFrame:
    """``(rel_path, text)`` of every matching text file, empty ones too; ``files`` is a listing if there is one."""
    return listing.texts(spark, root, listing.files(spark, root, pattern) if files is None else files)


def _lines(text: Column) -> Column:
    """Lines of a text; a final line break does not start a line."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    ends_open = F.try_element_at(lines, F.lit(-1)) != ""
    return F.when(ends_open, lines).otherwise(F.slice(lines, F.lit(1), F.size(lines) - 1))


def split_lines(texts: DataFrame) -> DataFrame:
    """``(rel_path, line_no, text)`` from whole texts; every line counts, from 0."""
    return texts.select("rel_path", F.posexplode(_lines(F.col("text"))).alias("line_no", "text"))


def prompt_lines(spark: SparkSession, root: str, pattern: str = "*prompt*.txt") -> DataFrame:
    """``(dir, filename, line_no, text)`` of the prompt files below ``root``.

    An empty file has one row without a line: it is the nearest prompt file of its
    folder all the same.
    """
    rel = F.col("rel_path")
    lines = whole_texts(spark, root, pattern).select("rel_path", F.posexplode_outer(_lines(F.col("text"))).alias("line_no", "text"))
    return lines.select(paths.parent(rel).alias("dir"), paths.file_name(rel).alias("filename"), "line_no", "text")


def prompt_intake(spark: SparkSession, path: str) -> DataFrame:
    """``(index, prompt)``: the non-empty lines of a prompt list, numbered from 0."""
    stripped = F.transform(_lines(F.col("value")), strip)
    return spark.read.text(path, wholetext=True).select(
        F.posexplode(F.filter(stripped, lambda x: x != "")).alias("index", "prompt")
    )


def documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """``(rel_path, doc)`` of the prompt documents; a fixed schema, nothing inferred."""
    doc = F.from_json("text", D.PROMPT_SCHEMA).alias("doc")
    return whole_texts(spark, root, pattern).select("rel_path", doc)


def document_texts(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """``(rel_path, json)``: raw documents, for parse checks and rewriting."""
    return whole_texts(spark, root, pattern).withColumnRenamed("text", "json")


def actions(spark: SparkSession, root: str, pattern: str = "sample_outputs.json") -> DataFrame:
    """``(name, action)`` from model output files ``<name>/sample_outputs.json``; only that field is parsed."""
    outputs = F.from_json("text", "outputs array<struct<content:struct<action:array<array<double>>>>>")["outputs"]
    return whole_texts(spark, root, pattern).select(
        paths.parent(F.col("rel_path")).alias("name"), F.get(outputs, F.lit(0))["content"]["action"].alias("action")
    )


def trajectories(spark: SparkSession, root: str, clips: DataFrame, mode: str) -> DataFrame:
    """Clips with their stored series: ``series`` or an ``error`` class; no clip is dropped."""
    # Full-rate files can be told by name; the others are all text files.
    pattern = f"*{paths.NATIVE_SUFFIX}.txt" if mode == paths.FULL_RATE_MODE else "*.txt"
    return attach_series(clips, whole_texts(spark, root, pattern).withColumnRenamed("rel_path", "series_path"), mode)


def trajectory_table(spark: SparkSession, path: str, clips: DataFrame, mode: str) -> DataFrame:
    """The same from the table ``writers.write_trajectories`` made; only one rate is read."""
    hz = paths.NATIVE_HZ if mode == paths.FULL_RATE_MODE else paths.TARGET_HZ
    stored = spark.read.parquet(path).filter(F.col("hz") == hz)
    return attach_series(clips, stored.select(F.col("out_path").alias("series_path"), F.col("value").alias("text")), mode)


def attach_series(clips: DataFrame, stored: DataFrame, mode: str) -> DataFrame:
    """Clips with the parsed text of ``stored(series_path, text)``; ``error`` says what is wrong with it.

    A stored null is a file that is no text: unreadable, not missing.
    """
    wanted = clips.withColumn("series_path", paths.trajectory_path(F.col("rel_path"), F.lit(mode)))
    return (
        wanted.join(stored.withColumn("text", F.coalesce("text", F.lit("\x00"))), "series_path", "left")
        .withColumn("t", D.trajectory(F.col("text")))
        .select(*clips.columns, "series_path", "t.series", "t.error")
    )


def sidecar_texts(spark: SparkSession, root: str, clips: DataFrame) -> DataFrame:
    """Clips with the stripped text of the same-stem ``.txt`` file (NULL and an error when absent)."""
    stored = whole_texts(spark, root, "*.txt").select(
        F.col("rel_path").alias("series_path"),
        strip(F.col("text")).alias("action_text"),
    )
    return (
        clips.withColumn("series_path", paths.with_suffix(F.col("rel_path"), ".txt"))
        .join(stored, "series_path", "left")
        .withColumn("error", F.when(F.col("action_text").isNull(), F.lit("no action sequence")))
    )


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return not files.select("path").isEmpty()
    except AnalysisException:
        return False


def empty_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "row_no long, " + ", ".join(f"{n} string" for n in LABEL_NAMES))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label store ``(row_no, rel_path, label, heuristic, comment)``: strings, '' for no value.

    An absent file is an empty store, absent columns are '', others are dropped.
    This is the exchange format: a file or a folder of part files, whose rows are
    numbered in the order of the file names (a file is one split).
    ``writers.write_labels`` / ``current_labels`` keep the store itself.
    """
    if not _exists(spark, path):
        return empty_labels(spark)
    raw = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)

    def value(header: str) -> Column:
        if header not in raw.columns:
            return F.lit("")
        c = F.col(f"`{header}`")
        return F.when(c.isNull() | c.isin(NULL_TOKENS), F.lit("")).otherwise(c)

    rows = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_at"),
        *[value(h).alias(n) for h, n in zip(LABEL_HEADER, LABEL_NAMES)],
    )
    # One row per file: where its rows begin.
    files = rows.groupBy("_file").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(files.select("_file", "_first", before.alias("_before")), "_file")
    return numbered.select((F.col("_before") + F.col("_at") - F.col("_first")).alias("row_no"), *LABEL_NAMES)


def skip_list(spark: SparkSession, path: str, tree: str) -> DataFrame:
    """``(tree, file_name)``: one name per line, blanks ignored, each once."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "tree string, file_name string")
    name = strip(F.col("value"))
    return spark.read.text(path).select(F.lit(tree).alias("tree"), name.alias("file_name")).filter("file_name <> ''").distinct()


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of a flag log (a file or a folder of them); empty when there is none.

    The log is read in splits, so ``line_no`` is an ordering key (file, offset of
    the split, row in it) rather than a number.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "line_no struct<file:string,at:long,row:long>, line string")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        place.alias("line_no"), F.col("value").alias("line")
    )


def reports(spark: SparkSession, root: str, pattern: str = "report*.json") -> DataFrame:
    """Nested experiment reports, one document per file; option maps keep every field."""
    return (
        spark.read.schema(REPORT_SCHEMA)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .json(root)
    )


def report_headers(spark: SparkSession, root: str) -> DataFrame:
    """Headers that ``writers.write_reports`` wrote."""
    return spark.read.schema(HEADER_SCHEMA).json(f"{root.rstrip('/')}/headers")


def report_results(spark: SparkSession, root: str) -> DataFrame:
    """Result rows that ``writers.write_reports`` wrote, with ``exp_name`` from the folder."""
    fields = RESULT_FIELDS.replace(":", " ")
    return spark.read.schema(f"{fields}, exp_name STRING").json(f"{root.rstrip('/')}/results")


def variation_matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of the ``| v01 | ... |`` table in a plan text, with the given column names after ``row``."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return (
        spark.read.text(path)
        .filter(F.col("value").rlike(r"^\s*\|\s*v\d+\s*\|"))
        .select(cells.alias("c"))
        .select(F.get("c", F.lit(0)).alias("row"), *[F.get("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    )
