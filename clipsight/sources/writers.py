"""Writers for the workflow's outputs.

Everything is written by the tasks, one file per partition; only headers and
pointers are single rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clipsight.functions import documents as D
from clipsight.functions import paths
from clipsight.functions import series as S
from clipsight.operators import checks, evaluate
from clipsight.sources import listing, readers

# Constants of a job line, in field order.
JOB_CONSTANTS = {
    "action_chunk_size": 60,
    "domain_name": "av",
    "fps": 10,
    "image_size": 480,
    "view_point": "ego_view",
    "model_mode": "inverse_dynamics",
}
JOB_PROMPT = "You are an autonomous vehicle planning system."
JOB_SEED = 0
# Head of the flag log.
FLAG_TITLE = "Inverse-dynamics validation flags"
FLAG_SUBTITLE = ("Heuristic, language-based comparison of the action-sequence tail vs the last sentence of "
                 "each prompt.")


def stored(df: DataFrame, target: str) -> DataFrame:
    """Write a table and return it read back: what produced it runs once, whatever is derived from it."""
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)


def job_lines(clips: DataFrame, root: str) -> DataFrame:
    """``value``: one JSON job per clip."""
    fields = [F.lit(v).alias(k) for k, v in JOB_CONSTANTS.items()]
    job = F.struct(
        *fields,
        paths.run_name(F.col("rel_path")).alias("name"),
        F.lit(JOB_PROMPT).alias("prompt"),
        F.lit(JOB_SEED).alias("seed"),
        F.concat(F.lit(root.rstrip("/") + "/"), F.col("rel_path")).alias("vision_path"),
    )
    return clips.select(F.to_json(job).alias("value"))


def write_job_lines(clips: DataFrame, root: str, target: str) -> None:
    job_lines(clips, root).write.mode("overwrite").text(target)


def trajectory_rows(clips: DataFrame) -> DataFrame:
    """``(rel_path, out_path, hz, value)`` of both rates from ``series_10hz`` / ``series_5hz``."""
    both = F.array(
        F.struct(F.lit(paths.NATIVE_HZ).alias("hz"), F.lit(paths.FULL_RATE_MODE).alias("mode"), F.col("series_10hz").alias("series")),
        F.struct(F.lit(paths.TARGET_HZ).alias("hz"), F.lit("downsampled").alias("mode"), F.col("series_5hz").alias("series")),
    )
    return clips.select("rel_path", F.inline(both)).select(
        "rel_path",
        paths.trajectory_path(F.col("rel_path"), F.col("mode")).alias("out_path"),
        "hz",
        S.series_text(F.col("series")).alias("value"),
    )


def write_trajectories(clips: DataFrame, target: str) -> None:
    """One table partitioned by rate, so a reader of one rate skips the other."""
    trajectory_rows(clips).write.mode("overwrite").partitionBy("hz").parquet(target)


def write_files(rows: DataFrame, root: str, path: str = "out_path", value: str = "value") -> None:
    """One file per row at ``root`` / ``path``, written by the tasks; ``value`` is text or bytes.

    For tools that read the files next to the clips; ``root`` is a folder or store that
    every executor reaches.  Each file appears whole (temporary name, then rename), so a
    repeated task writes the same files again.
    """
    base = listing.qualified(rows.sparkSession, root)
    top = listing.bare(base)

    def put(part: Iterable[Row]) -> None:
        store, made = listing.opened(base), set()
        for row in part:
            target = f"{top}/{row[path]}"
            folder = target.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            partial = f"{target}.{uuid.uuid4().hex}.tmp"
            content = row[value]
            with store.open_output_stream(partial) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
            store.move(partial, target)

    rows.select(path, value).foreachPartition(put)


def upload_manifest(clips: DataFrame, root: str) -> DataFrame:
    """``(local_path, path_in_repo)`` for both trajectory files of every clip handed in."""
    rel = F.col("rel_path")
    out = F.explode(
        F.array(*[paths.trajectory_path(rel, F.lit(m)) for m in ("downsampled", paths.FULL_RATE_MODE)])
    )
    return _mirrored(clips.select(out.alias("path_in_repo")), root)


def _mirrored(files: DataFrame, root: str) -> DataFrame:
    return files.select(F.concat(F.lit(root.rstrip("/") + "/"), F.col("path_in_repo")).alias("local_path"), "path_in_repo")


def run_manifest(checked: DataFrame, root: str, summary: str) -> DataFrame:
    """Manifest of a checked run: both files of the clips that have a series, and the flag summary."""
    flags = checked.sparkSession.createDataFrame([(summary,)], "path_in_repo string")
    return upload_manifest(checked.filter("n >= 1"), root).unionByName(_mirrored(flags, root))


def rendered_manifest(clips: DataFrame, root: str) -> DataFrame:
    """Manifest of rendered clips themselves."""
    return _mirrored(clips.select(F.col("rel_path").alias("path_in_repo")), root)


def flag_lines(checked: DataFrame) -> DataFrame:
    """``(rel_path, value)``: the log lines of flagged clips."""
    return checked.filter(F.col("status") == checks.FLAG).select("rel_path", checks.status_line().alias("value"))


def flag_header(lines: DataFrame) -> DataFrame:
    """``value``: title with the number of flags, what they mean, and ``(no flags)`` if there are none."""
    n = lines.agg(F.count(F.lit(1)).alias("n"))
    head = F.array(
        F.concat(F.lit(f"{FLAG_TITLE} ("), F.col("n").cast("string"), F.lit(" issue(s))")),
        F.lit(FLAG_SUBTITLE),
        F.lit(""),
        F.when(F.col("n") == 0, F.lit("(no flags)")),
    )
    return n.select(F.explode(F.array_compact(head)).alias("value"))


def write_flag_report(checked: DataFrame, target: str) -> None:
    """Header in ``section=0``, ordered flag lines in ``section=1`` (sorted by range, so part
    files follow each other).  The sort samples the checks once more than it writes
    them; the count is taken from the written lines."""
    ordered = flag_lines(checked).orderBy(paths.components(F.col("rel_path")))
    ordered.select("value").write.mode("overwrite").text(f"{target}/section=1")
    written = checked.sparkSession.read.text(f"{target}/section=1")
    flag_header(written).coalesce(1).write.mode("overwrite").text(f"{target}/section=0")


class StoreChanged(RuntimeError):
    """Someone else wrote the label store since it was read."""


def write_labels(store: DataFrame, folder: str, after: int | None = None) -> int:
    """Write the label store as the next version below ``folder``; returns its number.

    ``after`` is the version the labels were derived from (``label_version``); by
    default the newest.  Of two writers that build on the same version the second
    is refused: the entry of a version is created exclusively, once.  Readers see
    the old or the new store, never half of one.
    """
    spark, base = store.sparkSession, folder.rstrip("/")
    number = (label_version(spark, base) if after is None else after) + 1
    name = f"v-{uuid.uuid4().hex}"
    store.select("row_no", *readers.LABEL_NAMES).write.parquet(f"{base}/{name}")
    entry = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/versions/{number:012d}")
    system = entry.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = system.create(entry, False)
    except Exception as exc:
        raise StoreChanged(f"version {number} of {base} exists already") from exc
    out.write(bytearray(name.encode()))
    out.close()
    return number


def label_version(spark: SparkSession, folder: str) -> int:
    """Number of the newest version of a label store; 0 before the first write."""
    versions = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/versions")
    system = versions.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(versions):
        return 0
    return max((int(x.getPath().getName()) for x in system.listStatus(versions)), default=0)


def current_labels(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The newest (or the given) version of the label store; empty before the first write."""
    base = folder.rstrip("/")
    number = label_version(spark, base) if version is None else version
    if number == 0:
        return readers.empty_labels(spark)
    name = spark.read.text(f"{base}/versions/{number:012d}").first()["value"]
    return spark.read.parquet(f"{base}/{name}")


def export_labels(store: DataFrame, target: str) -> None:
    """The store as CSV in the exchange format, in row order."""
    named = store.orderBy("row_no").select(
        *[F.col(n).alias(h) for n, h in zip(readers.LABEL_NAMES, readers.LABEL_HEADER)]
    )
    named.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(target)


def write_reports(headers: DataFrame, results: DataFrame, target: str) -> None:
    """Reports as JSON lines: a line per experiment below ``headers``, a line per result below
    ``results``, in a folder per experiment.  Result lines follow one another in report order
    within and over the part files; ``evaluate.nested_report`` makes one document of both."""
    headers.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{target}/headers")
    (
        evaluate.listed(results)
        .write.mode("overwrite")
        .partitionBy("exp_name")
        .option("ignoreNullFields", "false")
        .json(f"{target}/results")
    )


def write_pretty(docs: DataFrame, target: str, column: str = "json") -> None:
    """Unwrapped documents as indented text, one row per file path."""
    docs.select("rel_path", D.pretty(D.unwrap(F.col(column))).alias("value")).write.mode("overwrite").parquet(target)


def prettify(docs: DataFrame, root: str) -> DataFrame:
    """Rewrite the documents (``rel_path``, ``json``) below ``root`` unwrapped and indented, in place.

    Running it again changes nothing.  Texts that are not JSON are left alone
    and returned.
    """
    inner = docs.withColumn("_inner", D.unwrap(F.col("json")))
    ready = inner.filter("_inner is not null").select("rel_path", D.pretty(F.col("_inner")).alias("value"))
    write_files(ready, root, "rel_path")
    return inner.filter("_inner is null").select("rel_path", F.lit("not json").alias("error"))
