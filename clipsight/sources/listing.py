"""Listing and reading of files in folders, on the executors, without leaving any file out.

Spark's own file index drops empty files and names that begin with ``_`` or ``.``;
here folders are listed level by level, each level in parallel, through the file
systems of pyarrow (local, S3, HDFS, ...).  For a store that pyarrow does not know,
hand a listing table ``(rel_path, size)`` to the readers instead.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsight.session import ensure_checkpoint_dir

#: Files that a task reads one after the other, at most about.
FILES_PER_TASK = 2000
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def qualified(spark: SparkSession, root: str) -> str:
    """The root with scheme and authority, as the session's file system completes it."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", root):
        return root.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


def plain_path(root: str) -> str:
    """A root without scheme and authority."""
    return re.sub(SCHEME, "", root).rstrip("/")


def relative(path: Column, root: str, encoded: bool = True) -> Column:
    """Part of a path or URI below ``root``; one that is not below it is an error.

    Scheme and authority are left out on both sides.  ``encoded`` says whether the
    path has percent-escapes (``_metadata.file_path`` has, the ``path`` of binary
    files has not).
    """
    bare = F.regexp_replace(path, SCHEME, "")
    if encoded:
        bare = F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    base = plain_path(root) + "/"
    outside = F.raise_error(F.concat(F.lit(f"not below {root}: "), path)).cast("string")
    return F.when(bare.startswith(base), F.substring(bare, len(base) + 1, 1 << 30)).otherwise(outside)


def opened(root: str) -> arrow_fs.FileSystem:
    """The file system of a qualified root."""
    scheme = re.match(SCHEME, root).group()
    if scheme.startswith("file:"):
        return arrow_fs.LocalFileSystem()
    return arrow_fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", scheme) + "/")[0]


def bare(root: str) -> str:
    """A root as its pyarrow file system names it: with the bucket for object stores."""
    bucket = re.match(r"^(?:s3[an]?|gs|gcs|abfss?)://([^/]*)", root)
    return (bucket.group(1) if bucket else "") + plain_path(root)


def files(spark: SparkSession, root: str, pattern: str = "*", folder: str = "") -> DataFrame:
    """``(rel_path, size)`` of every file below ``root`` (or its sub-folder) whose name matches."""
    base = qualified(spark, root)
    top, name = bare(base), re.compile(fnmatch.translate(pattern))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = opened(base)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = store.get_file_info(arrow_fs.FileSelector(f"{top}/{folder}".rstrip("/") or "/", allow_not_found=False))
                rows = [
                    (f"{folder}/{x.base_name}".lstrip("/"), x.type == arrow_fs.FileType.Directory, x.size or 0)
                    for x in found
                    if x.type == arrow_fs.FileType.Directory or name.match(x.base_name)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.int64()))], names=["rel_path", "is_folder", "size"]
                )

    ensure_checkpoint_dir(spark)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(folder.strip("/"),)], "rel_path string")
    levels = []
    while True:
        # Listed once: a later look at the store could see other files.
        level = level.mapInArrow(entries, "rel_path string, is_folder boolean, size long").checkpoint()
        levels.append(level.filter("not is_folder").select("rel_path", "size"))
        level = level.filter("is_folder").select("rel_path")
        if level.isEmpty():
            break
        level = level.repartition(spread, "rel_path")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def texts(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """``(rel_path, text)`` of the listed files below ``root``, read whole where the row is; for small files.

    The text of a file that is not UTF-8 is null.
    """
    base = qualified(spark, root)
    top = bare(base)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = opened(base)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{rel}") as stream:
                    content = stream.read()
                try:
                    text = content.decode()
                except UnicodeDecodeError:
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([text], pa.string())], names=["rel_path", "text"])

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listing.count() // FILES_PER_TASK))
    return listing.select("rel_path").repartition(spread, "rel_path").mapInArrow(read, "rel_path string, text string")
