"""Expressions over posix-style relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipsight.functions import strip

# Folder-name fragments that carry the ground truth, and the two
# folders whose clips have skip lists.
NEGATIVE_MARK = "negative_scenario"
POSITIVE_MARK = "positive_scenario"
NEGATIVE_VARIANTS = "negative_scenarios_variants"
POSITIVE_VARIANTS = "positive_scenarios_variants"

# Sample rates of the two trajectory files, and the suffix of the
# native-rate one.
NATIVE_HZ = 10
TARGET_HZ = 5
FULL_RATE_MODE = "full_fps"
NATIVE_SUFFIX = "_10fps"


def normalise(path: Column) -> Column:
    """Trim blanks and turn backslashes into slashes."""
    return F.translate(strip(path), "\\", "/")


def folder_argument(path: Column) -> Column:
    """A user-typed folder without outer slashes, empty and ``.`` segments; empty means the root."""
    return F.array_join(F.filter(F.split(normalise(path), "/"), lambda p: ~p.isin("", ".")), "/")


def escapes_root(folder: Column) -> Column:
    return F.array_contains(F.split(folder, "/"), "..")


def under(rel_path: Column, folder: Column) -> Column:
    """True for paths inside ``folder`` (empty folder = everything)."""
    return (folder == "") | F.startswith(rel_path, F.concat(folder, F.lit("/")))


def components(path: Column) -> Column:
    """Sort key that orders paths by component, so ``a/b`` comes before ``a-b``."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory part; empty for a file at the root."""
    return F.left(path, F.greatest(F.length(path) - F.length(file_name(path)) - 1, F.lit(0)))


def drop_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def stem(path: Column) -> Column:
    return drop_suffix(file_name(path))


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(drop_suffix(path), F.lit(suffix))


def run_name(rel_path: Column) -> Column:
    """Flat job name: no suffix, slashes become double underscores."""
    return F.replace(drop_suffix(rel_path), F.lit("/"), F.lit("__"))


def trajectory_path(rel_path: Column, mode: Column) -> Column:
    """Sidecar name of the trajectory for the chosen rate."""
    return F.concat(
        drop_suffix(rel_path),
        F.when(mode == FULL_RATE_MODE, F.lit(f"{NATIVE_SUFFIX}.txt")).otherwise(F.lit(".txt")),
    )


def rate_of_mode(mode: Column) -> Column:
    return F.when(mode == FULL_RATE_MODE, F.lit(float(NATIVE_HZ))).otherwise(F.lit(float(TARGET_HZ)))


def label_of_path(path: Column) -> Column:
    """1 = anomaly, 0 = normal, NULL = unlabelled; the negative mark is tested first."""
    low = F.lower(path)
    return F.when(low.contains(NEGATIVE_MARK), F.lit(1)).when(low.contains(POSITIVE_MARK), F.lit(0))


def skip_tree(rel_path: Column) -> Column:
    """Which skip list a clip is subject to, by folder segment; NULL for none."""
    parts = components(rel_path)
    return F.when(F.array_contains(parts, NEGATIVE_VARIANTS), F.lit("negative")).when(
        F.array_contains(parts, POSITIVE_VARIANTS), F.lit("positive")
    )


def ancestors(folder: Column) -> Column:
    """Array of ``(level, dir)``: the folder itself (level 0) up to the root (empty dir)."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    depth = F.size(parts)
    return F.transform(
        F.sequence(F.lit(0), depth),
        lambda up: F.struct(
            up.alias("level"), F.array_join(F.slice(parts, F.lit(1), depth - up), "/").alias("dir")
        ),
    )
