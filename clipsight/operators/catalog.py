"""Clip catalogue: labels from paths, folders, pending work, prompt-file lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.functions import paths, text
from clipsight.operators.skew import lookup_join, positions

# Prompt file names, preferred one first.
PROMPT_FILES = ["updated_human_prompt.txt", "prompt.txt"]


def describe_paths(clips: DataFrame) -> DataFrame:
    """Add name parts, prompt index and label to a ``rel_path`` table."""
    rel = F.col("rel_path")
    clip_stem = paths.stem(rel)
    return clips.withColumns(
        {
            "folder": paths.parent(rel),
            "file_name": paths.file_name(rel),
            "stem": clip_stem,
            "run_name": paths.run_name(rel),
            "prompt_idx": text.prompt_index(clip_stem),
            "variant_no": text.variant_number(clip_stem),
            "true_label": paths.label_of_path(rel),
        }
    )


def labelled(clips: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """Keep clips whose path carries a label (anomaly 1 / normal 0)."""
    return clips.withColumn("true_label", paths.label_of_path(F.col(path_col))).filter("true_label is not null")


def in_folder(clips: DataFrame, folder: str) -> DataFrame:
    """Clips below ``folder``; a path that climbs out of the root is an error."""
    wanted = paths.folder_argument(F.lit(folder))
    checked = F.when(
        paths.escapes_root(wanted), F.raise_error(F.lit(f"folder leaves the root: {folder}")).cast("boolean")
    ).otherwise(paths.under(F.col("rel_path"), wanted))
    return clips.filter(checked)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop early when an input is empty."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def in_known_folder(clips: DataFrame, folder: str) -> DataFrame:
    """``in_folder``, and an error if no clip is below the folder."""
    return require_rows(in_folder(clips, folder), f"clips below {folder}")


def folder_order(clips: DataFrame) -> DataFrame:
    """``(folder, place)``: distinct folders, numbered from 0 in the order of their names."""
    return _numbered(clips.select(paths.parent(F.col("rel_path")).alias("folder")).distinct(), "folder")


def prompt_order(docs: DataFrame, key: str = "prompt_idx") -> DataFrame:
    """``(key, place)``: distinct base prompts in the order of their numbers, however they are written."""
    return _numbered(docs.select(F.col(key).cast("long").alias(key)).distinct(), key)


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    return positions(rows.withColumn("_all", F.lit(0)), ["_all"], [column], "place").drop("_all")


def run_name_collisions(clips: DataFrame) -> DataFrame:
    """Run names shared by several paths (``a/b.mp4`` and ``a__b.mp4``)."""
    return (
        clips.select(paths.run_name(F.col("rel_path")).alias("run_name"), "rel_path")
        .distinct()
        .groupBy("run_name")
        .agg(F.count(F.lit(1)).alias("n_paths"))
        .filter("n_paths > 1")
    )


def browsable_folders(clips: DataFrame) -> DataFrame:
    """Folders holding at least one clip at any depth, with clip counts.

    The root (``.``) is listed only when there is no other folder.  Counts are
    summed per directory first, so ancestors are exploded per directory, not per
    clip.
    """
    per_dir = clips.groupBy(paths.parent(F.col("rel_path")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    nested = (
        per_dir.select(F.explode(paths.ancestors(F.col("folder"))).alias("a"), "n")
        .select(F.col("a.dir").alias("folder"), "n")
        .filter("folder <> ''")
        .groupBy("folder")
        .agg(F.sum("n").cast("long").alias("n_clips"))
    )
    root_only = (
        per_dir.agg(F.sum("n").cast("long").alias("n_clips"), F.bool_or(F.col("folder") != "").alias("nested"))
        .filter("n_clips > 0 and not nested")
        .select(F.lit(".").alias("folder"), "n_clips")
    )
    return nested.unionByName(root_only)


def corpus_counts(clips: DataFrame) -> DataFrame:
    """Files per folder and base prompt, with subtotals (NULL = all)."""
    return describe_paths(clips).rollup("folder", "prompt_idx").agg(F.count(F.lit(1)).alias("n_files"))


def pending(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs that have no output yet.

    Outputs are reduced to distinct keys first, so a key that was written many
    times does not weigh on one task.
    """
    return lookup_join(inputs, outputs.select(key).distinct(), [key], "left_anti")


def mark_skipped(clips: DataFrame, skip: DataFrame) -> DataFrame:
    """Add ``skipped``: the file name is on the list of the tree the clip sits in.

    ``skip`` has (tree, file_name); negative variants are tested before positive.
    """
    listed = skip.select(
        F.col("tree").alias("_tree"), F.col("file_name").alias("_file"), F.lit(True).alias("_hit")
    ).distinct()
    rel = F.col("rel_path")
    keyed = clips.withColumns({"_tree": paths.skip_tree(rel), "_file": paths.file_name(rel)})
    return (
        lookup_join(keyed, listed, ["_tree", "_file"])
        .withColumn("skipped", F.coalesce("_hit", F.lit(False)))
        .drop("_tree", "_file", "_hit")
    )


def keep_unskipped(clips: DataFrame, skip: DataFrame) -> DataFrame:
    return mark_skipped(clips, skip).filter("not skipped").drop("skipped")


def nearest_prompt_file(dirs: DataFrame, prompt_files: DataFrame) -> DataFrame:
    """For each directory in ``dirs(folder)`` the closest prompt file above it.

    From the directory up to the root; at each level the directory itself and
    then, for a ``*_variants`` folder, its base sibling; in each of them the
    preferred file name first.  ``prompt_files`` has (dir, filename).  Works on
    distinct directories; the top candidate is a mergeable ``min_by``.
    """
    level = F.col("a.level")
    here = F.col("a.dir")
    base = F.concat(
        F.regexp_extract(here, r"^(.*/)?[^/]*$", 1), text.base_folder_name(paths.file_name(here))
    )
    tried = (
        dirs.select("folder")
        .distinct()
        .select("folder", F.explode(paths.ancestors(F.col("folder"))).alias("a"))
        .select(
            "folder",
            F.explode(
                F.when(
                    base != here,
                    F.array(
                        F.struct(here.alias("dir"), (level * 2).alias("step")),
                        F.struct(base.alias("dir"), (level * 2 + 1).alias("step")),
                    ),
                ).otherwise(F.array(F.struct(here.alias("dir"), (level * 2).alias("step"))))
            ).alias("c"),
        )
        .select("folder", "c.dir", "c.step")
    )
    choice = F.array_position(F.array(*map(F.lit, PROMPT_FILES)), F.col("filename"))
    files = prompt_files.filter(F.col("filename").isin(PROMPT_FILES)).select("dir", "filename", choice.alias("pick"))
    # The root directory is probed by every folder, so the files side is the lookup.
    hits = lookup_join(tried, files, ["dir"], "inner")
    best = F.min_by(F.struct("dir", "filename"), F.col("step") * 2 + F.col("pick"))
    return hits.groupBy("folder").agg(best.alias("p")).select(
        "folder", F.col("p.dir").alias("prompt_dir"), F.col("p.filename").alias("prompt_file")
    )


def with_prompt_sentence(clips: DataFrame, prompt_lines: DataFrame) -> DataFrame:
    """Add ``sentence``: last sentence of line N of the nearest prompt file, NULL if there is none.

    ``prompt_dir`` and ``prompt_file`` say where the line was found.

    ``clips`` has ``rel_path``; ``prompt_lines`` has (dir, filename, line_no, text).
    """
    rel = F.col("rel_path")
    keyed = clips.withColumns({"folder": paths.parent(rel), "prompt_idx": text.prompt_index(paths.stem(rel))})
    files = prompt_lines.select("dir", "filename").distinct()
    nearest = nearest_prompt_file(keyed, files)
    lines = prompt_lines.select(
        F.col("dir").alias("prompt_dir"),
        F.col("filename").alias("prompt_file"),
        F.col("line_no").cast("int").alias("prompt_idx"),
        text.last_sentence(F.col("text")).alias("sentence"),
        F.lit(True).alias("_line"),
    )
    # Folder first, then line: a file shared by many folders is never multiplied out.
    placed = lookup_join(keyed, nearest, ["folder"])
    told = lookup_join(placed, lines, ["prompt_dir", "prompt_file", "prompt_idx"])
    file = [F.when(F.col("_line"), F.col(c)).alias(c) for c in ("prompt_dir", "prompt_file")]
    return told.select(*keyed.columns, *file, "sentence")


def in_order(clips: DataFrame) -> DataFrame:
    """Path-component order, the order in which clips are listed."""
    return clips.orderBy(paths.components(F.col("rel_path")))


def allowed_prompts(docs: DataFrame, allowed: DataFrame, key: str = "prompt_idx") -> DataFrame:
    """Documents whose base prompt is on the allow list."""
    return lookup_join(docs, allowed.select(key).distinct(), [key], "left_semi")
