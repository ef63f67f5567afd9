"""Compare a clip's motion with what its prompt sentence leads one to expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsight.functions import series as S
from clipsight.functions import paths, text

MATCH, FLAG, NOTE = "MATCH", "FLAG", "NOTE"
# Fixed value: name of a model output file.
OUTPUT_FILE = "sample_outputs.json"

# The log line of each case, the numbers in it, and the reasons of a mismatch.
LINES = {
    "no_prediction": "FLAG  %s: no prediction output (%s)",
    "too_short": "FLAG  %s: action too short to derive a sequence",
    "no_sentence": "NOTE  %s: no matching prompt sentence; %s",
    "unclassified": "NOTE  %s: unclassified prompt; %s :: \"%s\"",
    "matched": "MATCH %s: expected=%s %s",
    "mismatched": "FLAG  %s: expected=%s %s | %s :: \"%s\"",
}
NUMBERS = "init_v=%.1f start_v=%.1f end_v=%.1f max|heading|=%.1fdeg"
SPEED_REASONS = {
    "decelerate": "expected deceleration, end/start velocity=%.2f",
    "accelerate": "expected acceleration, end/start velocity=%.2f",
    "maintain": "expected ~constant speed, end/start velocity=%.2f",
}
STEER_REASON = "expected steering, max|heading|=%.1fdeg"


def with_expectation(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Add ``exp_speed`` (accelerate / decelerate / maintain / NULL) and ``exp_steer``."""
    s = F.col(sentence)
    return df.withColumns({"exp_speed": text.expected_speed(s), "exp_steer": text.expected_steer(s)})


def check_motion(df: DataFrame) -> DataFrame:
    """Add ``ratio``, ``speed_ok``, ``steer_ok`` and ``motion_ok`` to rows that have the
    expectation and ``start_v``, ``end_v``, ``max_abs_h``."""
    return (
        df.withColumn("ratio", S.end_start_ratio(F.col("start_v"), F.col("end_v")))
        .withColumns(
            {
                "speed_ok": S.speed_ok(F.col("exp_speed"), F.col("ratio")),
                "steer_ok": S.steer_ok(F.col("exp_steer"), F.col("max_abs_h")),
            }
        )
        .withColumn("motion_ok", F.col("speed_ok") & F.col("steer_ok"))
    )


def reasons() -> Column:
    """Array of texts saying what did not match (columns of ``check_motion``)."""
    def speed(kind: str) -> Column:
        missed = (F.col("exp_speed") == kind) & ~F.col("speed_ok")
        return F.when(missed, F.format_string(SPEED_REASONS[kind], F.round("ratio", 2)))

    steer = F.when(~F.col("steer_ok"), F.format_string(STEER_REASON, F.round("max_abs_h", 1)))
    return F.array_compact(F.array(*[speed(kind) for kind in SPEED_REASONS], steer))


def case_of() -> Column:
    """First applying case per clip, from ``has_prediction``, ``n``, ``sentence`` and the check columns."""
    return (
        F.when(~F.col("has_prediction"), F.lit("no_prediction"))
        .when(F.coalesce(F.col("n"), F.lit(0)) < 1, F.lit("too_short"))
        .when(F.col("sentence").isNull(), F.lit("no_sentence"))
        .when(F.col("exp_speed").isNull() & ~F.col("exp_steer"), F.lit("unclassified"))
        .when(F.col("motion_ok"), F.lit("matched"))
        .otherwise(F.lit("mismatched"))
    )


def assign_status(df: DataFrame) -> DataFrame:
    """Add ``case`` and ``status`` (MATCH / FLAG / NOTE)."""
    cased = df.withColumn("case", case_of())
    return cased.withColumn(
        "status",
        F.when(F.col("case") == "matched", F.lit(MATCH))
        .when(F.col("case").isin("no_sentence", "unclassified"), F.lit(NOTE))
        .otherwise(F.lit(FLAG)),
    )


def output_path(outputs_root: str = "") -> Column:
    """Where a clip's model output is expected: in a folder of its run name."""
    base = outputs_root.rstrip("/") + "/" if outputs_root else ""
    return F.concat(F.lit(base), paths.run_name(F.col("rel_path")), F.lit(f"/{OUTPUT_FILE}"))


def status_line(outputs_root: str = "") -> Column:
    """Log line of a clip: tag, path, and what is behind the status (numbers, or the missing output's path)."""
    numbers = F.format_string(NUMBERS, *[F.round(c, 1) for c in ("init_v", "start_v", "end_v", "max_abs_h")])
    wanted = F.concat(
        F.coalesce(F.col("exp_speed"), F.lit("-")), F.when(F.col("exp_steer"), F.lit("+steer")).otherwise(F.lit(""))
    )
    parts = {
        "no_prediction": [output_path(outputs_root)],
        "too_short": [],
        "no_sentence": [numbers],
        "unclassified": [numbers, F.col("sentence")],
        "matched": [wanted, numbers],
        "mismatched": [wanted, numbers, F.array_join(reasons(), "; "), F.col("sentence")],
    }
    lines = [
        F.when(F.col("case") == case, F.format_string(LINES[case], F.col("rel_path"), *rest))
        for case, rest in parts.items()
    ]
    return F.coalesce(*lines)


def status_tally(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
