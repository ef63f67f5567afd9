"""Expressions over JSON prompt documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clipsight.functions import let
from clipsight.functions.series import SAMPLE_TYPE

# Fields of a structured prompt document.
PROMPT_SCHEMA = """
subjects ARRAY<STRUCT<description:STRING, appearance_details:STRING, relationship:STRING, location:STRING,
  relative_size:STRING, orientation:STRING, pose:STRING, action:STRING, state_changes:STRING, clothing:STRING,
  expression:STRING, gender:STRING, age:STRING, skin_tone_and_texture:STRING, facial_features:STRING,
  number_of_subjects:INT, number_of_arms:INT, number_of_legs:INT>>,
background_setting STRING,
lighting STRUCT<conditions:STRING, direction:STRING, shadows:STRING, illumination_effect:STRING>,
aesthetics STRUCT<composition:STRING, color_scheme:STRING, mood_atmosphere:STRING, patterns:STRING>,
cinematography STRUCT<camera_motion:STRING, framing:STRING, camera_angle:STRING, depth_of_field:STRING,
  focus:STRING, lens_focal_length:STRING>,
style_medium STRING, artistic_style STRING, context STRING,
actions ARRAY<STRUCT<time:STRING, description:STRING>>,
text_and_signage_elements ARRAY<STRUCT<text:STRING, category:STRING, appearance:STRING,
  spatial_temporal:STRING, context:STRING>>,
segments ARRAY<STRUCT<segment_index:INT, time_range:STRING, description:STRING, key_changes:STRING, camera:STRING>>,
transitions ARRAY<STRING>, temporal_caption STRING, audio_description STRING,
resolution STRUCT<H:INT, W:INT>, aspect_ratio STRING, duration STRING, fps INT
"""


def is_json(text: Column) -> Column:
    """Strict JSON: a document with NaN, Infinity or a repeated key is not."""
    return F.try_parse_json(text).isNotNull()


def unwrap(text: Column) -> Column:
    """Inner document of ``{"prompt": "<json>"}``; other documents pass through.

    NULL when the text or the wrapped text is not JSON.  A ``prompt`` that is an
    object or a number is not a wrapper.
    """
    def pick(doc: Column) -> Column:
        wrapped = F.schema_of_variant(F.try_variant_get(doc, "$.prompt", "variant")) == "STRING"
        inside = F.try_variant_get(doc, "$.prompt", "string")
        return F.when(doc.isNull(), F.lit(None).cast("string")).when(
            F.coalesce(wrapped, F.lit(False)), let(inside, lambda x: F.when(is_json(x), x))
        ).otherwise(text)

    return let(F.try_parse_json(text), pick)


# A JSON string, in one run: nothing in it is tried twice.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def compact(text: Column) -> Column:
    """Same document without blanks and with non-ASCII escaped, key order kept; NULL if it is not JSON.

    Numbers, escapes that are there already and repeated keys stay as they are
    written.
    """
    tight = F.regexp_replace(text, rf"(?s)({STRING})|[\x20\t\n\r]++", "$1")

    def escaped(run: Column) -> Column:
        units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        return F.when(run.rlike(r"^[\x00-\x7E]"), run).otherwise(F.regexp_replace(units, "(....)", r"\\u$1"))

    edges = r"(?<=[\x00-\x7E])(?=[^\x00-\x7E])|(?<=[^\x00-\x7E])(?=[\x00-\x7E])"
    ascii_only = let(
        tight,
        lambda x: F.when(x.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(F.split(x, edges), escaped), "")).otherwise(x),
    )
    return F.when(is_json(text), ascii_only)


def _indented(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, indent=2) + "\n"
    except ValueError:
        return None


@F.pandas_udf(StringType())
def pretty(text: pd.Series) -> pd.Series:
    """Same document indented by two, non-ASCII kept, ending in a newline; NULL if it is not JSON."""
    return text.map(_indented)


def seconds_range(text: Column) -> Column:
    """``M:SS-M:SS`` as ``struct<start_s,end_s>``; NULL when malformed."""
    parts = F.transform(F.split(text, "[:-]"), lambda x: F.trim(x).try_cast("int"))
    span = F.transform(
        F.array(parts),
        lambda p: F.struct(
            (F.get(p, F.lit(0)) * 60 + F.get(p, F.lit(1))).alias("start_s"),
            (F.get(p, F.lit(2)) * 60 + F.get(p, F.lit(3))).alias("end_s"),
        ),
    )
    return F.when(text.rlike(r"^\s*\d+:\d\d-\d+:\d\d\s*$"), F.get(span, F.lit(0)))


def duration_seconds(text: Column) -> Column:
    """Leading number of ``5s``."""
    return F.regexp_extract(text, r"^\s*(\d+(\.\d+)?)\s*s?\s*$", 1).try_cast("double")


def clip_duration(duration: Column, frames: Column, avg_rate: Column, real_rate: Column) -> Column:
    """Container duration if positive, else frames over the ``num/den`` rate, else NULL."""
    direct = duration.try_cast("double")
    rate = F.when(F.coalesce(avg_rate, F.lit("")) != "", avg_rate).otherwise(real_rate)
    num = F.split(rate, "/").getItem(0).try_cast("double")
    den = F.try_element_at(F.split(rate, "/"), F.lit(2)).try_cast("double")
    fps = F.when(den == 0, F.lit(0.0)).otherwise(num / den)
    counted = F.when(fps > 0, frames.try_cast("double") / fps)
    return F.when(direct > 0, direct).otherwise(counted)


# Error classes of a stored trajectory.
MISSING, UNREADABLE, EMPTY, BAD_ROWS = "missing", "unreadable", "empty_or_invalid", "invalid_rows"


def trajectory(text: Column) -> Column:
    """``struct<series, error>`` of a stored ``[[v, h], ...]`` text.

    The first two items of each row count, numeric strings and NaN are accepted;
    exactly one of the two fields is set.
    """
    # JSON proper has no NaN or Infinity; quoting them makes such a text parseable.
    quoted = F.regexp_replace(text, r'(?<![\w"])(-?(?:NaN|Infinity))(?![\w"])', '"$1"')

    def number(x: Column) -> Column:
        return F.when(~x.rlike("[dDfF]\\s*$"), x).try_cast("double")

    def sample(row: Column) -> Column:
        return let(
            F.try_variant_get(row, "$", "array<string>"),
            lambda c: F.struct(number(F.get(c, F.lit(0))).alias("v"), number(F.get(c, F.lit(1))).alias("h")),
        )

    def result(series: Column | None, error: Column) -> Column:
        kept = F.lit(None).cast(SAMPLE_TYPE) if series is None else F.when(error.isNull(), series)
        return F.struct(kept.alias("series"), error.alias("error"))

    def check(series: Column) -> Column:
        sound = F.forall(series, lambda s: s["v"].isNotNull() & s["h"].isNotNull())
        error = F.when(F.size(series) < 1, F.lit(EMPTY)).when(~F.coalesce(sound, F.lit(False)), F.lit(BAD_ROWS))
        return result(series, error)

    def read(doc: Column) -> Column:
        is_list = F.startswith(F.schema_of_variant(doc), F.lit("ARRAY"))
        return (
            F.when(text.isNull(), result(None, F.lit(MISSING)))
            .when(doc.isNull(), result(None, F.lit(UNREADABLE)))
            .when(~is_list, result(None, F.lit(EMPTY)))
            .otherwise(let(F.transform(F.try_variant_get(doc, "$", "array<variant>"), sample), check))
        )

    return let(F.coalesce(F.try_parse_json(text), F.try_parse_json(quoted)), read)
