"""Expressions that read meaning out of prompt lines and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipsight.functions import let, paths, strip

# Phrases that decide what a sentence expects the vehicle to do.
# Tested as substrings of the lower-cased sentence.
STEER = ["steer", "maneuver", "manoeuvr", "navigat", "oncoming lane", "into an oncoming",
         "jagged", "swerv", "changes lane"]
ACCELERATE = ["starts moving", "starts to move", "begins to move", "begins to drive",
              "accelerat", "starts driving"]
KEEPS_GOING = ["no deceleration", "without stopping", "without slowing", "runs into",
               "fails to detect", "driving through", "continues to drive", "drive forward"]
RESUMES = ["resuming", "nominal speed"]
DECELERATE = ["decelerat", "comes to a stop", "to a stop", "slows down", "slow down",
              "controlled stop", "complete stop", "compliant stop"]
MAINTAIN = ["maintains", "normal speed", "cruising", "continues driving", "drives past",
            "smoothly past", "remains safely stopped", "remains stopped", "lane position"]

# The questions put to the model, by prompt family and mode.
ACTION_MODE = "action_grounding"
STATE_PREFIX = "\nEgo Vehicle State Sequence (5Hz): "
PLAIN_WITH_ACTION = """You are an autonomous driving safety expert analyzing this ego vehicle's video \
for semantic or contextual anomalies, that may impact safe AV operation. The ego vehicle's action \
(state sequence) given afterwards is in the format [[velocity_in_mph, heading_in_degrees], ...]. \
Think about the video and the ego vehicle's action, is there any semantic misunderstanding of the \
autopilot that requires intervention? Reply with exactly one word of the following:
Classification: Anomaly — if there is a semantic anomaly
Classification: Normal — if there is no semantic anomaly."""
PLAIN_WITHOUT_ACTION = """You are an autonomous driving safety expert analyzing this ego vehicle's video \
for semantic or contextual anomalies, that may impact safe AV operation. Think about the video, is \
there any semantic misunderstanding of the autopilot that requires intervention? Reply with exactly \
one word of the following:
Classification: Anomaly — if there is a semantic anomaly
Classification: Normal — if there is no semantic anomaly."""
TAGGED_WITH_ACTION = """You are an autonomous driving safety expert analyzing this ego vehicle's video \
for semantic or contextual anomalies, that may impact safe AV operation. The ego vehicle's action \
(state sequence) given afterwards is in the format [[velocity_in_mph, heading_in_degrees], ...].

<think>
Think about the video scenario and the ego vehicle's action.
</think>

<answer>
Is there any semantic misunderstanding of the autopilot that requires intervention? Reply with \
exactly one word of the following:
Classification: Anomaly — if there is a semantic anomaly
Classification: Normal — if there is no semantic anomaly.
</answer>"""
TAGGED_WITHOUT_ACTION = """You are an autonomous driving safety expert analyzing this ego vehicle's video \
for semantic or contextual anomalies, that may impact safe AV operation.

<think>
Think about the video scenario.
</think>

<answer>
Is there any semantic misunderstanding of the autopilot that requires intervention? Reply with \
exactly one word of the following:
Classification: Anomaly — if there is a semantic anomaly
Classification: Normal — if there is no semantic anomaly.
</answer>"""
# family -> (with the action series, without it)
BASE_PROMPTS = {
    "plain": (PLAIN_WITH_ACTION, PLAIN_WITHOUT_ACTION),
    "tagged": (TAGGED_WITH_ACTION, TAGGED_WITHOUT_ACTION),
}


WS = r"[\s\x1c-\x1f]"


def last_sentence(text: Column) -> Column:
    """Last sentence once trailing ``(...)`` notes are dropped.

    A text made only of notes keeps its first one.  A sentence ends at ``.!?``
    directly followed by white space, so a closing quote in between joins two.
    The greedy prefix finds the last such end from the back of the text, so long
    texts are not split into all their sentences.
    """
    def without_notes(bare: Column) -> Column:
        return F.when(
            bare.endswith(")"),
            let(
                F.regexp_replace(bare, rf"(?U)(?:{WS}*+\([^()]*+\))++\z", ""),
                lambda cut: F.when(cut == "", F.regexp_extract(bare, r"^(\([^()]*\))", 1)).otherwise(cut),
            ),
        ).otherwise(bare)

    return F.regexp_replace(let(strip(text), without_notes), rf"(?Us)^.*[.!?]{WS}+(?=.)", "")


def _mentions(low: Column, phrases: list[str]) -> Column:
    """Plain substring tests: a byte search each, far cheaper than one regex alternation."""
    hit = low.contains(phrases[0])
    for phrase in phrases[1:]:
        hit = hit | low.contains(phrase)
    return hit


def expected_speed(sentence: Column) -> Column:
    """accelerate / maintain / decelerate / NULL, in that order of precedence."""
    low = F.lower(sentence)
    return (
        F.when(_mentions(low, ACCELERATE), F.lit("accelerate"))
        .when(_mentions(low, KEEPS_GOING + RESUMES), F.lit("maintain"))
        .when(_mentions(low, DECELERATE), F.lit("decelerate"))
        .when(_mentions(low, MAINTAIN), F.lit("maintain"))
    )


def expected_steer(sentence: Column) -> Column:
    return F.coalesce(_mentions(F.lower(sentence), STEER), F.lit(False))


def verdict(raw: Column) -> Column:
    """Anomaly / Normal / Unknown: the first explicit verdict line, else the last mention."""
    low = F.lower(raw)
    explicit = F.regexp_extract(low, r"(?U)classification:\s*(anomaly|normal)", 1)
    mention = F.regexp_extract(low, r"(?s)^.*(anomaly|normal)", 1)
    word = F.when(explicit != "", explicit).otherwise(mention)
    return (
        F.when(word == "anomaly", F.lit("Anomaly"))
        .when(word == "normal", F.lit("Normal"))
        .otherwise(F.lit("Unknown"))
    )


def prompt_index(stem: Column) -> Column:
    """N of ``prompt_N`` / ``prompt_N_vNN``; NULL for other names."""
    digits = F.regexp_extract(stem, r"^prompt_(\d+?)(_v\d+)?$", 1)
    return F.when(digits != "", digits).try_cast("int")


def variant_number(stem: Column) -> Column:
    digits = F.regexp_extract(stem, r"_v(\d+)$", 1)
    return F.when(digits != "", digits).try_cast("int")


def base_folder_name(name: Column) -> Column:
    """Folder whose prompt file a variants folder shares."""
    return F.regexp_replace(name, r"_variants?$", "")


def question(family: Column, mode: Column, series_text: Column) -> Column:
    """Full model prompt; the state series is appended in the action-grounded mode."""
    def base(which: int) -> Column:
        pairs = [F.lit(v) for name, texts in BASE_PROMPTS.items() for v in (name, texts[which])]
        return F.try_element_at(F.create_map(*pairs), family)

    return F.when(mode == ACTION_MODE, F.concat(base(0), F.lit(STATE_PREFIX), series_text)).otherwise(base(1))


def log_path(line: Column) -> Column:
    """Clip path of a ``FLAG  path: rest`` line (up to the first colon); NULL for other lines."""
    hit = F.regexp_extract(strip(line), r"^FLAG\s+(.+?):(\s*.*)$", 1)
    return F.when(hit != "", paths.normalise(hit))


def log_detail(line: Column) -> Column:
    return strip(F.regexp_extract(strip(line), r"^FLAG\s+(.+?):(\s*.*)$", 2))
