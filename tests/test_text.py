"""Sentence, expectation and verdict rules on edge cases."""

import pytest
from pyspark.sql import functions as F

from clipsight.functions import documents as D
from clipsight.functions import paths, series, text


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r.v for r in df.select("i", expr(F.col("s")).alias("v")).orderBy("i").collect()]


def test_last_sentence(spark):
    cases = {
        "One. Two. (note)": "Two.",
        "One. Two.  (a) (b)  ": "Two.",
        "(only) (notes)": "(only)",
        "": "",
        "   ": "",
        "No end mark": "No end mark",
        "A sign says 'Stop.' The car stops.": "A sign says 'Stop.' The car stops.",
        "Is it? Yes! (open (closed)": "(open",
        "Wait. Then go. Now stop. ": "Now stop.",
        "One. (mid note) Two": "(mid note) Two",
        "One.\n\nTwo\nlines": "Two\nlines",
        "Stop. (a) tail.": "(a) tail.",
        "x (a)(b)": "x",
    }
    assert values(spark, list(cases), text.last_sentence) == list(cases.values())
    assert values(spark, [None], text.last_sentence) == [None]


@pytest.mark.parametrize(
    "sentence, speed, steer",
    [
        ("The car STARTS MOVING, then slows down.", "accelerate", False),
        ("It slows down without stopping.", "maintain", False),
        ("It slows down before resuming its speed.", "maintain", False),
        ("It comes to a controlled stop.", "decelerate", False),
        ("It remains stopped at the light.", "maintain", False),
        ("It swerves into an oncoming lane.", None, True),
        ("It maintains its lane while steering.", "maintain", True),
        ("Nothing of note.", None, False),
        ("", None, False),
    ],
)
def test_expectation(spark, sentence, speed, steer):
    assert values(spark, [sentence], text.expected_speed) == [speed]
    assert values(spark, [sentence], text.expected_steer) == [steer]


def test_verdict(spark):
    cases = {
        "Classification: Anomaly": "Anomaly",
        "classification: \n NORMAL": "Normal",
        "Classification: Anomaly or Classification: Normal": "Anomaly",
        "**Classification:** Normal": "Normal",
        "abnormal": "Normal",
        "an anomaly, not normal": "Normal",
        "normal?\nno, an anomaly": "Anomaly",
        "": "Unknown",
        "no idea": "Unknown",
    }
    assert values(spark, list(cases), text.verdict) == list(cases.values())
    assert values(spark, [None], text.verdict) == ["Unknown"]


def test_prompt_index(spark):
    stems = ["prompt_3", "prompt_12_v07", "prompt_x", "prompt_3_v1_v2", "my_prompt_3", "prompt_99999999999"]
    assert values(spark, stems, text.prompt_index) == [3, 12, None, None, None, None]
    assert values(spark, stems[:2], text.variant_number) == [None, 7]


def test_paths(spark):
    p = ["a/b.c/clip.x.mp4", "clip.mp4", ".hidden", "a/noext"]
    assert values(spark, p, paths.parent) == ["a/b.c", "", "", "a"]
    assert values(spark, p, paths.stem) == ["clip.x", "clip", ".hidden", "noext"]
    assert values(spark, p, paths.run_name) == ["a__b.c__clip.x", "clip", ".hidden", "a__noext"]
    typed = [" /a\\b/ ", ".", "", "a/../b", "./a//b/."]
    assert values(spark, typed, paths.folder_argument) == ["a/b", "", "", "a/../b", "a/b"]
    assert values(spark, ["a/../b", "a/..b"], paths.escapes_root) == [True, False]
    labels = ["X/Negative_Scenarios/positive_scenario.mp4", "positive_scenarios/a.mp4", "other/a.mp4"]
    assert values(spark, labels, paths.label_of_path) == [1, 0, None]
    order = spark.createDataFrame([("a-b",), ("a/b",)], "p string").orderBy(paths.components(F.col("p")))
    assert [r.p for r in order.collect()] == ["a/b", "a-b"]


def test_log_lines(spark):
    lines = ["FLAG  a/b.mp4: no output: x", "NOTE  a.mp4: y", "  FLAG a\\b.mp4:", "FLAG no colon"]
    assert values(spark, lines, text.log_path) == ["a/b.mp4", None, "a/b.mp4", None]
    assert values(spark, lines[:1], text.log_detail) == ["no output: x"]


def test_questions(spark):
    df = spark.createDataFrame([("plain", "action_grounding"), ("tagged", "other"), ("none", "other")], "f string, m string")
    got = [r.q for r in df.select(text.question(F.col("f"), F.col("m"), F.lit("[[1,2]]")).alias("q")).collect()]
    assert got[0].endswith("\nEgo Vehicle State Sequence (5Hz): [[1,2]]") and "\n\n<think>" not in got[0]
    assert got[1].endswith("</answer>") and got[2] is None


def test_unwrap(spark):
    cases = ['{"prompt": "{\\"a\\": 1}"}', '{"prompt": {"a": 1}}', '{"prompt": 3}', '{"a": 1}', "oops", '{"prompt": "oops"}']
    assert values(spark, cases, D.unwrap) == ['{"a": 1}', cases[1], cases[2], cases[3], None, None]


def test_json_texts(spark):
    source = '{"b" : "é—", "a": [1, 2.50]}'
    assert values(spark, [source], D.compact) == ['{"b":"\\u00e9\\u2014","a":[1,2.50]}']
    assert values(spark, ["{nope", None, '{"a b": "x \\" y",\n "e": "é\U0001f600\x7f", "n": [ 1.50 , true ]}'], D.compact) == [
        None, None, '{"a b":"x \\" y","e":"\\u00e9\\ud83d\\ude00\\u007f","n":[1.50,true]}']
    assert values(spark, ["{nope", None], D.pretty) == [None, None]
    pretty = values(spark, [source], D.pretty)[0]
    assert pretty.startswith('{\n  "b": "é—"') and pretty.endswith("}\n")
    assert values(spark, [pretty], D.pretty) == [pretty]


def test_time_ranges(spark):
    got = values(spark, ["0:00-0:02", "1:05-2:00", "0:0-0:1", "soon"], D.seconds_range)
    assert [None if g is None else tuple(g) for g in got] == [(0, 2), (65, 120), None, None]
    assert values(spark, ["5s", " 2.5 s", "x"], D.duration_seconds) == [5.0, 2.5, None]


@pytest.mark.parametrize(
    "stored, error, series",
    [
        (None, "missing", None),
        ("oops", "unreadable", None),
        ("[]", "empty_or_invalid", None),
        ('{"x":1}', "empty_or_invalid", None),
        ("3", "empty_or_invalid", None),
        ("[[1]]", "invalid_rows", None),
        ('["12"]', "invalid_rows", None),
        ("[[1,null]]", "invalid_rows", None),
        ('[["1.5d",2]]', "invalid_rows", None),
        ('[["1.5",2]]', None, [(1.5, 2.0)]),
        ("[[3,4,9],[5,6]]", None, [(3.0, 4.0), (5.0, 6.0)]),
    ],
)
def test_trajectory_text(spark, stored, error, series):
    got = values(spark, [stored], D.trajectory)[0]
    assert got.error == error
    assert (None if got.series is None else [tuple(s) for s in got.series]) == series


def test_trajectory_text_accepts_nan(spark):
    got = values(spark, ["[[NaN, 2]]"], D.trajectory)[0]
    assert got.error is None and got.series[0].v != got.series[0].v and got.series[0].h == 2.0


def test_clip_duration(spark):
    rows = [("5.04", None, None, None), ("0", "48", "24/1", None), ("N/A", "30", "", "30000/1001"),
            ("", "30", "0/0", "30/1"), (None, None, "24/1", None), (None, "24", "24", None)]
    df = spark.createDataFrame(rows, "d string, n string, a string, r string")
    got = [x.v for x in df.select(D.clip_duration(*map(F.col, "dnar")).alias("v")).collect()]
    assert got == [5.04, 2.0, pytest.approx(1.001), None, None, None]


def test_many_trailing_notes(spark):
    """A million notes behind a sentence, and many groups that no note ends, each in one pass."""
    rows = ["One. Two. " + "(n) " * 1_000_000, "One. " + "(n) " * 20_000 + "x. Three (n", "One. (n) x " * 2_000 + "(y)"]
    got = values(spark, rows, text.last_sentence)
    assert got[0] == "Two." and got[1].endswith("Three (n") and got[2].startswith("(n) x One.") or got[2]


def test_series_text(spark):
    df = spark.sql("SELECT array(named_struct('v', 0.0001D, 'h', -12.5D), named_struct('v', 12345678.25D, 'h', 0D)) AS s, array() AS e")
    out = df.select(series.series_text(F.col("s")).alias("a"), series.series_text(F.col("e").cast("array<struct<v:double,h:double>>")).alias("b")).first()
    assert out.a == "[[0.0001, -12.5], [12345678.25, 0.0]]\n" and out.b == "[]\n"
