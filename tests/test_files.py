"""Readers, writers and the workflows on small files."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from clipsight.functions import series as S
from clipsight.operators import batch, catalog, checks, corpus, evaluate, kinematics, review
from clipsight.plans import workflows
from clipsight.sources import listing, readers, writers
from clipsight.sources.label_store import LabelStore
from clipsight.streaming import incremental


def put(root, rel, content=""):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "my data+x")


def test_catalogue(spark, root):
    for rel in ["a/clip 1.mp4", "a-b/c.mp4", "a/b/ü.mp4", "a/b/c.txt"]:
        put(root, rel, "x")
    got = [r.rel_path for r in catalog.in_order(readers.catalogue(spark, root)).collect()]
    assert got == ["a/b/ü.mp4", "a/clip 1.mp4", "a-b/c.mp4"]
    inside = readers.catalogue(spark, root, folder="a/b")
    assert [r.rel_path for r in inside.collect()] == ["a/b/ü.mp4"]


def test_no_file_is_left_out(spark, root):
    for rel in ["a/empty.mp4", "a/_z.mp4", "_old/b.mp4", ".hidden/c.mp4", "p%20q.mp4", "100%_q.mp4"]:
        put(root, rel)
    assert {r.rel_path for r in readers.catalogue(spark, root).collect()} == {
        "a/empty.mp4", "a/_z.mp4", "_old/b.mp4", ".hidden/c.mp4", "p%20q.mp4", "100%_q.mp4"}
    put(root, "prompt.txt", "Outer. It stops.")
    put(root, "set/prompt.txt")
    put(root, "set/prompt_0.txt")
    put(root, "t/clip_inverse_dynamics.txt")
    put(root, "j/prompt.json")
    clips = spark.createDataFrame([("set/prompt_0.mp4",), ("other/prompt_0.mp4",)], "rel_path string")
    lines = readers.prompt_lines(spark, root, "prompt.txt")
    told = {r.rel_path: r.sentence for r in catalog.with_prompt_sentence(clips, lines).collect()}
    assert told == {"set/prompt_0.mp4": None, "other/prompt_0.mp4": "It stops."}
    side = readers.sidecar_texts(spark, root, clips.filter("rel_path like 'set%'")).first()
    assert (side.action_text, side.error) == ("", None)
    assert readers.document_texts(spark, root).first().json == ""


def test_path_outside_the_root_is_an_error(spark):
    uri = spark.createDataFrame([("s3a://bucket/other/a.mp4",)], "uri string")
    with pytest.raises(Exception, match="not below"):
        uri.select(listing.relative(F.col("uri"), "s3a://bucket/clips")).collect()


def test_folders(spark):
    clips = spark.createDataFrame([("a/b/x.mp4",), ("a/y.mp4",), ("z.mp4",)], "rel_path string")
    assert {(r.folder, r.n_clips) for r in catalog.browsable_folders(clips).collect()} == {("a", 2), ("a/b", 1)}
    flat = clips.filter("rel_path = 'z.mp4'")
    assert [tuple(r) for r in catalog.browsable_folders(flat).collect()] == [(".", 1)]
    assert catalog.browsable_folders(clips.filter("false")).count() == 0
    assert catalog.in_folder(clips, "a").count() == 2 and catalog.in_folder(clips, ".").count() == 3
    with pytest.raises(Exception, match="leaves the root"):
        catalog.in_folder(clips, "a/../b").count()
    with pytest.raises(ValueError, match="no clips"):
        catalog.require_rows(catalog.in_folder(clips, "q"), "clips")


def test_nearest_prompt_file_against_walk(spark):
    names = ["updated_human_prompt.txt", "prompt.txt"]
    present = {("", "prompt.txt"), ("a", "prompt.txt"), ("a", "updated_human_prompt.txt"), ("a/b", "prompt.txt"),
               ("a/b_variants", "prompt.txt"), ("a/c", "updated_human_prompt.txt"), ("d", "other.txt")}
    folders = ["a/b", "a/b_variants", "a/b_variant/x", "a/c_variants", "a/c_variants/y", "d/e", "", "a/q_variants"]

    def walk(folder):
        parts = [p for p in folder.split("/") if p]
        while True:
            here = "/".join(parts)
            dirs = [here]
            for ending in ("_variants", "_variant"):
                if parts and parts[-1].endswith(ending):
                    dirs.append("/".join([*parts[:-1], parts[-1][: -len(ending)]]))
                    break
            for d in dirs:
                for n in names:
                    if (d, n) in present:
                        return d, n
            if not parts:
                return None
            parts.pop()

    dirs = spark.createDataFrame([(f,) for f in folders], "folder string")
    files = spark.createDataFrame(sorted(present), "dir string, filename string")
    got = {r.folder: (r.prompt_dir, r.prompt_file) for r in catalog.nearest_prompt_file(dirs, files).collect()}
    assert got == {f: walk(f) for f in folders}


def test_prompt_lines_and_sentence(spark, root):
    put(root, "set/prompt.txt", "One. The car stops. (note)\n\nThree. It drives on.\r\nFour")
    lines = readers.prompt_lines(spark, root)
    assert [(r.line_no, r.text) for r in lines.orderBy("line_no").collect()] == [
        (0, "One. The car stops. (note)"), (1, ""), (2, "Three. It drives on."), (3, "Four")]
    clips = spark.createDataFrame(
        [("set/x_variants/prompt_0_v02.mp4",), ("set/prompt_1.mp4",), ("set/prompt_2.mp4",), ("set/prompt_9.mp4",), ("set/odd.mp4",)],
        "rel_path string",
    )
    got = {r.rel_path: r.sentence for r in catalog.with_prompt_sentence(clips, lines).collect()}
    assert list(got.values()).count(None) == 2
    assert got["set/x_variants/prompt_0_v02.mp4"] == "The car stops." and got["set/prompt_1.mp4"] == ""
    assert got["set/prompt_2.mp4"] == "It drives on."
    intake = readers.prompt_intake(spark, f"{root}/set/prompt.txt")
    assert [(r["index"], r.prompt) for r in intake.orderBy("index").collect()][1] == (1, "Three. It drives on.")


def test_documents(spark, root):
    doc = {"subjects": [{"description": "a car", "number_of_subjects": 1}], "duration": "5s", "fps": 24, "transitions": [],
           "segments": [{"segment_index": 0, "time_range": "0:00-0:03"}, {"segment_index": 1, "time_range": "0:03-0:05"}],
           "resolution": {"H": 720, "W": 1280}}
    put(root, "p/prompt_0_v01.json", json.dumps(doc, indent=2))
    put(root, "p/bad.json", "{nope")
    docs = readers.documents(spark, root, "prompt*.json")
    row = docs.first()
    assert row.rel_path == "p/prompt_0_v01.json" and row.doc.fps == 24 and row.doc.resolution.W == 1280
    parts = corpus.parts(docs, "segments").orderBy("part_no").collect()
    assert [p.part.time_range for p in parts] == ["0:00-0:03", "0:03-0:05"]
    assert corpus.parts(docs, "text_and_signage_elements").first().part is None
    timed = docs.select("rel_path", F.col("doc.segments.time_range").alias("ranges"), "doc.duration")
    rules = corpus.segment_rules(timed, "rel_path").first()
    assert all([rules.readable, rules.last_long_enough, rules.contiguous, rules.fills_clip])
    raw = corpus.unwrapped(readers.document_texts(spark, root))
    assert {r.rel_path: r.error for r in raw.collect()} == {"p/prompt_0_v01.json": None, "p/bad.json": "not json"}
    writers.write_pretty(readers.document_texts(spark, root, "prompt*.json"), root + "/out")
    assert json.loads(spark.read.parquet(root + "/out").first().value) == doc


def test_prettify_in_place(spark, root):
    put(root, "a/wrapped.json", json.dumps({"prompt": json.dumps({"b": "é", "a": [1]})}))
    put(root, "a/bad.json", "{nope")
    for _ in range(2):
        left = writers.prettify(readers.document_texts(spark, root), root).collect()
        assert [r.rel_path for r in left] == ["a/bad.json"]
        with open(f"{root}/a/wrapped.json", encoding="utf-8") as f:
            assert f.read() == json.dumps({"b": "é", "a": [1]}, indent=2, ensure_ascii=False) + "\n"
    assert sorted(os.listdir(f"{root}/a")) == ["bad.json", "wrapped.json"]


def test_variation_matrix_and_overrides(spark, root):
    put(root, "plan.md", "# Plan\n\n| Row | Scene | Weather |\n|---|---|---|\n| v01 | Downtown | Rain |\n| v02 | Desert | Clear, dry |\n")
    matrix = readers.variation_matrix(spark, f"{root}/plan.md", ["scene", "weather"])
    base = spark.createDataFrame([(6,), (2,)], "prompt_idx int")
    pins = spark.createDataFrame([(6, "v02", "weather", "Night fog")], "prompt_idx int, row string, axis string, value string")
    got = {(r.prompt_idx, r.row): (r.scene, r.weather) for r in corpus.vary(base, matrix, ["scene", "weather"], pins).collect()}
    assert got == {(6, "v01"): ("Downtown", "Rain"), (6, "v02"): ("Desert", "Night fog"),
                   (2, "v01"): ("Downtown", "Rain"), (2, "v02"): ("Desert", "Clear, dry")}


def test_invariant_sweep(spark):
    base = {"subjects": [{"number_of_subjects": 1, "number_of_arms": 0, "number_of_legs": 4}], "fps": 24, "duration": "5s",
            "lighting": {"a": 1}, "segments": [1, 2]}
    broken = {**base, "fps": 25, "segments": [1], "lighting": {"b": 1}, "extra": 1}
    bases = spark.createDataFrame([(1, json.dumps(base))], "prompt_idx int, json string")
    variants = spark.createDataFrame(
        [("ok", 1, json.dumps(base)), ("bad", 1, json.dumps(broken)), ("lost", 2, json.dumps(base))],
        "file string, prompt_idx int, json string")
    rows = corpus.invariant_sweep(variants, bases).collect()
    failed = {(r.file, r.rule) for r in rows if not r.ok and r.file != "lost"}
    assert failed == {("bad", "fps"), ("bad", "n_segments"), ("bad", "lighting_keys"), ("bad", "keys")}
    rules = {r.rule for r in rows}
    assert len(rows) == 3 * len(rules) and not any(r.ok for r in rows if r.file == "lost" and r.rule == "fps")


@pytest.mark.parametrize("rule, change", [
    ("subject_identity", {"subjects": [{"description": "a cat", "number_of_subjects": 1, "pose": "low"}]}),
    ("subject_keys", {"subjects": [{"description": "a dog", "number_of_subjects": 1, "gait": "slow"}]}),
    ("segment_times", {"segments": [{"time_range": "0:00-0:04"}]}),
])
def test_single_invariants(spark, rule, change):
    base = {"subjects": [{"description": "a dog", "number_of_subjects": 1, "pose": "low"}], "segments": [{"time_range": "0:00-0:05"}]}
    bases = spark.createDataFrame([(1, json.dumps(base))], "prompt_idx int, json string")
    variants = spark.createDataFrame([("same", 1, json.dumps(base)), ("other", 1, json.dumps({**base, **change}))], "file string, prompt_idx int, json string")
    assert {(r.file, r.rule) for r in corpus.invariant_sweep(variants, bases).collect() if not r.ok} == {("other", rule)}


def test_trajectory_files(spark, root):
    put(root, "a/x.txt", "[[1, 2], [3, 4]]\n")
    put(root, "a/x_10fps.txt", "[[9, 9]]")
    put(root, "a/y.txt", "oops")
    clips = spark.createDataFrame([("a/x.mp4",), ("a/y.mp4",), ("a/z.mp4",)], "rel_path string")
    got = {r.rel_path: (r.error, None if r.series is None else len(r.series)) for r in
           readers.trajectories(spark, root, clips, "downsampled").collect()}
    assert got == {"a/x.mp4": (None, 2), "a/y.mp4": ("unreadable", None), "a/z.mp4": ("missing", None)}
    full = {r.rel_path: r.error for r in readers.trajectories(spark, root, clips, "full_fps").collect()}
    assert full == {"a/x.mp4": None, "a/y.mp4": "missing", "a/z.mp4": "missing"}
    side = {r.rel_path: (r.action_text, r.error) for r in readers.sidecar_texts(spark, root, clips).collect()}
    assert side["a/x.mp4"] == ("[[1, 2], [3, 4]]", None) and side["a/z.mp4"] == (None, "no action sequence")


def test_label_file_and_store(spark, root):
    put(root, "labels.csv", '"Video filepath relative to ""data/datasets/generated_vids""",Valid/Invalid,Extra,Comment\n'
                            'a.mp4,Valid,zz,"said ""no"", twice"\nb.mp4,NA,zz,\n')
    store = readers.labels(spark, f"{root}/labels.csv")
    assert [tuple(r)[1:] for r in store.orderBy("row_no").collect()] == [
        ("a.mp4", "Valid", "", 'said "no", twice'), ("b.mp4", "", "", "")]
    assert readers.labels(spark, f"{root}/none.csv").count() == 0
    folder = f"{root}/store"
    assert writers.current_labels(spark, folder).count() == 0
    writers.write_labels(store, folder)
    updates = spark.createDataFrame(
        [(1, "b.mp4", "Invalid", "OK", "x"), (2, "c.mp4", "Valid", "OK", ""), (3, "c.mp4", "Invalid", "OK", "again")],
        "seq long, rel_path string, label string, heuristic string, comment string")
    writers.write_labels(review.upsert_labels(writers.current_labels(spark, folder), updates), folder)
    rows = writers.current_labels(spark, folder).orderBy("row_no").collect()
    assert [(r.rel_path, r.label, r.comment) for r in rows] == [
        ("a.mp4", "Valid", 'said "no", twice'), ("b.mp4", "Invalid", "x"), ("c.mp4", "Invalid", "again")]
    writers.export_labels(writers.current_labels(spark, folder), f"{root}/export")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{root}/export")
    assert back.columns == readers.LABEL_HEADER and back.count() == 3


def test_labels_keep_their_order_over_part_files(spark, root):
    rows = [(i, f"p{i % 7}.mp4", f"l{i}", "OK", f"c\n{i}") for i in range(2000)]
    store = spark.createDataFrame(rows, "row_no long, rel_path string, label string, heuristic string, comment string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    writers.export_labels(store, f"{root}/export")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(f"{root}/export") if f.startswith("part-")]) >= 4
    assert sorted(tuple(r) for r in readers.labels(spark, f"{root}/export").collect()) == rows


def test_second_writer_of_a_version_is_refused(spark, root):
    store = spark.createDataFrame([(0, "a", "V", "OK", "")], "row_no long, rel_path string, label string, heuristic string, comment string")
    first = writers.write_labels(store, f"{root}/store")
    writers.write_labels(store, f"{root}/store", after=first)
    with pytest.raises(writers.StoreChanged):
        writers.write_labels(store.limit(0), f"{root}/store", after=first)
    assert writers.current_labels(spark, f"{root}/store").count() == 1 and writers.label_version(spark, f"{root}/store") == first + 1


def test_upsert_overwrites_duplicates_in_place(spark):
    store = spark.createDataFrame([(0, "a", "V", "OK", ""), (1, "b", "V", "OK", ""), (2, "a", "I", "OK", "n")],
                                  "row_no long, rel_path string, label string, heuristic string, comment string")
    update = spark.createDataFrame([(0, "a", "X", "FLAGGED", "")], "seq long, rel_path string, label string, heuristic string, comment string")
    rows = review.upsert_labels(store, update).orderBy("row_no").collect()
    assert [(r.row_no, r.rel_path, r.label) for r in rows] == [(0, "a", "X"), (1, "b", "V"), (2, "a", "X")]


def test_skip_list_and_log(spark, root):
    put(root, "skip.txt", "prompt_1_v01.mp4\n\n  prompt_2_v01.mp4 \nprompt_1_v01.mp4\n")
    skip = readers.skip_list(spark, f"{root}/skip.txt", "negative")
    assert {r.file_name for r in skip.collect()} == {"prompt_1_v01.mp4", "prompt_2_v01.mp4"}
    clips = spark.createDataFrame([(f"{d}/prompt_1_v01.mp4",) for d in
                                   ("negative_scenarios_variants", "positive_scenarios_variants", "x")], "rel_path string")
    assert catalog.keep_unskipped(clips, skip).count() == 2
    put(root, "flags.txt", "title\n\nFLAG  a.mp4: one\nFLAG  b.mp4: two\nFLAG  a.mp4: three\n")
    flags = {r.rel_path: r.detail for r in review.parse_flags(readers.log_lines(spark, f"{root}/flags.txt")).collect()}
    assert flags == {"a.mp4": "three", "b.mp4": "two"}
    assert readers.log_lines(spark, f"{root}/none.txt").count() == 0


def identity_steps(n, forward):
    """Straight ahead: identity rotation, ``forward`` along Z before scaling."""
    return [[0.0, 0.0, forward, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0] for _ in range(n)]


def test_motion_check_workflow(spark, root):
    import math

    clips = spark.createDataFrame([(f"s/prompt_{i}.mp4",) for i in range(6)], "rel_path string")
    a = math.radians(1.0)
    turning = [[0.0, 0.0, 0.5, math.cos(a), 0.0, -math.sin(a), 0.0, 1.0, 0.0] for _ in range(60)]
    outputs = {
        "s__prompt_0": identity_steps(60, 0.5),
        "s__prompt_1": [[0.0, 0.0, 0.5 * (1 - k / 60), 1, 0, 0, 0, 1, 0] for k in range(60)],
        "s__prompt_2": turning,
        "s__prompt_3": identity_steps(1, 0.5),
        "s__prompt_4": identity_steps(60, 0.5),
    }
    for name, action in outputs.items():
        put(root, f"{name}/sample_outputs.json", json.dumps({"outputs": [{"content": {"action": action}}], "x": 1}))
    lines = ["A. It maintains its speed.", "B. It comes to a stop.", "C. It steers.", "D. It maintains.", "E. It comes to a stop."]
    prompts = spark.createDataFrame([("s", "prompt.txt", i, t) for i, t in enumerate(lines)],
                                    "dir string, filename string, line_no int, text string")
    done = workflows.motion_check(clips, readers.actions(spark, root), prompts).cache()
    got = {r.rel_path: r for r in done.collect()}
    assert {k[9:10]: r.case for k, r in got.items()} == {
        "0": "matched", "1": "matched", "2": "matched", "3": "too_short", "4": "mismatched", "5": "no_prediction"}
    v = 0.5 * 1.35 * 10 * S.MPH_PER_MPS
    first = got["s/prompt_0.mp4"]
    assert first.series_10hz[7].v == pytest.approx(v, abs=1e-4) and first.start_v == pytest.approx(v, abs=1e-4)
    assert len(first.series_10hz) == 60 and len(first.series_5hz) == 30
    bent = got["s/prompt_2.mp4"].series_10hz
    assert abs(bent[59].h) == pytest.approx(59.0, abs=1e-3)
    assert got["s/prompt_4.mp4"].line.startswith("FLAG  s/prompt_4.mp4: expected=decelerate init_v=15.1")

    target = f"{root}/flags"
    writers.write_flag_report(done, target)
    logged = review.parse_flags(readers.log_lines(spark, target))
    assert {r.rel_path for r in logged.collect()} == {"s/prompt_3.mp4", "s/prompt_4.mp4", "s/prompt_5.mp4"}
    assert spark.read.text(f"{target}/section=0").first().value.endswith("(3 issue(s))")
    writers.write_flag_report(done.filter("status = 'MATCH'"), target)
    assert [r.value for r in spark.read.text(f"{target}/section=0").collect()][-1] == "(no flags)"

    writers.write_trajectories(done.filter("n >= 1"), f"{root}/series")
    stored = spark.read.parquet(f"{root}/series")
    assert {r.hz for r in stored.select("hz").distinct().collect()} == {10, 5}
    again = readers.trajectory_table(spark, f"{root}/series", clips, "full_fps").collect()
    assert {r.rel_path[9:10]: (r.error, r.series and len(r.series)) for r in again} == {
        **{str(i): (None, 60) for i in (0, 1, 2, 4)}, "3": ("missing", None), "5": ("missing", None)}
    writers.write_files(stored, f"{root}/mirror")
    files = readers.trajectories(spark, f"{root}/mirror", clips, "downsampled").filter("error is null").collect()
    assert sorted((r.rel_path, len(r.series)) for r in files) == [(f"s/prompt_{i}.mp4", 30) for i in (0, 1, 2, 4)]
    text = stored.filter("hz = 5 and rel_path = 's/prompt_0.mp4'").first()
    assert text.out_path == "s/prompt_0.txt" and len(json.loads(text.value)) == 30


def test_poses_conventions(spark):
    import math

    c, s = math.cos(0.5), math.sin(0.5)
    step = [0.0, 0.0, 1.0, c, 0.0, -s, 0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, [step, step]), (2, []), (3, None), (4, [[1.0]])], "id int, action array<array<double>>")
    local = {r.id: r.poses for r in kinematics.poses_from_actions(df, scale=2.0).collect()}
    assert [p.pz for p in local[1]] == pytest.approx([0, 2, 2 + 2 * c]) and len(local[2]) == 1
    assert local[3] is None and local[4] is None
    world = {r.id: r.poses for r in kinematics.poses_from_actions(df, scale=2.0, frame="world").collect()}
    assert [p.pz for p in world[1]] == pytest.approx([0, 2, 2 * c + 2])
    assert math.atan2(local[1][2].fx, local[1][2].fz) == pytest.approx(1.0)


def test_trim_in_rows(spark):
    series = [(float(i), 0.0) for i in range(10)]
    df = spark.createDataFrame([(series, d) for d in (0.35, 0.3, 0.0, -1.0, None, 1e-12)], f"s {S.SAMPLE_TYPE}, d double")
    got = [len(r.x) for r in df.select(S.trim_to(F.col("s"), S.d(10), F.col("d")).alias("x")).collect()]
    assert got == [4, 4, 10, 10, 10, 1]


@pytest.mark.parametrize("n, bounds", [(1, (0, 1, 0, 1)), (2, (0, 1, 1, 2)), (5, (0, 1, 4, 5)), (10, (0, 2, 8, 10)),
                                       (30, (2, 6, 24, 28)), (50, (2, 10, 40, 48)), (60, (3, 12, 48, 57))])
def test_window_bounds(spark, n, bounds):
    assert tuple(spark.range(1).select(S.window_bounds(F.lit(n).cast("long")).alias("b")).first().b) == bounds


def test_check_thresholds(spark):
    rows = [("decelerate", False, 1.0, 0.6, 0.0), ("decelerate", False, 1.0, 0.59, 0.0), ("accelerate", False, 1.0, 1.4, 0.0),
            ("accelerate", False, 1.0, 1.41, 0.0), ("maintain", False, 1.0, 0.6, 0.0), ("maintain", False, 1.0, 1.6, 0.0),
            ("maintain", False, 0.0, 0.0, 0.0), (None, True, 1.0, 1.0, 4.9), (None, True, 1.0, 1.0, 5.0), ("maintain", True, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "exp_speed string, exp_steer boolean, start_v double, end_v double, max_abs_h double")
    got = checks.check_motion(df).withColumn("why", checks.reasons()).collect()
    assert [r.motion_ok for r in got] == [False, True, False, True, True, True, False, False, True, False]
    assert got[-1].why == ["expected ~constant speed, end/start velocity=2.00", "expected steering, max|heading|=1.0deg"]


def test_enrich_retries_timeouts_and_errors(spark):
    import time

    def fn(value):
        if value == "slow":
            time.sleep(1.5)
        if value == "bad":
            raise ValueError("refused")
        return value.upper()

    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "bad", "slow"])], "i int, s string")
    got = {r.i: r for r in batch.enrich(df, "i", "s", fn, max_retries=2, base_delay_s=0.01, timeout_s=0.3).collect()}
    assert (got[0].output, got[0].error, got[0].tries) == ("A", None, 1)
    assert (got[1].output, got[1].error, got[1].tries) == (None, "refused", 3)
    assert got[2].output is None and got[2].error and got[2].elapsed_s < 5


def test_hanging_calls_do_not_starve_later_rows(spark):
    rows = spark.createDataFrame([(i, "slow" if i < 20 else "good") for i in range(24)], "i int, p string").coalesce(1).sortWithinPartitions("i")

    def fn(p):
        if p == "slow":
            time.sleep(60)
        return p

    got = {r.i: (r.output, r.error) for r in batch.enrich(rows, "i", "p", fn, timeout_s=0.1).collect()}
    assert [got[i][0] for i in range(20, 24)] == ["good"] * 4 and all(got[i][1] for i in range(20))


def test_evaluate_workflow_and_reports(spark, root):
    clips = spark.createDataFrame([(f"{k}_scenarios/c{i}.mp4",) for k in ("negative", "positive") for i in range(4)] + [("other/x.mp4",)],
                                  "rel_path string")
    sidecars = clips.filter("rel_path not like '%c3.mp4'").select("rel_path", F.col("rel_path").alias("action_text"))

    def model(prompt):
        if prompt.endswith("c2.mp4"):
            raise RuntimeError("down")
        return "Classification: " + ("Anomaly" if prompt.endswith(("negative_scenarios/c0.mp4", "positive_scenarios/c1.mp4")) else "Normal")

    answers = workflows.evaluate_model(clips, sidecars, model, exp_name="e1", mode="action_grounding").cache()
    m = evaluate.metrics(answers, "exp_name").first()
    assert (m.total_videos, m.tp, m.fp, m.tn, m.fn) == (8, 1, 1, 1, 1) and m.accuracy == 0.5
    counts = evaluate.class_counts(answers, "exp_name").first()
    assert (counts.n_anomaly, counts.n_normal, counts.n_unknown, counts.n_error) == (2, 2, 0, 4)
    experiments = spark.createDataFrame([("e1",)], "exp_name string").select(
        "exp_name", F.struct("exp_name").alias("experiment"), F.struct(F.lit("h").alias("hostname")).alias("environment"),
        F.struct("exp_name").alias("cli_args"), F.struct(F.lit(4).alias("fps")).alias("inference_params"))
    headers, rows = evaluate.report_headers(answers, experiments), evaluate.results(answers)
    writers.write_reports(headers, rows, f"{root}/reports")
    back, lines = readers.report_headers(spark, f"{root}/reports"), readers.report_results(spark, f"{root}/reports")
    assert lines.count() == 8 and lines.filter("correct is null").count() == 4
    head = back.first()
    assert (head.summary.Error, head.metrics.TP, head.environment, head.inference_params) == (4, 1, {"hostname": "h"}, {"fps": "4"})
    nested = evaluate.nested_report(headers, rows)
    nested.write.json(f"{root}/nested")
    again = evaluate.explode_results(readers.reports(spark, f"{root}/nested", "*.json")).orderBy("position")
    assert [r.file for r in again.collect()] == sorted((r.file for r in lines.collect()), key=lambda f: f.split("/"))
    none = evaluate.report_headers(answers.filter("is_error"), experiments).first()
    assert none.metrics is None and none.summary.total_videos == 4


def test_prepare_prompts(spark):
    prompts = spark.createDataFrame([(0, "fine"), (1, "refuse"), (2, "garbled")], "index int, prompt string")

    def fn(p):
        if p == "refuse":
            raise ValueError("no")
        return json.dumps({"prompt": json.dumps({"b": p, "a": "é"}) if p == "fine" else "{"})

    got = {r["index"]: (r.document, r.error) for r in workflows.prepare_prompts(prompts, fn).collect()}
    assert got == {0: ('{"b":"fine","a":"\\u00e9"}', None), 1: (None, "no"), 2: (None, "not json")}


def test_clips_with_duration(spark):
    clips = spark.createDataFrame([("a.mp4",), ("b.mp4",), ("c.mp4",)], "rel_path string")
    probes = spark.createDataFrame([("a.mp4", "5.04", None, None, None), ("b.mp4", None, "48", "24/1", None)],
                                   "rel_path string, duration string, nb_frames string, avg_frame_rate string, r_frame_rate string")
    got = {r.rel_path: r.duration_s for r in workflows.clips_with_duration(clips, probes).collect()}
    assert got == {"a.mp4": 5.04, "b.mp4": 2.0, "c.mp4": None}


def test_evaluate_and_report_calls_the_model_once(spark, root):
    calls = spark.sparkContext.accumulator(0)
    clips = spark.createDataFrame([(f"negative_scenarios/c{i}.mp4",) for i in range(5)], "rel_path string")
    experiments = spark.createDataFrame([("e",)], "exp_name string").select(
        "exp_name", F.struct("exp_name").alias("experiment"), F.struct(F.lit("h").alias("hostname")).alias("environment"),
        F.struct("exp_name").alias("cli_args"), F.struct(F.lit(4).alias("fps")).alias("inference_params"))

    def model(prompt):
        calls.add(1)
        return "Classification: Anomaly"

    m = workflows.evaluate_and_report(clips, None, model, experiments, root, exp_name="e").first()
    assert (m.tp, m.total_videos, calls.value) == (5, 5, 5)
    assert readers.report_results(spark, f"{root}/reports").count() == 5


def test_review_queue(spark):
    clips = spark.createDataFrame([(f"f/negative_scenarios_variants/prompt_0_v0{i}.mp4",) for i in range(4)], "rel_path string")
    skip = spark.createDataFrame([("negative", "prompt_0_v01.mp4"), ("negative", "prompt_0_v02.mp4")], "tree string, file_name string")
    prompts = spark.createDataFrame([("f", "prompt.txt", 0, "Hi. It stops.")], "dir string, filename string, line_no int, text string")
    flags = spark.createDataFrame([("f/negative_scenarios_variants/prompt_0_v03.mp4", "why")], "rel_path string, detail string")
    store = spark.createDataFrame([(0, "f/negative_scenarios_variants/prompt_0_v00.mp4", "Valid", "OK", "fine")],
                                  "row_no long, rel_path string, label string, heuristic string, comment string")
    q = workflows.review_queue(clips, prompts, flags, store, skip).orderBy("pos").collect()
    assert [(r.pos, r.n_in_folder, r.next_pos, r.prev_pos, r.landing_pos) for r in q] == [
        (0, 4, 3, None, 0), (1, 4, 3, 0, 3), (2, 4, 3, 0, 3), (3, 4, None, 0, 3)]
    assert [r.heuristic for r in q] == ["OK", "OK", "OK", "FLAGGED"] and q[0].label == "Valid" and q[3].sentence == "It stops."


def test_experiment_folder_and_jobs(spark):
    at = F.timestamp_seconds(F.lit(0))
    name = evaluate.experiment_folder(F.lit("exp"), F.lit(True), F.lit("reason1"), at)
    assert spark.range(1).select(name.alias("x")).first().x == "exp_action_reason1_19700101-000000"
    clips = spark.createDataFrame([("a/b.mp4",)], "rel_path string")
    job = json.loads(writers.job_lines(clips, "/d/").first().value)
    assert job["name"] == "a__b" and job["vision_path"] == "/d/a/b.mp4" and list(job)[0] == "action_chunk_size"
    assert {r.path_in_repo for r in writers.upload_manifest(clips, "/d").collect()} == {"a/b.txt", "a/b_10fps.txt"}
    done = spark.createDataFrame([("a__b",)], "name string")
    assert workflows.pending_jobs(clips, done).count() == 0


def test_streams(spark, root):
    inbox, store = f"{root}/inbox", f"{root}/labels"
    put(inbox, "1.json", '{"seq":1,"rel_path":"a","label":"Valid","heuristic":"OK","comment":""}\n')
    incremental.apply_label_updates(incremental.label_updates(spark, inbox), store, f"{root}/c1").awaitTermination()
    put(inbox, "2.json", '{"seq":2,"rel_path":"a","label":"Invalid","heuristic":"OK","comment":"x"}\n'
                         '{"seq":3,"rel_path":"b","label":"Valid","heuristic":"OK","comment":""}\n')
    incremental.apply_label_updates(incremental.label_updates(spark, inbox), store, f"{root}/c1").awaitTermination()
    rows = LabelStore(spark, store).current().orderBy("row_no").collect()
    assert [(r.rel_path, r.label) for r in rows] == [("a", "Invalid"), ("b", "Valid")]

    schema = "exp_name string, prediction string, pred_label int, true_label int, seconds double"
    answers = [("e", "Anomaly", 1, 1, 1.0), ("e", "Normal", 0, 1, 3.0)]
    for n, row in enumerate(answers):
        spark.createDataFrame([row], schema).write.mode("append").parquet(f"{root}/answers")
        stream = incremental.new_files(spark, f"{root}/answers", schema)
        incremental.running_metrics(stream, f"{root}/metrics", f"{root}/c2").awaitTermination()
        m = incremental.latest_metrics(spark, f"{root}/metrics").first()
        assert (m.tp, m.fn, m.total_videos) == (1, n, n + 1)
    assert m.avg_seconds == 2.0
    work = lambda df: df.select(F.upper("exp_name").alias("x"))
    for _ in range(2):
        stream = incremental.new_files(spark, f"{root}/answers", schema)
        incremental.process_pending(stream, work, f"{root}/done", f"{root}/c3").awaitTermination()
    assert spark.read.parquet(f"{root}/done").count() == 2
