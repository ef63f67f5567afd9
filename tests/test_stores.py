"""The label store in deltas, state per path, journalled calls, running products and joins by time."""

import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsight.operators import batch, kinematics, review
from clipsight.operators.skew import asof_join
from clipsight.operators.trajectory import cursor_samples_at
from clipsight.sources.label_store import LabelStore
from clipsight.sources.writers import StoreChanged
from clipsight.streaming import keyed

LABELS = "rel_path string, label string, heuristic string, comment string"


def store_rows(df):
    return sorted(map(tuple, df.select("row_no", "rel_path", "label", "heuristic", "comment").collect()), key=repr)


def updates(spark, seed, n, first=0):
    r = random.Random(seed)
    rows = [(first + k, f"clip_{r.randrange(60)}", r.choice("VI"), "OK", r.choice(["", None, f"c{k}"])) for k in range(n)]
    return spark.createDataFrame(rows, f"seq long, {LABELS}")


def test_deltas_equal_repeated_upserts(spark, tmp_path):
    store = LabelStore(spark, str(tmp_path / "s"), buckets=8)
    base = spark.createDataFrame([(k, f"clip_{k % 25}", "V", "OK", "old") for k in range(40)], f"row_no long, {LABELS}")
    assert store.current().count() == 0
    store.replace(base)
    want = base
    for n in range(5):
        new = updates(spark, n, 12)
        store.update(new)
        want = spark.createDataFrame(review.upsert_labels(want, new).collect(), base.schema)
        if n == 2:
            assert store.compact(2)
        assert store_rows(store.current()) == store_rows(want)
    assert store.compact(1) and store_rows(store.current()) == store_rows(want) and store.compact(1) == []
    assert store_rows(LabelStore(spark, store.folder).current()) == store_rows(want)


def files_below(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_an_update_of_one_path_writes_one_bucket(spark, tmp_path):
    store = LabelStore(spark, str(tmp_path / "s"), buckets=32)
    store.replace(spark.createDataFrame([(k, f"clip_{k}", "V", "OK", "") for k in range(500)], f"row_no long, {LABELS}"))
    before, entries = files_below(store.folder), store.versions()
    written = store.update(spark.createDataFrame([(0, "clip_7", "I", "OK", "x")], f"seq long, {LABELS}"))
    new = files_below(store.folder) - before
    assert len(written) == len(new) == 1 and sum(map(os.path.getsize, new)) < 5000
    after = store.versions()
    assert [b for b in after if after[b] != entries[b]] == written and after[written[0]]["base"] == entries[written[0]]["base"]
    folded = store.compact(1)
    assert folded == written and [b for b, e in store.versions().items() if e["base"] != entries[b]["base"]] == written


def test_conflicts_are_found_per_bucket(spark, tmp_path):
    one, other = (LabelStore(spark, str(tmp_path / "s"), buckets=4) for _ in range(2))
    assert other.buckets == 4
    one.replace(spark.createDataFrame([(k, f"clip_{k}", "V", "OK", "") for k in range(40)], f"row_no long, {LABELS}"))
    stale = one.versions()
    change = spark.createDataFrame([(0, "clip_3", "I", "OK", "")], f"seq long, {LABELS}")
    written = one.update(change)
    other.versions = lambda: stale  # read before the other wrote
    with pytest.raises(StoreChanged):
        other.update(change)
    free = next(f"clip_{k}" for k in range(40) if spark.sql(f"select pmod(xxhash64('clip_{k}'), 4) b").first().b not in written)
    other.update(spark.createDataFrame([(0, free, "I", "OK", "")], f"seq long, {LABELS}"))
    assert {r.rel_path for r in one.current().filter("label = 'I'").collect()} == {"clip_3", free}


def test_empty_updates_and_null_paths(spark, tmp_path):
    store = LabelStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.update(updates(spark, 1, 0)) == [] and store.current().count() == 0
    store.update(updates(spark, 1, 9, first=5))
    rows = updates(spark, 1, 9, first=5)
    assert store_rows(store.current()) == store_rows(review.upsert_labels(spark.createDataFrame([], f"row_no long, {LABELS}"), rows))


def test_last_write_wins_over_restarts(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = f"seq long, {LABELS}, arrived timestamp"
    start = 1_700_000_000
    all_rows = []
    for lot in range(3):
        r = random.Random(lot)
        rows = [(100 * lot + k, f"clip_{r.randrange(12)}", r.choice("VI"), "OK", None if k % 3 else f"c{k}", start + 86_400 * lot + 10 * k) for k in range(40)]
        all_rows += rows
        end = [(10_000, "", "", "", "", start + 86_400 * lot + 40_000)]  # lets the time of the stream pass
        df = spark.createDataFrame(rows + end, f"seq long, {LABELS}, at long").withColumn("arrived", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        keyed.settle_labels(stream, target, checkpoint).awaitTermination()
    got = {r.rel_path: tuple(r) for r in keyed.settled_labels(spark, target).select("rel_path", "seq", "label", "heuristic", "comment").collect() if r.rel_path}
    want = {}
    for seq, path, label, heuristic, comment, _ in all_rows:
        want[path] = (path, seq, label, heuristic, comment)
    assert got == want
    # One row per path and burst of edits; superseded ones are counted, not written.
    written = spark.read.schema(keyed.SETTLED).parquet(target).filter("rel_path <> ''")
    assert written.count() == sum(len({r[1] for r in all_rows if r[0] // 100 == lot}) for lot in range(3))
    assert written.agg(F.sum("superseded")).first()[0] == len(all_rows) - written.count()


# ---------------------------------------------------------------- calls


def test_keys_pass_through_untouched(spark):
    rows = spark.createDataFrame([(9007199254740993, "a", None), (None, "b", 3), (1, None, 9007199254740995)], "i long, s string, n long")
    got = {tuple(r) for r in batch.enrich(rows.coalesce(1), "i", "s", lambda s: s.upper(), keep=["n"], absent="none").select("i", "n", "output", "error").collect()}
    assert got == {(9007199254740993, None, "A", None), (None, 3, "B", None), (1, 9007199254740995, None, "none")}


def test_journalled_answers_are_not_asked_again(spark, tmp_path):
    calls, crashed, journal = str(tmp_path / "calls"), str(tmp_path / "crashed"), str(tmp_path / "journal")
    os.makedirs(calls)

    def fn(value):
        if value == "p150" and not os.path.exists(crashed):
            open(crashed, "w").close()
            os._exit(1)  # the worker dies with its task, after answers of earlier rows
        open(f"{calls}/{value}-{time.time_ns()}", "w").close()
        if value.endswith("7"):
            raise ValueError("no")
        return value.upper()

    rows = spark.createDataFrame([(k, f"p{k}") for k in range(200)], "i long, s string")
    options = {"journal": journal, "partitions": 1, "concurrency": 3}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for _ in range(2):
            try:
                got = {r.i: (r.output, r.error) for r in batch.enrich(rows, "i", "s", fn, **options).collect()}
                break
            except Exception:  # noqa: BLE001 - a local master does not repeat the lost task by itself
                assert os.path.exists(crashed)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (None, "no") if k % 10 == 7 else (f"P{k}", None) for k in range(200)}
    asked = [x.split("-")[0] for x in os.listdir(calls)]
    journalled = [json.loads(x) for d, _, names in os.walk(journal) for f in names for x in open(os.path.join(d, f))]
    assert len(journalled) == 180 == len({x[0] for x in journalled})
    again = {r.i: (r.output, r.error) for r in batch.enrich(rows, "i", "s", fn, **options).collect()}
    assert again == got
    # Only what failed is asked again; a change of the input is a new question.
    assert len(os.listdir(calls)) - len(asked) == 20
    changed = rows.withColumn("s", F.concat("s", F.lit("x")))
    assert batch.enrich(changed, "i", "s", fn, **options).filter("output like 'P%X'").count() == 200


def test_waits_as_told_and_calls_side_by_side(spark):
    class Busy(RuntimeError):
        retry_after = 0.2

    def fn(value):
        time.sleep(0.2)
        if value == "busy":
            raise Busy("later")
        return value

    rows = spark.createDataFrame([(k, "busy" if k == 3 else "x") for k in range(16)], "i int, s string").coalesce(1)
    started = time.time()
    got = {r.i: r for r in batch.enrich(rows, "i", "s", fn, concurrency=16, max_retries=1, base_delay_s=60).collect()}
    assert time.time() - started < 20 and got[3].tries == 2 and 0.6 <= got[3].elapsed_s < 5 and got[0].output == "x"


# ---------------------------------------------------------------- running products


def steps_of(n, seed):
    return np.random.default_rng(seed).normal(size=(n, 9))


@pytest.mark.parametrize("frame", ["local", "world"])
@pytest.mark.parametrize("rows", [3, 4096])
def test_long_form_equals_fold(spark, frame, rows):
    clips = {"a": steps_of(1, 1), "b": steps_of(75, 2), None: steps_of(10, 3), "hot": steps_of(200, 4)}
    long = spark.createDataFrame([(c, k, s.tolist()) for c, x in clips.items() for k, s in enumerate(x)], "clip string, k int, action array<double>").repartition(5)
    got = {(r.clip, r.k): (r.px, r.pz, r.fx, r.fz) for r in kinematics.poses_from_steps(long, "clip", scale=0.5, frame=frame, block_rows=rows).collect()}
    for clip, x in clips.items():
        want = kinematics._fold_steps(x[None], 0.5, frame == "local")[0]
        have = np.array([got.pop((clip, k)) for k in range(len(want))])
        assert np.allclose(have, want, atol=1e-9)
    assert not got


def test_unknown_steps_leave_later_poses_unknown(spark):
    rows = [("a", k, None if k == 4 else [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for k in range(8)] + [("b", 0, [1.0, 2.0]), ("b", 1, [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "clip string, k int, action array<double>")
    got = {(r.clip, r.k): r.pz for r in kinematics.poses_from_steps(df, "clip", scale=1.0, block_rows=3).collect()}
    assert got == {**{("a", k): float(k) if k <= 4 else None for k in range(9)}, ("b", 0): 0.0, ("b", 1): None, ("b", 2): None}
    assert kinematics.poses_from_steps(df.limit(0), "clip").count() == 0


# ---------------------------------------------------------------- joins by time


def timed(seed, n, hot):
    r = random.Random(seed)
    return [("hot" if r.random() < hot else r.choice(["a", "b", "c", None]), None if r.random() < 0.03 else round(r.uniform(0, 50), 1), k) for k in range(n)]


@pytest.mark.parametrize("limit", [10**6, 20])
@pytest.mark.parametrize("clamp", [False, True])
def test_asof_equals_a_search(spark, limit, clamp):
    left, right = timed(1, 300, 0.5), timed(2, 250, 0.4) + [("z", 1.0, 999)]
    left += [("only", 3.0, 1000), ("z", 0.5, 1001), ("z", 1.0, 1002)]
    l, r = spark.createDataFrame(left, "key string, t double, id int"), spark.createDataFrame(right, "key string, t double, v int")
    got = {x.id: None if x.found is None else x.found.v for x in asof_join(l, r, "key", "t", ["v"], clamp=clamp, rows_per_task=limit).collect()}
    for key, t, i in left:
        usable = sorted((s, v) for k, s, v in right if k == key and s is not None) if key is not None and t is not None else []
        before = [v for s, v in usable if t is not None and s <= t]
        want = before[-1] if before else usable[0][1] if clamp and usable else None
        assert got[i] == want, (key, t)
    assert len(got) == len(left)


def test_cursors_on_irregular_times(spark):
    samples = spark.createDataFrame([("a", 1.0, 10), ("a", 1.5, 11), ("a", 9.0, 12), ("b", None, 1)], "clip string, t double, v int")
    cursors = spark.createDataFrame([("a", 0.0, 1), ("a", 1.49, 2), ("a", 1.5, 3), ("a", 99.0, 4), ("b", 1.0, 5), ("c", 1.0, 6)], "clip string, t double, n int")
    got = {r.n: (r.t, r.cursor_t, r.v) for r in cursor_samples_at(samples, cursors, "clip").collect()}
    assert got == {1: (0.0, 1.0, 10), 2: (1.49, 1.49, 10), 3: (1.5, 1.5, 11), 4: (99.0, 9.0, 12)}
