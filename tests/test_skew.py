"""Joins and ordered scans give the same rows when a key is cut into pieces."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clipsight.operators import kinematics, review, trajectory
from clipsight.operators.skew import lookup_join, positions

SMALL = 16


def heavy(spark, rows=600):
    """A third of the rows under one key, the rest spread; some without a key."""
    rng = random.Random(7)
    data = []
    for n in range(rows):
        key = "hot" if n % 3 == 0 else (None if n % 29 == 0 else f"k{rng.randrange(40)}")
        data.append((key, n, rng.random()))
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, n int, x double")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_is_lazy_and_keeps_rows_without_a_key(spark, how):
    facts = heavy(spark)
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 3), ("k5", 4)], "key string, y int")
    plain = facts.join(lookup, ["key"], how)
    spark.sparkContext.setJobGroup("lookup", "joins decide nothing beforehand")
    joined = lookup_join(facts, lookup, ["key"], how)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert joined.columns == plain.columns
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))


def test_positions_cut_equals_plain(spark):
    rows = heavy(spark).filter("key is not null")
    plain = positions(rows, ["key"], ["n"], "pos", "total")
    cut = positions(rows, ["key"], ["n"], "pos", "total", rows_per_task=SMALL)
    key = lambda r: (r["key"], r["n"])
    assert sorted(plain.collect(), key=key) == sorted(cut.select(*plain.columns).collect(), key=key)


def test_positions_of_texts(spark):
    rows = spark.createDataFrame([("f", f"f/{c}{n:03d}") for c in "ab-" for n in range(50)], "folder string, p string")
    got = positions(rows, ["folder"], [F.split("p", "/")], rows_per_task=8).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(150))
    assert [r.p for r in got] == sorted(r.p for r in got)


def poses(spark, sizes):
    rng = random.Random(3)
    rows = []
    for clip, size in enumerate(sizes):
        for k in range(size):
            a = rng.uniform(-math.pi, math.pi)
            rows.append((clip, k, rng.uniform(0, 5), rng.uniform(0, 5), math.sin(a), math.cos(a)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "clip int, k int, px double, pz double, fx double, fz double")


@pytest.mark.parametrize("stride", [1, 2])
def test_kinematics_in_blocks_equals_one_window(spark, stride):
    p = poses(spark, [1, 2, 15, 16, 17, 33, 64, 65, 200])
    whole = kinematics.speed_heading(p, "clip", 10, stride)
    blocks = kinematics.speed_heading(p, "clip", 10, stride, rows_per_task=SMALL)
    assert sorted(whole.collect()) == sorted(blocks.collect())


def test_kinematics_match_numpy(spark):
    import numpy as np

    p = poses(spark, [61, 7])
    got = {(r.clip, r.i): (r.v, r.h) for r in kinematics.speed_heading(p, "clip", 10, rows_per_task=SMALL).collect()}
    frame = p.toPandas().sort_values(["clip", "k"])
    expected = {}
    for clip, g in frame.groupby("clip"):
        yaw = np.arctan2(g.fx.to_numpy(), g.fz.to_numpy())
        h = np.degrees(np.unwrap(yaw - yaw[0]))
        v = np.hypot(np.diff(g.px), np.diff(g.pz)) * 10 * 2.2369362921
        expected.update({(clip, i): (v[i], h[i]) for i in range(len(v))})
    assert got.keys() == expected.keys()
    for key, (v, h) in got.items():
        assert v == pytest.approx(expected[key][0], abs=6e-5)
        assert h == pytest.approx(expected[key][1], abs=6e-5)


def test_neighbours_in_blocks(spark):
    rng = random.Random(5)
    skipped = {"f": [rng.random() < 0.7 for _ in range(120)], "g": [True] * 40, "h": [False] * 3}
    rows = [(f, i, s) for f, flags in skipped.items() for i, s in enumerate(flags)]
    queue = spark.createDataFrame(rows, "folder string, pos long, skipped boolean")
    for limit in (SMALL, 10_000):
        got = review.next_previous(queue, "folder", rows_per_task=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            free = [i for i, s in enumerate(skipped[r.folder]) if not s]
            after, before = [i for i in free if i > r.pos], [i for i in free if i < r.pos]
            nxt, prv = (after[0] if after else None), (before[-1] if before else None)
            assert (r.next_pos, r.prev_pos) == (nxt, prv)
            own = None if r.skipped else r.pos
            landing = next((x for x in (own, nxt, prv) if x is not None), r.pos)
            assert r.landing_pos == landing


def test_window_means_of_long_clip(spark):
    rows = [("long", i, float(i % 17), float(i % 11) - 5) for i in range(300)]
    rows += [(f"c{c}", i, float(i), -6.0) for c in range(5) for i in range(c + 1)]
    samples = spark.createDataFrame(rows, "clip string, i long, v double, h double")
    one = trajectory.window_means(samples, "clip")
    cut = trajectory.window_means(samples, "clip", rows_per_task=SMALL)
    as_rows = lambda df: sorted((r.clip, r.n, round(r.start_v, 9), round(r.end_v, 9), r.max_abs_h) for r in df.collect())
    assert as_rows(one) == as_rows(cut)
