"""Speed and heading series from one row per pose (``key``, ``k``, px, pz, fx, fz).

``k`` is the dense 0-based frame index within a clip.  Clips up to
``rows_per_task`` poses use one window over (clip, k).  When any clip is longer,
frames are cut into blocks of that many rows, ``k div rows_per_task``: the first
pose of a block is also handed to the block before it (so every step has both
ends), and each block's starting turn count is carried in from a table with one
row per block.

Poses from steps are a running product of rigid motions, which is associative but
not commutative: ``poses_from_steps`` takes it per block, over the blocks' products
(in blocks again, while a clip has many), and puts the two together row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsight.functions import series as S
from clipsight.functions.paths import NATIVE_HZ, TARGET_HZ
from clipsight.operators.skew import task_rows
from clipsight.session import ensure_checkpoint_dir


def speed_heading(
    poses: DataFrame, key: str, hz: float = NATIVE_HZ, stride: int = 1, rows_per_task: int | None = None
) -> DataFrame:
    """``(key, i, v, h)``: one sample per pair of neighbouring (strided) poses."""
    rows_per_task = task_rows(poses, rows_per_task)
    kept = poses if stride == 1 else poses.filter(F.col("k") % stride == 0)
    frames = kept.select(
        key,
        (F.col("k") / stride).cast("long").alias("i"),
        "px",
        "pz",
        S.yaw(F.col("fx"), F.col("fz")).alias("yaw"),
    )
    if _all_short(poses, rows_per_task * stride):
        return _samples(_in_one_window(frames, key), [key], S.d(hz))

    block = F.floor(F.col("i") / rows_per_task)
    halo = frames.withColumn(
        "_b",
        F.explode(
            F.when((F.col("i") % rows_per_task == 0) & (F.col("i") > 0), F.array(block, block - 1)).otherwise(
                F.array(block)
            )
        ),
    )
    order = Window.partitionBy(key, "_b").orderBy("i")
    steps = (
        halo.withColumns(_step_columns(order))
        .withColumn("turns", F.sum("turn_in").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # The borrowed pose has served as the end of the last step; its turn is
        # part of the block it was borrowed by.
        .withColumn("own", F.col("_b") == block)
    )
    per_block = steps.groupBy(key, "_b").agg(
        F.sum("turn_in").alias("block_turns"), F.min_by("yaw", "i").alias("block_yaw")
    )
    along = Window.partitionBy(key).orderBy("_b")
    carry = per_block.select(
        key,
        "_b",
        F.coalesce(F.sum("block_turns").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "turns_before"
        ),
        F.first("block_yaw").over(along).alias("yaw0"),
    )
    joined = (
        steps.filter("own")
        .join(carry, [key, "_b"])
        .withColumn("turns", F.col("turns") + F.col("turns_before"))
    )
    return _samples(joined, [key], S.d(hz))


def _all_short(poses: DataFrame, limit: int) -> bool:
    """A plain comparison on the stored column: row-group statistics answer it."""
    return poses.filter(F.col("k") >= limit).isEmpty()


def _in_one_window(frames: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("i")
    return frames.withColumns(_step_columns(order)).withColumns(
        {
            "turns": F.sum("turn_in").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "yaw0": F.first("yaw").over(order),
        }
    )


def _step_columns(order) -> dict[str, Column]:
    """Length of the step that starts at a pose, and the whole turns of the step that ends there."""
    return {
        "dist": S.ground_step(F.col("px"), F.col("pz"), F.lead("px").over(order), F.lead("pz").over(order)),
        "turn_in": S.turn(F.col("yaw") - F.lag("yaw").over(order)).cast("long"),
    }


def _samples(steps: DataFrame, keys: list[str], hz: Column) -> DataFrame:
    """The last pose starts no step and yields no sample."""
    return steps.filter("dist is not null").select(
        *keys,
        "i",
        F.round(S.mph(F.col("dist"), hz), 4).alias("v"),
        F.round(F.degrees(F.col("yaw") - F.col("yaw0")) + F.col("turns") * S.d(360), 4).alias("h"),
    )


def both_rates(poses: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """Native and down-sampled series in one table, told apart by ``hz``.

    The slower series is derived from strided poses, not from the faster one.  A
    pose that both use is handed to both, so one scan and one shuffle serve them.
    """
    stride = max(1, round(NATIVE_HZ / TARGET_HZ))
    if not _all_short(poses, task_rows(poses, rows_per_task)):
        native = speed_heading(poses, key, NATIVE_HZ, 1, rows_per_task).withColumn("hz", F.lit(NATIVE_HZ))
        slow = speed_heading(poses, key, TARGET_HZ, stride, rows_per_task).withColumn("hz", F.lit(TARGET_HZ))
        return native.unionByName(slow)
    k = F.col("k").cast("long")
    native = F.struct(F.lit(NATIVE_HZ).alias("hz"), k.alias("i"))
    slow = F.struct(F.lit(TARGET_HZ).alias("hz"), (k / stride).cast("long").alias("i"))
    uses = F.when(k % stride == 0, F.array(native, slow)).otherwise(F.array(native))
    frames = poses.select(key, F.inline(uses), "px", "pz", S.yaw(F.col("fx"), F.col("fz")).alias("yaw"))
    samples = _samples(_in_one_window(frames, key, "hz"), [key, "hz"], F.col("hz").cast("double"))
    return samples.select(key, "i", "v", "h", "hz")


def start_speed(poses: DataFrame, key: str, hz: float = NATIVE_HZ) -> DataFrame:
    """``(key, init_v)``: mean speed over the first few native steps; only those poses are read."""
    head = poses.filter(F.col("k") <= S.START_STEPS).select(key, "k", "px", "pz")
    order = Window.partitionBy(key).orderBy("k")
    step = S.ground_step(F.col("px"), F.col("pz"), F.lead("px").over(order), F.lead("pz").over(order))
    return (
        head.withColumn("dist", step)
        .groupBy(key)
        .agg(F.coalesce(S.mph(F.avg("dist"), S.d(hz)), S.d(0)).alias("init_v"))
    )


def poses_from_actions(
    actions: DataFrame, column: str = "action", out: str = "poses", scale: float = 1.35, frame: str = "local"
) -> DataFrame:
    """Absolute poses from per-step 9-vectors (translation 3 + rotation 6), one row per clip.

    The six rotation numbers are the first two columns of the step's rotation
    matrix, made orthonormal by Gram-Schmidt (Zhou et al., CVPR 2019).  The
    convention is explicit: with ``frame='local'`` each step is applied in the
    moving frame, T[k+1] = T[k] * D[k]; with ``'world'`` in the fixed one.  The
    first pose is the identity.  Row-local: a clip's array is folded in place.
    """
    if frame not in ("local", "world"):
        raise ValueError(f"unknown frame: {frame}")

    @F.pandas_udf("array<double>")
    def fold(batch: pd.Series) -> pd.Series:
        result = pd.Series([None] * len(batch), dtype=object)
        sizes = batch.map(lambda a: -1 if a is None else len(a)).to_numpy()
        for size in np.unique(sizes[sizes >= 0]):
            rows = np.flatnonzero(sizes == size)
            step = np.stack(batch.iloc[rows].to_list()).astype(float).reshape(len(rows), size // 9, 9)
            poses = _fold_steps(step, scale, frame == "local")
            for r, clip in zip(rows, poses):
                result.iat[r] = clip.ravel()
        return result

    steps = F.col(column)
    sound = F.forall(steps, lambda s: F.size(s) == 9)
    flat = fold(F.when(sound, F.flatten(steps)))
    # The UDF result is materialised once as a column before it is unpacked.
    return (
        actions.withColumn("_flat", flat)
        .withColumn(out, F.when(F.col("_flat").isNotNull(), _unpack(F.col("_flat"))))
        .drop("_flat")
    )


def _unpack(flat: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(flat) - 4, F.lit(4)),
        lambda i: F.struct(*(F.get(flat, i + j).alias(c) for j, c in enumerate(("px", "pz", "fx", "fz")))),
    )


def _rigid(step: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(..., 9) step vectors as rotations (..., 3, 3) and translations (..., 3)."""
    a = step[..., 3:6]
    a = a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)
    b = step[..., 6:9]
    b = b - np.sum(a * b, axis=-1, keepdims=True) * a
    b = b / np.maximum(np.linalg.norm(b, axis=-1, keepdims=True), 1e-12)
    return np.stack([a, b, np.cross(a, b)], axis=-1), step[..., 0:3] * scale


def _fold_steps(step: np.ndarray, scale: float, local: bool) -> np.ndarray:
    """(clips, n, 9) steps -> (clips, n+1, 4) of px, pz, fx, fz; all clips advance together."""
    clips, n, _ = step.shape
    turn, move = _rigid(step, scale)
    rot = np.tile(np.eye(3), (clips, 1, 1))
    pos = np.zeros((clips, 3))
    out = np.empty((clips, n + 1, 4))
    out[:, 0] = (0.0, 0.0, 0.0, 1.0)
    for k in range(n):
        if local:
            pos = pos + np.einsum("cij,cj->ci", rot, move[:, k])
            rot = rot @ turn[:, k]
        else:
            pos = np.einsum("cij,cj->ci", turn[:, k], pos) + move[:, k]
            rot = turn[:, k] @ rot
        out[:, k + 1, 0], out[:, k + 1, 1] = pos[:, 0], pos[:, 2]
        out[:, k + 1, 2], out[:, k + 1, 3] = rot[:, 0, 2], rot[:, 2, 2]
    return out


def _running(turn: np.ndarray, move: np.ndarray, local: bool) -> tuple[np.ndarray, np.ndarray]:
    """Running products of n motions in about log2(n) passes over all of them."""
    turn, move, reach = turn.copy(), move.copy(), 1
    while reach < len(turn):
        first, then = (turn[:-reach], move[:-reach]), (turn[reach:], move[reach:])
        outer, inner = (first, then) if local else (then, first)
        moved = np.einsum("nij,nj->ni", outer[0], inner[1]) + outer[1]
        turn[reach:], move[reach:] = outer[0] @ inner[0], moved
        reach *= 2
    return turn, move


#: A motion as one array: nine numbers of the rotation by rows, then the translation.
_AT_REST = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]


def _composed(outer: Column, inner: Column) -> Column:
    """The motion that applies ``inner``, then ``outer``, as a column."""
    o, i = (lambda r, c: F.get(outer, 3 * r + c)), (lambda r, c: F.get(inner, 3 * r + c))
    turn = [o(r, 0) * i(0, c) + o(r, 1) * i(1, c) + o(r, 2) * i(2, c) for r in range(3) for c in range(3)]
    move = [o(r, 0) * F.get(inner, 9) + o(r, 1) * F.get(inner, 10) + o(r, 2) * F.get(inner, 11) + F.get(outer, 9 + r) for r in range(3)]
    return F.array(*turn, *move)


def _block_products(motions: DataFrame, keys: list[str], local: bool, scale: float | None) -> DataFrame:
    """``motions`` (keys, _b, _k, _m) with ``_m`` replaced by the running product within (keys, _b).

    With ``scale``, ``_m`` holds step vectors of nine numbers, else motions.
    """
    kinds = motions.schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_k")
        steps = table.column("_m").combine_chunks()
        width = 12 if scale is None else 9
        numbers = np.full((len(steps), width), np.nan)
        sound = pc.equal(pc.list_value_length(steps), width).fill_null(False).to_numpy(zero_copy_only=False)
        numbers[sound] = pc.list_flatten(steps.filter(pa.array(sound))).to_numpy(zero_copy_only=False).reshape(-1, width)
        turn, move = (numbers[:, :9].reshape(-1, 3, 3), numbers[:, 9:]) if scale is None else _rigid(numbers, scale)
        turn, move = _running(turn, move, local)
        flat = np.concatenate([turn.reshape(-1, 9), move], axis=1)
        ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 12)
        product = pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))
        return table.set_column(table.schema.get_field_index("_m"), "_m", product)

    out = ", ".join(f"`{f.name}` {'array<double>' if f.name == '_m' else f.dataType.simpleString()}" for f in kinds)
    return motions.groupBy(*keys, "_b").applyInArrow(run, out)


def _running_products(motions: DataFrame, key: str, local: bool, scale: float | None, rows: int) -> DataFrame:
    """(key, _k, _m): running products along ``_k``, dense from 0, however long a key is."""
    blocks = motions.withColumn("_b", F.floor(F.col("_k") / rows).cast("long"))
    within = _block_products(blocks, [key], local, scale)
    if motions.filter(F.col("_k") >= rows).isEmpty():
        return within.drop("_b")
    ensure_checkpoint_dir(motions.sparkSession)
    within = within.checkpoint()
    # One row per block: what each contributes, and with that what came before it.
    totals = within.groupBy(key, "_b").agg(F.max_by("_m", "_k").alias("_m")).withColumnRenamed("_b", "_k")
    carried = _running_products(totals, key, local, None, rows)
    before = carried.select(F.col(key).alias("_key"), (F.col("_k") + 1).alias("_block"), F.col("_m").alias("_before"))
    met = within.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_block")), "left")
    whole = _composed(F.col("_before"), F.col("_m")) if local else _composed(F.col("_m"), F.col("_before"))
    return met.select(key, "_k", F.when(F.col("_b") == 0, F.col("_m")).otherwise(whole).alias("_m"))


def poses_from_steps(
    steps: DataFrame, key: str, k: str = "k", column: str = "action", scale: float = 1.35, frame: str = "local", block_rows: int = 4096
) -> DataFrame:
    """``(key, k, px, py, pz, fx, fz)``: the poses of ``poses_from_actions`` from one row per step.

    ``k`` is dense from 0 within a clip; a clip of n steps has n + 1 poses, the first
    at rest.  A clip is cut into blocks of ``block_rows`` steps, which are shared out
    over the tasks; of a block only its product goes on.  From a step on that is null
    or has not nine numbers, positions and headings are null.
    """
    if frame not in ("local", "world"):
        raise ValueError(f"unknown frame: {frame}")
    motions = steps.select(key, F.col(k).cast("long").alias("_k"), F.col(column).cast("array<double>").alias("_m"))
    done = _running_products(motions, key, frame == "local", scale, block_rows)
    rest = F.struct(F.lit(0).cast("long").alias("k"), F.array(*[F.lit(x) for x in _AT_REST]).alias("m"))
    pose = F.struct((F.col("_k") + 1).alias("k"), F.col("_m").alias("m"))
    # The first step brings the pose before it along.
    rows = done.select(key, F.inline(F.when(F.col("_k") == 0, F.array(rest, pose)).otherwise(F.array(pose))))
    known = lambda i: F.nanvl(F.get("m", i), F.lit(None).cast("double"))
    return rows.select(key, "k", *[known(i).alias(n) for n, i in (("px", 9), ("py", 10), ("pz", 11), ("fx", 2), ("fz", 8))])


def with_series(clips: DataFrame, poses: str = "poses") -> DataFrame:
    """Row-local series for clips that carry their pose array: ``series_10hz``, ``series_5hz``, ``init_v``."""
    p = F.col(poses)
    stride = max(1, round(NATIVE_HZ / TARGET_HZ))
    return clips.withColumns(
        {
            "series_10hz": S.poses_to_series(p, NATIVE_HZ),
            "series_5hz": S.poses_to_series(S.every(p, stride), TARGET_HZ),
            "init_v": S.start_speed(p, NATIVE_HZ),
        }
    )
