"""Exact top-k search by inner product over whole tables, in tiles.

Query vectors are packed into blocks and all vectors into shards.  Every tile
(block x shard) is one matrix product followed by a partial selection, so a tile
hands on at most ``k`` rows per query; the lists are then merged in a tree whose
fan-in is fixed, so no task ever sees all lists of a query.  A block goes to its shards
in copies, one per part of the table (``SPREAD`` parts at most), so that the shards it
meets are shared out over the tasks however few blocks there are.

Defined cases: null vectors, empty vectors, and vectors with a null, infinite or
NaN component, or one that is infinite when scaled, take no part, nor do rows without an id.  Only vectors of equal
length are compared.  Rows that repeat an id are candidates of their own for the
other ids; a query never meets a row of its own id, and equal queries are one.
Ties go to the smaller id.  An empty table gives no rows.  Scores beyond 64 bits
are held at the limits of a long.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors in a block, how many lists one step of the tree merges, and parts of the table that a block meets apart.
BLOCK, FAN_IN, SPREAD = 1024, 32, 512
PACKED = "dim int, ids binary, vectors binary"


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * 1024)


def pack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix) of the usable vectors of a batch, by dimension, in order of id."""
    ids, vectors = batch.column(0), batch.column(1)
    usable = pa.compute.and_(ids.is_valid(), vectors.is_valid()).to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(over="ignore"):
        broken = np.concatenate([[0], np.cumsum(~np.isfinite(scaled(flat)))])
    usable &= (sizes > 0) & (broken[ends] == broken[ends - sizes])
    for dim in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == dim))
        rows = rows[np.argsort(ids[rows], kind="stable")]
        at = (ends[rows] - dim)[:, None] + np.arange(dim)
        yield int(dim), ids[rows].astype(np.int64), scaled(flat[at])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, ids, matrix in pack(batch):
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())],
                names=["dim", "ids", "vectors"],
            )


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer products: as doubles while they hold every integer, as wider integers beyond."""
    top = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1]
    if top < 2**53:
        return (queries @ shard.T).astype(np.int64)
    wide = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = wide(queries) @ wide(shard).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def selected(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest allowed scores; equal scores by column."""
    rows, cols = [], []
    for r in range(len(scores)):
        free = np.flatnonzero(allowed[r])
        row = scores[r, free]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            above, equal = np.flatnonzero(row > least), np.flatnonzero(row == least)
            free = free[np.concatenate([above, equal[: k - len(above)]])]
        rows.append(np.full(len(free), r))
        cols.append(free)
    return np.concatenate(rows), np.concatenate(cols)


def best(df: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"), F.asc("shard"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of other ids for every query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("asks"))
    asked = rows.filter("asks").select("vec_id", "v").distinct()
    blocks = max(1, math.ceil(asked.count() / block))

    def pack_block(key, table):
        found = list(pack(table.select(["vec_id", "v"]).combine_chunks().to_batches()[0])) if table.num_rows else []
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(found), pa.int32()),
            "dim": pa.array([d for d, _, _ in found], pa.int32()),
            "q_ids": pa.array([i.tobytes() for _, i, _ in found], pa.binary()),
            "q_vectors": pa.array([m.tobytes() for _, _, m in found], pa.binary()),
        })

    width = max(1, rows.rdd.getNumPartitions())
    spread = min(2 * width, SPREAD)
    questions = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .groupBy("block")
        .applyInArrow(pack_block, "block int, dim int, q_ids binary, q_vectors binary")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    )
    shards = (
        rows.select("vec_id", "v")
        .mapInArrow(packed, PACKED)
        .withColumn("shard", F.monotonically_increasing_id())
        .withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(spread)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        # Products are dear and rows are few: tasks are not joined for being small.
        .repartition(max(spread, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block", "dim", "part")
    )

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, c = np.frombuffer(row["q_vectors"]).reshape(-1, dim), np.frombuffer(row["vectors"]).reshape(-1, dim)
                for at in range(0, len(q), 128):
                    part, ids = q[at : at + 128], q_ids[at : at + 128]
                    scores = products(part, c)
                    r, j = selected(scores, ids[:, None] != c_ids[None, :], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[r]), pa.array(np.full(len(r), row["shard"], np.int64)), pa.array(c_ids[j]), pa.array(scores[r, j])],
                        names=["query_id", "shard", "vec_id", "score"],
                    )

    lists = shards.join(questions, ["block", "dim", "part"]).mapInArrow(tile, "query_id long, shard long, vec_id long, score long")
    # A shard's number is (partition, position): positions merge first, then partitions by fan-in.
    lists = lists.withColumn("shard", F.shiftright("shard", 33))
    while width > 1:
        lists = best(lists, k, "query_id", "shard").drop("rank").withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("long"))
        width = math.ceil(width / FAN_IN)
    return best(lists, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
