"""Packing of tokenised documents into training sequences by vector best fit.

Documents are encoded in the tasks that read them; only their pieces (identifier,
length, checksum) go on.  Pieces are dealt out by position into groups of bounded
size, and every group is packed on its own, longest piece first: a piece goes to
the open sequence that is left with the least weighted residual (or that has the
highest weighted dot product of demand and residual), among those that have room
for it in every dimension: tokens, documents and attention cost (the sum of the
squared lengths).  A group wastes at most about one sequence, whatever the number
of groups.

Defined cases: a null text is empty and consists of the end id alone; repeated rows
are documents of their own; a null identifier is kept.  Equal lengths are placed in
the order of identifier and piece.  An empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.llm.shared import releasing, runs_of, stored, text_views
from clipsight.llm.wordbpe import SLICE, encoder, forget_words

#: Pieces packed together in one task.
GROUP = 16_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Room:
    """Capacities of a sequence and the weights of the dimensions in the choice of a sequence."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)

    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        return min(self.tokens, math.isqrt(self.attention))


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, longest: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most ``longest`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            for i, j in runs_of(offsets, SLICE):
                ids, at = coder.encode_bytes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lengths = np.diff(at) + 1
                # Room for the end id behind each document.
                full = np.full(len(ids) + j - i, end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(j - i), lengths - 1)] = ids
                cuts = -(-lengths // longest)
                rows = np.repeat(np.arange(j - i), cuts)
                number = np.arange(len(rows)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                starts = number * longest
                size = np.minimum(longest, lengths[rows] - starts)
                begin = (at[:-1] + np.arange(j - i))[rows] + starts
                raw = memoryview(full).cast("B")
                sums = [zlib.crc32(raw[4 * b : 4 * (b + s)]) for b, s in zip(begin.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(number.astype(np.int32)), pa.array(starts), pa.array(size), pa.array(sums, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(releasing(run, forget_words), PIECES)


def best_fit(lengths: np.ndarray, room: Room, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece; pieces are placed in the order given."""
    w = np.array(room.weights)
    n = len(lengths)
    # What the open sequences have left, by dimension.
    tokens, documents, attention = np.zeros(n), np.zeros(n), np.zeros(n)
    number, used = np.zeros(n, np.int64), np.zeros(n, np.int64)
    opened, made = 0, 0
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = np.minimum.accumulate(lengths[::-1])[::-1]  # shortest piece still to come
    for i, size in enumerate(lengths.tolist()):
        cost = size * size
        t, d, c = tokens[:opened], documents[:opened], attention[:opened]
        fits = np.flatnonzero((t >= size) & (d >= 1) & (c >= cost))
        if len(fits):
            t, d, c = t[fits], d[fits], c[fits]
            if rule == "norm":
                left = w[0] * ((t - size) / room.tokens) ** 2 + w[1] * ((d - 1) / room.documents) ** 2 + w[2] * ((c - cost) / room.attention) ** 2
                pick = fits[left.argmin()]
            else:
                product = t * (w[0] * size / room.tokens**2) + d * (w[1] / room.documents**2) + c * (w[2] * cost / room.attention**2)
                pick = fits[product.argmax()]
        else:
            pick, opened = opened, opened + 1
            tokens[pick], documents[pick], attention[pick] = room.tokens, room.documents, room.attention
            number[pick], used[pick] = made, 0
            made += 1
        where[i], offset[i] = number[pick], used[pick]
        tokens[pick] -= size
        documents[pick] -= 1
        attention[pick] -= cost
        used[pick] += size
        shortest = least[i + 1] if i + 1 < n else 0
        if tokens[pick] < shortest or documents[pick] < 1 or attention[pick] < shortest**2:
            opened -= 1  # nothing to come fits: the last open one takes its place
            for state in (tokens, documents, attention, number, used):
                state[pick] = state[opened]
    return where, offset


def pack(parts: DataFrame, room: Room = Room(), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the pieces; ``parts`` is a stored table of ``pieces``."""
    total = parts.count()
    groups = max(1, math.ceil(total / group))

    def run(table):
        order = pa.compute.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        where, offset = best_fit(table.column("length").to_numpy(), room, rule)
        ids = where + (table.column("part").to_numpy() << 32)
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    return (
        parts.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        .groupBy("part")
        .applyInArrow(run, PIECES + ", sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, tokenizer: str, room: Room = Room(), rule: str = "norm", **options) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer, longest=room.longest(), **options)), room, rule)
