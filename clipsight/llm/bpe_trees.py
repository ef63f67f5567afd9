"""Encoding and decoding of whole texts, long ones as a tree of concatenations.

A normalised text longer than ``leaf`` characters is halved until its parts are
short enough, wherever the cuts fall.  Parts are encoded in parallel, as rows of
their own, and put together pairwise: around each join a window of the last and
first words is cut into words again and grows until both sides agree.  A word that
runs over the join and is long itself is joined the same way by its ids: the last
ids of the left and the first of the right are encoded again, more and more of
them, until the outermost ids come out as they were.  Neighbouring ids that the
model leaves as they are make a right encoding, so agreement on both sides is
exact.

Decoding is what the library does for a file without a decoder: the surface forms
of the ids with a blank between them.

Defined cases: a null text is empty and gives no ids; special tokens spelled out in
a text are single ids, as the library has it; repeated rows are rows of the result
of their own; a null identifier is kept.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.llm.shared import releasing, runs_of, stored, text_views
from clipsight.llm.wordbpe import SLICE, WordEncoder, encoder, forget_words

#: Characters of a part that is encoded in one go; words and ids in the first window; bytes of a long word.
LEAF, WINDOW, LONG_WORD = 1 << 15, 4, 256


@dataclass
class Part:
    """A stretch of normalised text with the places of its words and the ids of each."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: list[np.ndarray]  # by word; the last word has no word end if it touches a cut
    last: bool  # whether the text ends here


def leaf_part(coder: WordEncoder, points: np.ndarray, last: bool) -> Part:
    """Encodes one stretch; a word that touches the cut behind it is encoded as a word that goes on."""
    starts, ends = coder.words(points, np.array([0]))
    if not len(starts):
        return Part(points, starts, ends, [], last)
    goes_on = not last and ends[-1] == len(points)
    whole = len(starts) - goes_on
    numbers = coder.word_numbers(points, starts[:whole], ends[:whole])
    memory = coder.memory
    ids = [memory.pool[s : s + c].copy() for s, c in zip(memory.starts[numbers].tolist(), memory.counts[numbers].tolist())]
    if goes_on:
        ids += coder.model_ids([text_of(points[starts[-1] : ends[-1]])], ended=False)
    return Part(points, starts, ends, ids, last)


def text_of(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "replace")


def word_ids(coder: WordEncoder, raw: bytes, ended: bool) -> np.ndarray:
    """Ids of a stretch of a word given in UTF-8, from and to any byte."""
    model = (coder.ended if ended else coder.open).model
    return np.array([t.id for t in model.tokenize("".join(coder.bytes_to_points[b] for b in raw))], np.int32)


def joined_word(coder: WordEncoder, left: np.ndarray, right: np.ndarray, raw: bytes, cut: int, ended: bool) -> np.ndarray:
    """Ids of a word from those of its two stretches, ``cut`` being the first byte of the second."""
    k = WINDOW
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        begin = cut - int(coder.width[left[a:]].sum())
        end = cut + int(coder.width[right[:b]].sum())
        at_end = b == len(right)
        window = word_ids(coder, raw[begin:end], ended and at_end)
        agreed_left = a == 0 or (len(window) and window[0] == left[a])
        agreed_right = at_end or (len(window) and window[-1] == right[b - 1])
        if agreed_left and agreed_right:
            return np.concatenate([left[:a], window, right[b:]])
        k *= 2


def concatenated(coder: WordEncoder, left: Part, right: Part) -> Part:
    cut = len(left.points)
    points = np.concatenate([left.points, right.points])
    r_starts, r_ends = right.starts + cut, right.ends + cut
    k = WINDOW
    while True:
        a, b = max(0, len(left.starts) - k), min(len(right.starts), k)
        begin = int(left.starts[a]) if a else 0
        at_end = b == len(right.starts)
        end = len(points) if at_end else int(r_starts[b])
        starts, ends = coder.words(points[begin:end], np.array([0]))
        starts, ends = starts + begin, ends + begin
        # The right side agrees once a word begins where one of its words begins, a few words before the end.
        agreed = at_end or (len(starts) > 2 and b > 2 and starts[-2] == r_starts[b - 2] and ends[-2] == r_ends[b - 2])
        if agreed:
            break
        k *= 2
    keep_left = int(np.searchsorted(starts, left.starts[a], "left")) if a else 0
    known_left = dict(zip(left.starts[a:].tolist(), range(a, len(left.starts))))
    known_right = dict(zip(r_starts[:b].tolist(), range(b)))
    ids = []
    for s, e in zip(starts[keep_left:].tolist(), ends[keep_left:].tolist()):
        i, j = known_left.get(s), known_right.get(s)
        goes_on = not right.last and e == len(points)
        if i is not None and left.ends[i] == e and e < cut:
            ids.append(left.ids[i])
        elif j is not None and r_ends[j] == e:
            ids.append(right.ids[j])
        elif i is not None and cut < e and len(right.starts) and r_starts[0] == cut and r_ends[0] == e and e - s > LONG_WORD and left.ends[i] == cut:
            raw = text_of(points[s:e]).encode()
            ids.append(joined_word(coder, left.ids[i], right.ids[0], raw, len(text_of(points[s:cut]).encode()), not goes_on))
        else:
            ids += coder.model_ids([text_of(points[s:e])], ended=not goes_on)
    return Part(
        points,
        np.concatenate([left.starts[:a], starts[keep_left:], r_starts[b:]]),
        np.concatenate([left.ends[:a], ends[keep_left:], r_ends[b:]]),
        left.ids[:a] + ids + right.ids[b:],
        right.last,
    )


def tree(coder: WordEncoder, parts: list[Part]) -> np.ndarray:
    """Ids of a text from its parts in order, joined pairwise level by level."""
    while len(parts) > 1:
        parts = [concatenated(coder, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return np.concatenate([np.zeros(0, np.int32), *parts[0].ids]) if parts else np.zeros(0, np.int32)


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """(begin, end) of the parts of n characters after halving while a part is longer than a leaf."""
    cuts = [0, n]
    while max(b - a for a, b in zip(cuts, cuts[1:])) > leaf:
        cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]))})
    return list(zip(cuts, cuts[1:]))


class Digests:
    """Count and digests of the ids of a text."""

    def __init__(self, coder: WordEncoder):
        self.number = [str(i) for i in range(len(coder.surface))]
        self.surface = coder.surface

    def of(self, ids: np.ndarray) -> tuple[int, str, str]:
        known = ids.tolist()
        numbers = " ".join([self.number[i] for i in known]).encode()
        decoded = " ".join([self.surface[i] for i in known]).encode()
        return len(known), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(decoded).hexdigest()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FIRST = RESULT + ", mark long, segment int, part int, parts int, special int, piece string"


def texts_and_leaves(docs: DataFrame, tokenizer: str, leaf: int = LEAF, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Results of short texts, and for long ones a row per part: ``piece`` is null in the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        digests = Digests(coder)
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            doc_ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in runs_of(offsets, SLICE):
                rows = []
                long = np.flatnonzero(np.diff(offsets[i : j + 1]) > leaf).tolist()
                bounds = [*long, j - i]
                at = 0
                for stop in bounds:
                    if at < stop:
                        ids, begins = coder.encode_bytes(data[offsets[i + at] : offsets[i + stop]], offsets[i + at : i + stop + 1] - offsets[i + at])
                        for d in range(at, stop):
                            rows.append((doc_ids[i + d], *digests.of(ids[begins[d - at] : begins[d - at + 1]]), None, 0, 0, 0, None, None))
                    if stop < j - i:
                        text = data[offsets[i + stop] : offsets[i + stop + 1]].tobytes().decode("utf-8", "replace")
                        for number, segment in enumerate(coder.segments(text)):
                            key = (doc_ids[i + stop], None, None, None, marks[i + stop], number)
                            if isinstance(segment, int):
                                rows.append((*key, 0, 1, segment, ""))
                                continue
                            points = coder.folded(segment)
                            cut = halves(len(points), leaf)
                            rows += [(*key, k, len(cut), None, text_of(points[a:b])) for k, (a, b) in enumerate(cut)]
                    at = stop + 1
                yield batch_of(rows, FIRST)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return chosen.withColumn("mark", F.xxhash64("text")).mapInArrow(releasing(run, forget_words), FIRST)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


CODED = "doc_id long, mark long, segment int, part int, parts int, special int, piece string, counts binary, ids binary"


def encode_leaves(leaves: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of every part, in parallel: the parts of a text are dealt out one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for row in batch.to_pylist():
                coded = leaf_part(coder, coder.points_of(row["piece"]), row["part"] == row["parts"] - 1)
                row["counts"] = np.array([len(x) for x in coded.ids], np.int32).tobytes()
                row["ids"] = np.concatenate([np.zeros(0, np.int32), *coded.ids]).tobytes()
                yield batch_of([tuple(row[x.split()[0]] for x in CODED.split(", "))], CODED)

    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.select("doc_id", "mark", "segment", "part", "parts", "special", "piece")
    return rows.repartition(n, "mark", "segment", "part").mapInArrow(releasing(run, forget_words), CODED)


def join_leaves(coded: DataFrame, tokenizer: str) -> DataFrame:
    """Results of long texts from their encoded parts; a group is one text."""

    def run(table):
        coder = encoder(tokenizer)
        rows = table.sort_by([("segment", "ascending"), ("part", "ascending")]).to_pylist()
        copies = sum(r["segment"] == rows[0]["segment"] and r["part"] == rows[0]["part"] for r in rows)
        ids, parts = [], []
        for row in rows[::copies]:
            if row["special"] is not None:
                ids.append(np.array([row["special"]], np.int32))
                continue
            points = coder.points_of(row["piece"])
            counts, flat = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["ids"], np.int32)
            starts, ends = coder.words(points, np.array([0]))
            each = np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []
            last = row["part"] == row["parts"] - 1
            parts.append(Part(points, starts, ends, each, last))
            if last:
                ids.append(tree(coder, parts))
                parts = []
        found = (rows[0]["doc_id"], *Digests(coder).of(np.concatenate([np.zeros(0, np.int32), *ids])))
        return pa.Table.from_batches([batch_of([found] * copies, RESULT)])

    return coded.groupBy("doc_id", "mark").applyInArrow(run, RESULT)


def encoded(docs: DataFrame, tokenizer: str, leaf: int = LEAF, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    first = stored(texts_and_leaves(docs, tokenizer, leaf, **options))
    columns = [x.split()[0] for x in RESULT.split(", ")]
    long = join_leaves(encode_leaves(first.filter("piece is not null"), tokenizer), tokenizer)
    return first.filter("piece is null").select(*columns).unionByName(long)
