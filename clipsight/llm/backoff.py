"""Stupid-backoff scores of all documents under the n-gram counts of the whole corpus.

Tokens are the ids of a public vocabulary, so the unigram table has no more rows
than the vocabulary and every task holds it.  A token scores ``c(v w) / c(v .)`` if
the bigram ``v w`` occurs at least ``least`` times in the corpus, else ``discount``
times ``c(w) / N``; a text's first token scores ``c(w) / N``.  ``c(v .)`` counts the
places where ``v`` is followed by a token.

Texts are tokenised once, into a stored table of ids that every later step reads.
Bigrams among the most frequent tokens are counted in dense tables of a fixed size,
so none that is routed holds more than one part in ``FREQUENT`` of all places.  The
others leave each block of documents once per document, packed by a hash of the
bigram; the task that gets a hash range has all places of its bigrams: it counts
them, joins the counts to the places and hands one sum per document back to the
block.  Logarithms are summed as whole millionths, so sums do not depend on order.

Defined cases: a null or empty text has no token and no score; repeated rows are
documents of their own and count as often; a null identifier is kept.  Empty tables
give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.llm.shared import mixed, releasing, runs_of, stored, text_views
from clipsight.llm.wordbpe import SLICE, encoder, forget_models, forget_words

#: Tokens counted in dense pair tables; tokens and documents of a block; tokens handled at once; places that one task counts.
FREQUENT, BLOCK_TOKENS, BLOCK_DOCS, RUN_TOKENS, PART_TOKENS = 512, 250_000, 60_000, 100_000, 2_500_000
DISCOUNT, LEAST = 0.4, 2
UNIT = 1e6


def tokenised(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of every document, stored; ids are little-endian numbers of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            for i, j in runs_of(offsets, SLICE):
                ids, at = coder.encode_bytes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names = batch.column(0).take(pa.array(np.arange(i, j)))  # a slice would keep the whole batch
                ends, packed = pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))
                yield pa.RecordBatch.from_arrays([names, pa.Array.from_buffers(pa.binary(), j - i, [None, ends, packed])], names=["doc_id", "ids"])

    return stored(rows.mapInArrow(releasing(run, forget_words), "doc_id long, ids binary"))


def token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, token ids, places where each document's ids begin) of small groups of documents."""
    forget_models()  # workers that have encoded before need them no more
    for batch in batches:
        data, offsets = text_views(batch.column(1))
        offsets = offsets // 2
        ids = np.ascontiguousarray(data).view("<u2")
        for i, j in runs_of(offsets, RUN_TOKENS):
            yield batch.column(0).slice(i, j - i), ids[offsets[i] : offsets[j]].astype(np.int32), offsets[i : j + 1] - offsets[i]


def micro(x: np.ndarray) -> np.ndarray:
    return np.rint(UNIT * np.log(x)).astype(np.int64)


class Unigrams:
    """Counts by token: all places, and places that are followed by another."""

    def __init__(self, rows: list, size: int):
        self.count, self.follows = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for token, count, follows in rows:
            self.count[token], self.follows[token] = count, follows
        self.total = int(self.count.sum())
        order = np.lexsort((np.arange(size), -self.count))[:FREQUENT]
        self.frequent = np.sort(order[self.count[order] > 0])
        self.rank = np.full(size, -1, np.int64)
        self.rank[self.frequent] = np.arange(len(self.frequent))
        self.single = micro(np.maximum(self.count, 1) / max(self.total, 1))

    def scores(self, before: np.ndarray, token: np.ndarray, count: np.ndarray, least: int, discount: float) -> np.ndarray:
        """Scores of bigrams in millionths, given their counts."""
        seen = micro(np.maximum(count, 1) / np.maximum(self.follows[before], 1))
        back = self.single[token] + int(micro(np.array(discount)))
        return np.where(count >= least, seen, back)


def bigrams(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of second tokens and the document of each."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    return second, doc


def summed(counts: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in counts.values()], names=list(counts))


def unigrams(tokens: DataFrame, size: int) -> Unigrams:
    """Counts by token of a vocabulary of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, follows = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, ids, at in token_runs(batches):
            second, _ = bigrams(ids, at)
            count += np.bincount(ids, minlength=size)
            follows += np.bincount(ids[second - 1], minlength=size)
        some = np.flatnonzero(count)
        yield summed({"token": some.astype(np.int32), "n": count[some], "follows": follows[some]})

    found = tokens.mapInArrow(run, "token int, n long, follows long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("follows").alias("follows"))
    return Unigrams([tuple(r) for r in found.collect()], size)  # at most a row per token of the vocabulary


def frequent_pairs(tokens: DataFrame, single: Unigrams) -> np.ndarray:
    """Counts of the bigrams among the frequent tokens, as a matrix of fixed size."""
    n = max(1, len(single.frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n * n, np.int64)
        for _, ids, at in token_runs(batches):
            second, _ = bigrams(ids, at)
            a, b = single.rank[ids[second - 1]], single.rank[ids[second]]
            both = (a >= 0) & (b >= 0)
            count += np.bincount(a[both] * n + b[both], minlength=n * n)
        some = np.flatnonzero(count)
        yield summed({"pair": some.astype(np.int32), "n": count[some]})

    out = np.zeros(n * n, np.int64)
    for pair, count in tokens.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[pair] = count
    return out.reshape(n, n)


PACKED = "part int, block long, docs int, codes binary, owners binary, times binary, doc_ids binary, sums binary, tokens binary"


def squeezed(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(x.tobytes(), asbytes=True)


def opened(blob: bytes, n: int, kind) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(blob, size, asbytes=True) if size else b"", kind)


def packed_bigrams(rows: DataFrame, single: Unigrams, dense: np.ndarray, parts: int, least: int, discount: float) -> DataFrame:
    """Blocks of documents, cut by bigram hash; one more row per block has what needs no other place's counts."""
    n = len(single.frequent)
    a, b = np.divmod(np.arange(dense.size), dense.shape[1])
    known = single.scores(single.frequent[a], single.frequent[b], dense.ravel(), least, discount).reshape(dense.shape) if n else None

    def flush(number: int, names: list, ids: list, lengths: list) -> Iterator[pa.RecordBatch]:
        names, ids = pa.concat_arrays(names), np.concatenate(ids)
        lengths = np.concatenate(lengths)
        at = np.concatenate([[0], np.cumsum(lengths)])
        docs = len(lengths)
        second, doc = bigrams(ids, at)
        before, token, owner = ids[second - 1].astype(np.int64), ids[second].astype(np.int64), doc[second]
        sums = np.zeros(docs, np.int64)
        some = np.flatnonzero(lengths > 0)
        sums[some] = single.single[ids[at[some]]]
        a, b = single.rank[before], single.rank[token]
        here = (a >= 0) & (b >= 0)
        if here.any():
            np.add.at(sums, owner[here], known[a[here], b[here]])
        key = ((before[~here] << 16 | token[~here]) << 16 | owner[~here]).view(np.uint64)
        key, times = np.unique(key, return_counts=True)
        code, owner = (key >> np.uint64(16)).astype(np.uint32), (key & np.uint64(0xFFFF)).astype(np.uint16)
        part = (mixed(code.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for p in range(parts):
            rows = order[cuts[p] : cuts[p + 1]]
            if len(rows):
                c = code[rows]
                steps = np.diff(c, prepend=np.uint32(0)).astype(np.uint32)
                out.append((p, number, len(rows), squeezed(steps), squeezed(owner[rows]), squeezed(np.minimum(times[rows], 2**32 - 1).astype(np.uint32)), None, None, None))
        home = int(mixed(np.array([number], np.uint64))[0] % np.uint64(parts))
        ids_blob = squeezed(np.concatenate([names.fill_null(0).to_numpy().astype(np.int64), names.is_null().to_numpy(zero_copy_only=False).astype(np.int64)]))
        out.append((home, number, docs, None, None, None, ids_blob, sums.tobytes(), lengths.astype(np.int64).tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
        fields = [x.split()[0] for x in PACKED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        names, ids, lengths, tokens, docs = [], [], [], 0, 0
        for some, found, at in token_runs(batches):
            for i in range(0, len(some), BLOCK_DOCS):
                j = min(len(some), i + BLOCK_DOCS)
                if names and (tokens + at[j] - at[i] > BLOCK_TOKENS or docs + j - i > BLOCK_DOCS):
                    yield from flush(number, names, ids, lengths)
                    names, ids, lengths, tokens, docs, number = [], [], [], 0, 0, number + 1
                names.append(some.take(pa.array(np.arange(i, j))))  # a slice would keep the whole batch
                ids.append(found[at[i] : at[j]])
                lengths.append(np.diff(at[i : j + 1]))
                tokens, docs = tokens + int(at[j] - at[i]), docs + j - i
        if names:
            yield from flush(number, names, ids, lengths)

    return rows.mapInArrow(run, PACKED)


def scores(docs: DataFrame, tokenizer: str, discount: float = DISCOUNT, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every row, in natural logarithms."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    size = len(encoder(tokenizer).surface)
    if size > 1 << 16:
        raise ValueError("a bigram's code has 16 bits for each of its tokens")
    tokens = tokenised(rows, tokenizer)
    single = unigrams(tokens, size)
    dense = frequent_pairs(tokens, single)
    packed = packed_bigrams(tokens, single, dense, max(1, math.ceil(single.total / PART_TOKENS)), least, discount)

    def count_and_score(table):
        rows = table.to_pylist()
        places = [r for r in rows if r["codes"] is not None]
        codes = [np.cumsum(opened(r["codes"], r["docs"], np.uint32), dtype=np.uint32) for r in places]
        times = [opened(r["times"], r["docs"], np.uint32) for r in places]
        kinds, where = np.unique(np.concatenate([np.zeros(0, np.uint32), *codes]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([np.zeros(0, np.uint32), *times]), minlength=len(kinds)).astype(np.int64)
        score = single.scores((kinds >> np.uint32(16)).astype(np.int64), (kinds & np.uint32(0xFFFF)).astype(np.int64), counts, least, discount)
        out, at = [], 0
        for r, c, t in zip(places, codes, times):
            owner = opened(r["owners"], r["docs"], np.uint16)
            sums = np.zeros(int(owner.max()) + 1, np.int64)
            np.add.at(sums, owner, score[where[at : at + len(c)]] * t.astype(np.int64))
            at += len(c)
            out.append((r["block"], len(sums), None, sums.tobytes(), None))
        out += [(r["block"], r["docs"], r["doc_ids"], r["sums"], r["tokens"]) for r in rows if r["codes"] is None]
        columns = list(zip(*out))
        return pa.table({
            "block": pa.array(columns[0], pa.int64()), "docs": pa.array(columns[1], pa.int32()), "doc_ids": pa.array(columns[2], pa.binary()),
            "sums": pa.array(columns[3], pa.binary()), "tokens": pa.array(columns[4], pa.binary()),
        })

    def sum_up(table):
        rows = table.to_pylist()
        head = next(r for r in rows if r["doc_ids"] is not None)
        total = np.zeros(head["docs"], np.int64)
        for r in rows:
            total[: r["docs"]] += np.frombuffer(r["sums"], np.int64)
        names = opened(head["doc_ids"], 2 * head["docs"], np.int64)
        tokens = np.frombuffer(head["tokens"], np.int64)
        none = tokens == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = total / UNIT / tokens
        return pa.table({
            "doc_id": pa.array(names[: head["docs"]], mask=names[head["docs"] :] == 1), "n_tokens": pa.array(tokens),
            "log_score": pa.array(total / UNIT, mask=none), "mean_log_score": pa.array(mean, mask=none),
        })

    partial = packed.groupBy("part").applyInArrow(count_and_score, "block long, docs int, doc_ids binary, sums binary, tokens binary")
    return partial.groupBy("block").applyInArrow(sum_up, "doc_id long, n_tokens long, log_score double, mean_log_score double")
