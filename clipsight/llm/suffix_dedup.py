"""Removal of repeated passages by sorted suffixes.

A byte goes if a string of ``WINDOW`` bytes over it also starts elsewhere.  Not all
suffixes are sorted: every window names one place in it, its anchor (the least hash
of its ``GRAM``-byte stretches, leftmost of equals).  The choice depends on the
window's own bytes only, so equal windows have anchors at the same offset, and the
suffixes at anchors are enough.

1. Stretches at anchors are counted by hash; those found only once end here.
2. Of every text with a stretch found twice, the zones of those anchors (all windows
   that name the anchor, one string) are range-partitioned by the leading tokens of
   the anchor's suffix, with sampled splitters.  Equal zones of a batch go once.
3. A bucket sorts the windows of its zones by multikey quicksort on words of eight
   bytes and compares neighbours.  Range borders lie between different leading
   tokens; within a bucket, which is read in order, a group that is still open at
   the end of a batch is carried into the next.  A stretch found very often is split
   by the offset of its windows, so its parts may lie in different buckets.
4. The verdict of a distinct zone goes back to the places where it occurs.

Equal texts are one text with copies, and wholly removed if long enough.  Windows are
compared word by word; that two texts or two zones are the same is told by 64-bit hashes
of them (of texts by ``xxhash64``, of zones by ``shared.RangeHash``).

Defined cases: a null text is empty; rows that repeat a document count as copies of
it; a null identifier is kept; a text shorter than the window is left as it is.
Empty tables give no rows.  Texts are cut as bytes; where a cut goes through a
character, ``deduplicated`` drops the broken character.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.llm.shared import Rolling, Stretches, compressed, decompressed, fresh_name, mixed, ragged, runs_of, stored, text_views

#: Bytes of a repeated string, and of the stretch at an anchor.
WINDOW, GRAM = 200, 64
#: Window starts handled at once; zone bytes sorted at once; anchors of one stretch in one group.
STRIDE, SORTED, GROUP = 1 << 19, 4 << 20, 50_000
#: Windows that an anchor can have, and bytes of their bitmap.
SPAN = WINDOW - GRAM + 1
BITMAP = -(-SPAN // 8)

_ROLLING, _STRETCHES = Rolling(13), Stretches(13)
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window start, last window start, anchor, stretch hash) of all zones, in order."""
    found = []
    for at in range(0, max(0, len(data) - WINDOW + 1), STRIDE):
        part = data[at : at + STRIDE + WINDOW - 1]
        grams = _STRETCHES.every(part, GRAM)
        keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # of equals the leftmost is least
        pad = np.full(-len(keys) % SPAN, ~np.uint64(0))
        rows = np.concatenate([keys, pad]).reshape(-1, SPAN)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - WINDOW + 1
        anchor = (np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & _LOW).astype(np.int64)
        start = np.arange(n)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, at, at + n)))
        inside = start + at + WINDOW <= offsets[1:][text]
        start, anchor, text = start[inside], anchor[inside], text[inside]
        first = np.ones(len(start), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(start)) - 1
        if len(first):
            a = anchor[first]
            found.append((text[first], start[first] + at, start[last] + at, a + at, grams[a]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_views(column)
    for i, j in runs_of(offsets, STRIDE):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def tagged(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def stretches(rows: DataFrame) -> DataFrame:
    """(gram, tag, twice) of every text's stretches at anchors; ``twice`` if the text has it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(0).to_numpy()
            for i, j, data, offsets in slices(batch.column(1)):
                text, _, _, anchor, gram = anchors(data, offsets)
                # A zone cut by the stride has one anchor in two zones.
                once = np.ones(len(anchor), bool)
                once[1:] = anchor[1:] != anchor[:-1]
                text, gram = text[once], gram[once]
                order = np.argsort(gram)
                order = order[np.argsort(text[order], kind="stable")]
                text, gram = text[order], gram[order]
                first = np.ones(len(gram), bool)
                first[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(first)
                twice = np.diff(np.append(at, len(gram))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64)), pa.array(tags[i:j][text[at]]), pa.array(twice)], names=["gram", "tag", "twice"])

    return rows.filter(F.octet_length("text") >= WINDOW).select("tag", "text").mapInArrow(run, "gram long, tag long, twice boolean")


def zones(data: np.ndarray, offsets: np.ndarray, wanted: list, parts: list) -> tuple[np.ndarray, ...]:
    """Zones whose stretch is wanted: (text, first start, windows, anchor, gram, sub, zone hash).

    A stretch with ``parts`` > 1 has its windows split by their offset into as many zones.
    """
    text, low, high, anchor, gram = anchors(data, offsets)
    keep = np.zeros(len(text), bool)
    many = np.ones(len(text), np.int64)
    begins = np.searchsorted(text, np.arange(len(offsets)))
    for d in range(len(offsets) - 1):
        here = slice(begins[d], begins[d + 1])
        if wanted[d] is None or here.start == here.stop:
            continue
        known = np.array(wanted[d], np.int64).view(np.uint64)
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], gram[here]), len(known) - 1)
        keep[here] = known[order][at] == gram[here]
        many[here] = np.array(parts[d], np.int64)[order][at]
    text, low, high, anchor, gram, many = (x[keep] for x in (text, low, high, anchor, gram, many))
    sub = np.zeros(len(text), np.int64)
    if len(many) and many.max() > 1:
        size = -(-SPAN // many)  # offsets in a part
        first, last = (anchor - high) // size, (anchor - low) // size
        n = last - first + 1
        text, low, high, anchor, gram, size = (np.repeat(x, n) for x in (text, low, high, anchor, gram, size))
        sub = ragged(first, n)
        low, high = np.maximum(low, anchor - (sub + 1) * size + 1), np.minimum(high, anchor - sub * size)
    sums = _ROLLING.prefix(data)
    name = _ROLLING.ranges(sums, low, high + WINDOW)
    name = mixed(name + gram + ((anchor - low) * 1024 + high - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, low, high - low + 1, anchor, gram, sub, name


ZONES = "lead long, gram long, sub int, zone long, before int, windows int, times long, body binary"


def zone_rows(texts: DataFrame) -> DataFrame:
    """Distinct zones of each batch: leading tokens, stretch, part, name, place of the anchor, windows, times found, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = decompressed(batch.column(1), batch.column(2))
            wanted, parts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, j, data, offsets in slices(raw):
                _, low, windows, anchor, gram, sub, name = zones(data, offsets, wanted[i:j], parts[i:j])
                if not len(low):
                    continue
                _, first, times = np.unique(name, return_index=True, return_counts=True)
                low, windows, anchor, gram, sub, name = (x[first] for x in (low, windows, anchor, gram, sub, name))
                size = windows + WINDOW - 1
                body = pa.Array.from_buffers(
                    pa.binary(), len(low),
                    [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data[ragged(low, size)])],
                )
                lead = words_view(data)[anchor].astype(np.uint64) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead.view(np.int64)), pa.array(gram.view(np.int64)), pa.array(sub.astype(np.int32)), pa.array(name.view(np.int64)),
                     pa.array((anchor - low).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(times), body],
                    names=[x.split()[0] for x in ZONES.split(", ")],
                )

    return texts.select("tag", "blob", "size", "grams", "parts").mapInArrow(run, ZONES)


def words_view(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number in byte order."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the windows at ``starts`` equal another of their group: multikey quicksort, word by word.

    Windows are kept in runs of those equal so far; each word splits the runs that it
    tells apart, and runs of one window drop out.
    """
    view = words_view(data)
    who = np.argsort(group, kind="stable")
    run = group[who]
    for depth in range(WINDOW // 8):
        begin = np.ones(len(run), bool)
        begin[1:] = run[1:] != run[:-1]
        at = np.flatnonzero(begin)
        sizes = np.diff(np.append(at, len(run)))
        many = np.repeat(sizes > 1, sizes)
        if not many.all():
            who, run = who[many], run[many]
            begin = np.ones(len(run), bool)
            begin[1:] = run[1:] != run[:-1]
            at = np.flatnonzero(begin)
            sizes = np.diff(np.append(at, len(run)))
        if not len(who):
            break
        word = view[starts[who] + 8 * depth].astype(np.uint64)
        differs = word != np.repeat(word[at], sizes)
        split = np.repeat(np.logical_or.reduceat(differs, at), sizes)
        run = np.cumsum(begin)  # numbers of the runs, in order
        if split.any():
            rows = np.flatnonzero(split)
            order = rows[np.lexsort((word[rows], run[rows]))]
            who[rows], word[rows] = who[order], word[order]
            fresh = begin.copy()
            fresh[1:] |= (word[1:] != word[:-1]) & split[1:]
            run = np.cumsum(fresh)
    else:
        sizes = np.bincount(run)
        who = who[sizes[run] > 1]
    out = np.zeros(len(starts), bool)
    out[who] = True
    return out


def judged(table: pa.Table) -> pa.RecordBatch:
    """(zone, bitmap of repeated windows) of the zones of whole groups; zones without any are left out."""
    gram, sub, zone, before, windows, times = (table.column(k).to_numpy() for k in ("gram", "sub", "zone", "before", "windows", "times"))
    names, first, where = np.unique(zone, return_index=True, return_inverse=True)
    times = np.bincount(where, weights=times).astype(np.int64)
    table = table.take(pa.array(first))
    data, offsets = text_views(table.column("body"))
    gram, sub, before, windows = gram[first], sub[first], before[first].astype(np.int64), windows[first].astype(np.int64)
    at = np.repeat(np.arange(len(names)), windows)
    number = ragged(np.zeros(len(names), np.int64), windows)
    offset = before[at] - number  # of the anchor in the window
    _, stretch = np.unique(gram, return_inverse=True)
    again = repeated(data, offsets[:-1][at] + number, stretch[at] * SPAN + offset)
    again |= (times > 1)[at]
    bits = np.zeros((len(names), 8 * BITMAP), bool)
    bits[at, number] = again
    keep = np.flatnonzero(bits.any(axis=1))
    packed = np.packbits(bits[keep], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array([x.tobytes() for x in packed], pa.binary())], names=["zone", "again"])


def verdicts(zone_table: DataFrame) -> DataFrame:
    """(zone, again) for every distinct zone with a repeated window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < SORTED:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            gram, sub = table.column("gram").to_numpy(), table.column("sub").to_numpy()
            other = np.flatnonzero((gram != gram[-1]) | (sub != sub[-1]))
            closed = int(other[-1]) + 1 if len(other) else 0  # the rows behind belong to a group that may go on
            if closed:
                yield judged(table.slice(0, closed))
                rest = table.slice(closed)
                held, size = rest.to_batches(), rest.nbytes
        if held and sum(len(b) for b in held):
            yield judged(pa.Table.from_batches(held).combine_chunks())

    n = int(zone_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = zone_table.repartitionByRange(n, "lead", "gram", "sub").sortWithinPartitions("lead", "gram", "sub")
    return ranged.mapInArrow(run, "zone long, again binary")


def places(texts: DataFrame) -> DataFrame:
    """(tag, zone, place): where in which text every zone lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, raw = batch.column(0).to_numpy(), decompressed(batch.column(1), batch.column(2))
            wanted, parts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, j, data, offsets in slices(raw):
                text, low, _, _, _, _, name = zones(data, offsets, wanted[i:j], parts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tags[i:j][text]), pa.array(name.view(np.int64)), pa.array(low - offsets[text])], names=["tag", "zone", "place"]
                )

    return texts.select("tag", "blob", "size", "grams", "parts").mapInArrow(run, "tag long, zone long, place long")


def cut_texts(marked: DataFrame) -> DataFrame:
    """(tag, n_removed, n_spans, kept) from texts and the repeated windows in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            raw = decompressed(batch.column(1), batch.column(2))
            removed, spans, kept = [], [], []
            for text, size, found in zip(raw, sizes, batch.column(3)):
                flat = found.values
                place = flat.field("place").to_numpy()
                bits = np.unpackbits(np.frombuffer(b"".join(flat.field("again").to_pylist()), np.uint8).reshape(-1, BITMAP), axis=1)
                rows, at = np.nonzero(bits)
                starts = place[rows] + at
                edge = np.zeros(size + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(np.frombuffer(text.as_buffer(), np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["tag", "n_removed", "n_spans", "kept"]
            )

    return marked.select("tag", "blob", "size", "found").mapInArrow(run, "tag long, n_removed long, n_spans long, kept binary")


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(tag, n_removed, n_spans, kept) of every distinct text that loses bytes; ``tag`` is a hash of the text."""
    rows = tagged(docs, id_column, text_column)
    copies = stored(
        rows.select("tag", "doc_id", F.octet_length("text").alias("size"))
        .groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.first("size").alias("size"))
    )
    found = stretches(rows)
    counts = found.groupBy("gram").agg(F.min("tag").alias("least"), F.max("tag").alias("most"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("n"))
    shared = counts.filter("least <> most or twice").select("gram", F.least(F.lit(SPAN), F.ceil(F.col("n") / GROUP)).cast("int").alias("parts"))
    by_text = found.select("gram", "tag").join(shared, "gram").groupBy("tag").agg(F.collect_set(F.struct("gram", "parts")).alias("s"))
    wanted = by_text.join(copies, "tag").select("tag", F.col("first").alias("doc_id"), F.col("s.gram").alias("grams"), F.col("s.parts").alias("parts"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), compressed(batch.column(2)), pa.compute.binary_length(batch.column(2)).cast(pa.int64())], names=["doc_id", "tag", "blob", "size"]
            )

    small = rows.filter(F.octet_length("text") >= WINDOW).mapInArrow(shrink, "doc_id long, tag long, blob binary, size long")
    match = (F.col("w.tag") == F.col("d.tag")) & F.col("w.doc_id").eqNullSafe(F.col("d.doc_id"))
    texts = stored(small.alias("d").join(wanted.alias("w"), match).select("w.tag", "blob", "size", "grams", "parts"))

    again = verdicts(zone_rows(texts))
    found_at = places(texts).join(again, "zone").groupBy("tag").agg(F.collect_list(F.struct("place", "again")).alias("found"))
    # A text with copies goes as a whole.
    alone = found_at.join(copies.filter("n = 1").select("tag"), "tag", "left_semi")
    cut = cut_texts(texts.select("tag", "blob", "size").join(alone, "tag"))
    whole = copies.filter(f"n > 1 and size >= {WINDOW}").select(
        "tag", F.col("size").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.encode(F.lit(""), "UTF-8").alias("kept")
    )
    return whole.unionByName(cut)


def removed_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    changed = removals(docs, id_column, text_column).select(F.col("tag").alias("t"), "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    rows = tagged(docs, id_column, text_column)
    rows = rows.select("doc_id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("own"))
    joined = rows.join(changed, F.col("tag") == F.col("t"), "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the text that is left."""
    changed = removals(docs, id_column, text_column)
    tag, kept, new = (fresh_name(docs, x) for x in ("tag", "kept", "new"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[tag, kept])

    changed = changed.select("tag", "kept").mapInArrow(decode, f"`{tag}` long, `{kept}` string")
    text = F.col(f"`{text_column}`")
    rows = docs.withColumn(new, F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    joined = rows.join(changed, F.col(new) == F.col(tag), "left")
    return joined.select(*[F.coalesce(F.col(kept), text).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])
