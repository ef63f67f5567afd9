"""Near-duplicate groups by one-permutation hashing, checked on whole shingle sets.

One hash of every five-word shingle serves all bins of a signature: the highest
part of the hash names the bin, the least hash of a bin is its value.  An empty bin
borrows from other bins in an order of its own (optimal densification).  Bands of
bins make buckets.  Documents with equal sets are one node from then on.

Candidate links are stars: every node asks only the first node of a bucket, first
the first one over all its buckets, then the remaining ones of buckets that still
hold several groups.  What stars cannot decide (a bucket whose nodes are still in
different groups) is compared in blocks of bounded size, inside the tasks: pairs
that the signatures do not rule out are compared in full, and only the links that
join groups leave a task.  Every link is confirmed on the full sets of shingle hashes (of 62 bits, see
``shared.RangeHash``), so a false link stays only where hashes meet; a true one is missed
if all its bands differ (at a similarity of exactly 0.75 once in four million).

Defined cases: a null or empty text, or one of white space, has no set and is linked
with nothing; a document of fewer than five words has the sequence as its only
shingle.  Rows that repeat an identifier are judged by their own texts.  A row
without identifier is linked with nothing, its component is null and it is kept.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clipsight.llm.components import components
from clipsight.llm.fertility import nonzero, window_hashes, word_places
from clipsight.llm.shared import Rolling, compressed, decompressed, fresh_name, mixed, ragged, runs_of, stored, text_views

#: Words of a shingle, least similarity in percent, bins of a signature and bins of a band.
SHINGLE, SIMILAR, BINS, ROWS = 5, 75, 160, 4
#: Texts handled at once (bytes); nodes and bytes of a block when a bucket is compared in blocks.
SLICE, BLOCK, BLOCK_BYTES = 1 << 19, 512, 4 << 20
#: Signatures rule a pair out when they lie this many standard deviations below the similarity.
DEVIATIONS = 6.0

_ROLLING = Rolling(11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(5)
#: The order in which an empty bin asks the others.
_ASKS = np.argsort(_RANDOM.random((BINS, BINS)), axis=1)
_BAND_SEED = _RANDOM.integers(1, 1 << 64, BINS // ROWS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of texts given together, by text and hash."""
    n = len(offsets) - 1
    data = _LOWER[data]
    starts, ends = word_places(data, offsets)
    words = nonzero(_ROLLING.ranges(_ROLLING.prefix(data), starts, ends))
    text = np.searchsorted(offsets, starts, "right") - 1
    hashes, at = window_hashes(words, text, SHINGLE)
    owner = text[at]
    counts = np.bincount(text, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.searchsorted(text, short)
        h = words[first] * np.uint64(3) + counts[short].astype(np.uint64)
        for k in range(1, SHINGLE - 1):
            more = counts[short] > k
            h[more] = mixed(h[more] + words[first[more] + k] * np.uint64(2 * k + 1))
        hashes, owner = np.concatenate([hashes, mixed(h)]), np.concatenate([owner, short])
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashes[new]


def set_hashes(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of every text's set."""
    sizes = np.bincount(owner, minlength=n)
    begin = np.cumsum(sizes) - sizes
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes), dtype=np.uint64)])
    return sizes, mixed(total[begin + sizes] - total[begin] + sizes.astype(np.uint64)).view(np.int64)


def signatures(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Least hash per bin of every text with a set; the hash's order is the bins' order."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros((n, BINS), np.uint64)
    full = np.zeros((n, BINS), bool)
    out[owner[first], bins[first]] = hashes[first]
    full[owner[first], bins[first]] = True
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    for step in range(BINS):
        if not len(rows):
            break
        asked = _ASKS[cols, step]
        got = full[rows, asked]
        out[rows[got], cols[got]] = out[rows[got], asked[got]]
        rows, cols = rows[~got], cols[~got]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), -1, ROWS)
    h = np.broadcast_to(_BAND_SEED, parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mixed(h + parts[:, :, k])
    return h


SETS = "doc_id long, n_shingles long, node long, bands array<long>"


def described(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Set size, a hash of the whole set, and the band keys of every row; no hash without a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            for i, j in runs_of(offsets, SLICE):
                n = j - i
                owner, hashes = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes, node = set_hashes(owner, hashes, n)
                keys = band_keys(signatures(owner, hashes, n)).view(np.int64)
                none = sizes == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(sizes), pa.array(node, mask=none), lists], names=["doc_id", "n_shingles", "node", "bands"]
                )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, SETS)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough; ``texts`` has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [text_views(batch.column(k)) for k in (2, 3)]
            for i, j in runs_of(sides[0][1] + sides[1][1], 2 * SLICE):
                owner, hashes, sizes = [], [], []
                for data, offsets in sides:
                    o, h = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    owner.append(o)
                    hashes.append(h)
                    sizes.append(np.bincount(o, minlength=j - i))
                o, h = np.concatenate(owner), np.concatenate(hashes)
                order = np.argsort(h)
                order = order[np.argsort(o[order], kind="stable")]
                o, h = o[order], h[order]
                common = np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=j - i)
                linked = 100 * common >= SIMILAR * (sizes[0] + sizes[1] - common)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i).filter(pa.array(linked)) for k in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, node, doc) of buckets that hold several groups, with their group."""
    grouped = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = grouped.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    return grouped.join(several.select("bucket"), "bucket")


def met(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, label: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) between nodes of two blocks, enough to join all that are linked.

    A node looks at the nodes of other groups that its signature does not rule out,
    the most similar first.  Groups that a link joins are one from then on, so there
    are fewer links than nodes, and decided pairs are not compared again.
    """
    n = len(sizes)
    begin = np.searchsorted(owner, np.arange(n + 1))
    signed = (mixed(signatures(owner, hashes, n)) >> np.uint64(32)).astype(np.uint32)
    group = np.unique(label, return_inverse=True)[1]
    links = []
    for i in np.flatnonzero(first).tolist():
        own = hashes[begin[i] : begin[i + 1]]
        others = np.flatnonzero(second & (group != group[i]))
        smaller, larger = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others, smaller = (x[100 * smaller >= SIMILAR * larger] for x in (others, smaller))
        equal = (signed[others] == signed[i]).sum(axis=1)
        enough = equal >= BINS * (SIMILAR / 100 - DEVIATIONS * np.sqrt(0.1875 / np.minimum(BINS, smaller)))
        others = others[enough][np.argsort(-equal[enough], kind="stable")]
        while len(others):
            now, others = others[:16], others[16:]
            counts = begin[now + 1] - begin[now]
            theirs = hashes[ragged(begin[now], counts)]
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            common = np.bincount(np.repeat(np.arange(len(now)), counts), weights=own[at] == theirs, minlength=len(now)).astype(np.int64)
            for j in now[100 * common >= SIMILAR * (sizes[i] + sizes[now] - common)].tolist():
                if group[j] != group[i]:
                    links.append((i, j))
                    group[group == group[j]] = group[i]
            others = others[group[others] != group[i]]
    return links


def blockwise(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between nodes of different groups that share a bucket.

    A bucket's nodes are dealt into blocks by hash, and each two blocks meet in a task
    of their own, so a task holds two blocks however large the bucket is; pairs stay
    in the task, and only links that join groups leave it.
    """

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), compressed(batch.column(1)), pa.compute.binary_length(batch.column(1)).cast(pa.int64())], names=["node", "blob", "bytes"])

    def meet(table):
        node, label, block = (table.column(k).to_numpy() for k in ("node", "label", "block"))
        low, high = int(table.column("low")[0].as_py()), int(table.column("high")[0].as_py())
        data, offsets = text_views(decompressed(table.column("blob").combine_chunks(), table.column("bytes").combine_chunks()))
        owner, hashes = shingles(data, offsets)
        links = met(owner, hashes, np.bincount(owner, minlength=len(node)), label, block == low, block == high)
        return pa.table({"a": pa.array([node[i] for i, _ in links], pa.int64()), "b": pa.array([node[j] for _, j in links], pa.int64())})

    weighed = members.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    sizes = weighed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all_bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all_bytes") / BLOCK_BYTES)).cast("int")
    placed = members.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    small = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(shrink, "node long, blob binary, bytes long")
    rows = pairs.join(small, "node").select("bucket", "low", "high", "block", "node", "label", "blob", "bytes")
    return rows.groupBy("bucket", "low", "high").applyInArrow(meet, "a long, b long").distinct()


def linked(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label) of all nodes that have a link: stars first, then blocks where stars leave a bucket open."""
    ask = lambda rows: rows.join(rows.groupBy("bucket").agg(F.min_by("node", F.struct("doc", "node")).alias("first"), F.min("doc").alias("first_doc")), "bucket").filter("node <> first")
    one = ask(members).groupBy("node").agg(F.min(F.struct("first_doc", "first")).alias("best"))
    tried = stored(one.select(F.col("node").alias("a"), F.col("best.first").alias("b")))
    links = stored(confirmed(tried, texts))
    labels = components(links)

    open_ = stored(undecided(members, labels))
    if not open_.isEmpty():
        firsts = ask(open_)
        of_first = labels.select(F.col("node").alias("first"), F.col("label").alias("first_label"))
        firsts = firsts.join(of_first, "first", "left").filter(F.coalesce("first_label", "first") != F.col("label"))
        more = stored(firsts.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        links = stored(links.unionByName(confirmed(more, texts)))
        labels = components(links)
        rest = stored(undecided(members, labels))
        if not rest.isEmpty():
            links = stored(links.unionByName(blockwise(rest, texts)))
            labels = components(links)
    return labels


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_node: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, on request with the hash of its set."""
    rows = stored(described(docs, id_column, text_column))
    nodes = rows.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    banded = nodes.select("node", "doc", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = stored(banded.join(shared, "bucket").select("bucket", "node", "doc"))

    # One row of each node that shares a bucket brings the text.
    wanted = members.groupBy("node").agg(F.min("doc").alias("doc"))
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text"))
    sized = rows.select(F.col("doc_id").alias("doc"), "node").distinct().join(wanted, ["doc", "node"])
    brought = sized.join(source, "doc")
    texts = stored(one_text(brought))
    labels = linked(members, texts)

    least = nodes.select("node", "doc").join(labels, "node").groupBy("label").agg(F.min("doc").alias("component"))
    named = labels.join(least, "label").select("node", "component")
    own = nodes.select("node", "doc").join(named, "node", "left").select("node", F.coalesce("component", "doc").alias("of_node"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("of_node"))
    out = rows.drop("bands").join(own, "node", "left").select("doc_id", "n_shingles", *["node"] * with_node, F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``docs`` per group, with all its columns: that of the smallest identifier.

    Rows that repeat it with the same set are one; rows without identifier or without
    a word all stay.
    """
    found = groups(docs, id_column, text_column, with_node=True)
    name, node = fresh_name(docs, "name"), fresh_name(docs, "node")
    keepers = found.filter("kept and node is not null and doc_id is not null").select(F.col("doc_id").alias(name), F.col("node").alias(node)).distinct()
    at = docs.columns.index(text_column)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(at))
            for i, j in runs_of(offsets, SLICE):
                sizes, hashes = set_hashes(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), j - i)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hashes, mask=sizes == 0)], names=[*part.schema.names, node])

    own = F.col(f"`{id_column}`").cast("long")
    text = F.col(f"`{text_column}`").cast("string")
    apart = own.isNull() | ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.filter(~apart).mapInArrow(mark, StructType([*docs.schema.fields, StructField(node, LongType())]))
    marked = marked.withColumn(name, own)
    one = marked.join(keepers, [name, node], "left_semi").dropDuplicates([name, node])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(apart))


def one_text(brought: DataFrame) -> DataFrame:
    """(node, text): of the rows of an identifier, one whose text has the node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(2))
            for i, j in runs_of(offsets, SLICE):
                n = j - i
                _, node = set_hashes(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n)
                right = pa.array(node == batch.column(1).slice(i, n).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, n).filter(right), batch.column(2).slice(i, n).filter(right)], names=["node", "text"])

    return brought.select("doc", "node", "text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])
