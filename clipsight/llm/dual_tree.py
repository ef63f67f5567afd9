"""Ranked lexical search of many items over all documents by dual trees.

Every document is a sparse vector with one coordinate per term, ``(10**9 tf) div (1000
tf + 20 m)``, every item one with its terms' weights; a score is their inner product in
whole numbers.  Both sides are put into hierarchies whose nodes hold the greatest value
of every coordinate below them.  The product of an item node and a document node bounds
all scores between them, so a pair of nodes whose bound is below the weakest k-th best
score of the items in it is dropped with all its pairs: exactly, as ties are kept.

1. ``counted`` reads the texts once and stores, per document, its length and how often it
   has the terms of the items.  Term counts over the corpus are sums over that table.
2. A first walk scores, per task and item, only the document leaf with the greatest bound.
   The k-th best of these scores are thresholds that every task starts with.
3. The second walk goes through both hierarchies from the roots, promising pairs first,
   raises the thresholds as it goes and returns at most k rows per task and item, which
   are ranked with a limit before the shuffle.

Items are taken in blocks of at most ``ITEMS`` items and ``TERMS`` different terms (one
item with more is a block of its own), cut by Spark from running sums; a block's terms
are what a task is sent, so what is sent has a bound and the corpus is read once per block.

Defined cases: a null text has no terms; documents without terms count nowhere and items
without terms have no rows.  Documents with the same id, or none, are documents of their
own, and so are item rows; a document without id comes after those it ties with.  Only
scores above 0 are listed.  Empty tables give no rows.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsight.llm.shared import stored, work_folder

#: Bytes of a term (letters, digits and all beyond ASCII), A-Z lower-cased, others blank.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Most items and different terms of a block; documents of a leaf; children of a node.
ITEMS, TERMS, LEAF, CHILDREN = 512, 20_000, 16, 8
#: A tree's bytes of maxima and its coordinates, at most (a single batch of rows may have more coordinates).
TREE_BYTES, TREE_CELLS = 32 << 20, 1_500_000
#: Bytes of a text whose terms are listed at once.
SLICE = 4 << 20
LAST = np.iinfo(np.int64).max


def term_counts(text: bytes | None) -> Counter:
    """How often a text has each term; long texts go slice by slice, cut between terms."""
    if not text:
        return Counter()
    if len(text) <= SLICE:
        return Counter(text.translate(TERM_BYTES).split())
    counts, at = Counter(), 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and TERM_BYTES[text[end]] != 32:
            end += 1
        counts.update(text[at:end].translate(TERM_BYTES).split())
        at = end
    return counts


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for at in range(0, len(column), 64):
        yield from column.slice(at, 64).cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, item_id, block, terms): item rows numbered and dealt to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(term_counts(t)) for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema[id_column].dataType.simpleString()
    plain = items.select(F.col(f"`{id_column}`").alias("item_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    found = stored(plain.mapInArrow(run, f"item_id {kind}, terms array<binary>").filter(F.size("terms") > 0))
    size = F.least(F.size("terms"), F.lit(TERMS)) + F.lit(TERMS // ITEMS)
    whole = found.agg(F.sum(size)).first()[0] or 0
    numbered = stored(found.repartition(1 + int(whole // TERMS)).withColumn("item", F.monotonically_increasing_id()))
    # Running sums per task, over (number, size) rows of about one block.
    task = F.shiftright("item", 33)
    within = Window.partitionBy("task").orderBy("item")
    sums = numbered.select("item", task.alias("task"), size.alias("size")).withColumn("sum", F.sum("size").over(within))
    return numbered.join(sums.select("item", F.struct("task", F.floor(F.col("sum") / TERMS).alias("part")).alias("block")), "item")


def counted(docs: DataFrame, words: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length, and how often it has the given terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, ids, tfs, ends = [], [], [], [], [0]
            for k, text in enumerate(_texts(batch.column("text"))):
                counts = term_counts(text)
                if not counts:
                    continue
                at.append(k)
                sizes.append(counts.total())
                for term in words.keys() & counts.keys():
                    ids.append(words[term])
                    tfs.append(counts[term])
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """Sparse rows in order of likeness, with the greatest value of each coordinate per node.

    ``levels[0]`` are leaves, the last level is the root; a node's children are the
    ``CHILDREN`` consecutive ones a level below.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, count: int, width: int, leaf: int):
        n_leaves = max(1, -(-count // leaf))
        self.leaf, self.rows, self.columns, self.values = leaf, rows, columns, values
        maxima = np.zeros((n_leaves, width))
        if len(rows):
            cell = (rows // leaf) * width + columns
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            maxima.ravel()[cell[order][first]] = np.maximum.reduceat(values[order], first)
        self.levels = [maxima]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), CHILDREN), axis=0))


def likeness(rows: np.ndarray, columns: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """An order of rows in which neighbours share their heaviest terms."""
    keys = np.full((2, count), -1)
    if len(rows):
        order = np.lexsort((-weight, rows))
        place = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
        for k in (0, 1):
            at = order[place == k]
            keys[k, rows[at]] = columns[at]
    return np.lexsort((keys[1], keys[0]))


class Search:
    """Best k documents per item of a block, over document trees that are handed in one after the other."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, k: int, thresholds: np.ndarray | None):
        width = len(weights)
        rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
        columns = np.concatenate(items) if items else np.zeros(0, np.int64)
        # Items whose rarest term is the same stand together.
        order = likeness(rows, columns, weights[columns], len(items))
        place = np.empty(len(items), np.int64)
        place[order] = np.arange(len(items))
        self.order, self.k, self.weights, self.width = order, k, weights, width
        sort = np.argsort(place[rows], kind="stable")
        self.items = Tree(place[rows][sort], columns[sort], weights[columns][sort], len(items), width, 1)
        floor = np.zeros(len(items)) if thresholds is None else thresholds[order].astype(float)
        self.floor = np.maximum(floor, 1.0)  # only scores above 0 are listed
        self.scores = np.zeros((len(items), k))
        self.ids = np.full((len(items), k), LAST)
        self.none = np.ones((len(items), k), bool)
        self.nodes = self.scored = 0

    def least(self) -> np.ndarray:
        """The weakest score that can still enter, per item."""
        return np.maximum(self.floor, self.scores[:, -1])

    def tree(self, terms: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[Tree, np.ndarray]:
        count = len(ends) - 1
        rows = np.repeat(np.arange(count), np.diff(ends))
        order = likeness(rows, terms, values * self.weights[terms], count)
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        sort = np.argsort(place[rows], kind="stable")
        return Tree(place[rows][sort], terms[sort], values[sort], count, self.width, LEAF), order

    def _score(self, docs: Tree, leaf: int, asked: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Exact scores of a leaf's documents for some items, merged into their best."""
        lo, hi = np.searchsorted(docs.rows, [leaf * LEAF, (leaf + 1) * LEAF])
        used, column = np.unique(docs.columns[lo:hi], return_inverse=True)
        count = min(LEAF, len(ids) - leaf * LEAF)
        dense = np.zeros((count, len(used)))
        dense[docs.rows[lo:hi] - leaf * LEAF, column] = docs.values[lo:hi]
        scores = self.items.levels[0][np.ix_(asked, used)] @ dense.T
        self.scored += scores.size
        here = slice(leaf * LEAF, leaf * LEAF + count)
        # Ties with the weakest may enter by their id.
        enter = (scores >= self.least()[asked, None]).any(axis=1)
        asked, scores = asked[enter], scores[enter]
        if not len(asked):
            return
        all_scores = np.concatenate([self.scores[asked], scores], axis=1)
        all_ids = np.concatenate([self.ids[asked], np.broadcast_to(ids[here], scores.shape)], axis=1)
        all_none = np.concatenate([self.none[asked], np.broadcast_to(none[here], scores.shape)], axis=1)
        best = np.lexsort((all_ids, all_none, -all_scores), axis=1)[:, : self.k]
        self.scores[asked] = np.take_along_axis(all_scores, best, 1)
        self.ids[asked] = np.take_along_axis(all_ids, best, 1)
        self.none[asked] = np.take_along_axis(all_none, best, 1)

    def best_leaves(self, docs: Tree, ids: np.ndarray, none: np.ndarray) -> None:
        """For every item only the leaf with the greatest bound."""
        bounds = self.items.levels[0] @ docs.levels[0].T
        best = bounds.argmax(axis=1)
        for leaf in np.unique(best):
            self._score(docs, int(leaf), np.flatnonzero(best == leaf), ids, none)

    def walk(self, docs: Tree, ids: np.ndarray, none: np.ndarray) -> None:
        """From the pair of roots down to item and document leaves, dropping pairs by their bounds."""
        up, down = len(self.items.levels) - 1, len(docs.levels) - 1
        alive = np.ones((1, 1), bool)
        least = self._least_of_nodes()
        while True:
            left, right = self.items.levels[up], docs.levels[down]
            rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            bounds = left[rows] @ right[columns].T
            self.nodes += int(alive[np.ix_(rows, columns)].sum())
            alive[np.ix_(rows, columns)] &= bounds >= least[up][rows, None]
            if up == 0 and down == 0:
                break
            if up:
                up -= 1
                alive = np.repeat(alive, CHILDREN, axis=0)[: len(self.items.levels[up])]
            if down:
                down -= 1
                alive = np.repeat(alive, CHILDREN, axis=1)[:, : len(docs.levels[down])]
        whole = np.zeros(alive.shape)
        whole[np.ix_(rows, columns)] = bounds
        reach = np.where(alive, whole - self.least()[:, None], -1).max(axis=0)
        for leaf in np.argsort(-reach, kind="stable"):
            # The thresholds have risen since: what no longer reaches them goes.
            asked = np.flatnonzero(alive[:, leaf] & (whole[:, leaf] >= self.least()))
            if len(asked):
                self._score(docs, int(leaf), asked, ids, none)

    def _least_of_nodes(self) -> list[np.ndarray]:
        levels = [self.least()]
        while len(levels[-1]) > 1:
            levels.append(np.minimum.reduceat(levels[-1], np.arange(0, len(levels[-1]), CHILDREN)))
        return levels

    def found(self, limit: int) -> pa.RecordBatch:
        """(item, doc_id, score) of all places that are filled."""
        full = (self.scores >= self.floor[:, None]) & (np.arange(self.k) < limit)
        at, _ = np.nonzero(full)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.order[at].astype(np.int32)),
                pa.array(self.ids[full], pa.int64(), mask=self.none[full]),
                pa.array(self.scores[full].astype(np.int64)),
            ],
            ["item", "doc_id", "score"],
        )


def searcher(items: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, k: int, thresholds: np.ndarray | None, seeds: int | None = None) -> Callable:
    """The task function of a walk: documents are gathered into trees of bounded size.

    With ``seeds`` only the most promising leaves are scored, for so many rows an item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, weights, k, thresholds)
        most = max(LEAF, TREE_BYTES // (8 * len(weights)) * LEAF * (CHILDREN - 1) // CHILDREN)
        held: list[pa.RecordBatch] = []

        def climb() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            n = table.column("n").to_numpy()
            m = 50 + (50 * n * n_docs) // length
            terms, tfs = (table.column(c).chunk(0) for c in ("terms", "tfs"))
            ends = terms.offsets.to_numpy().astype(np.int64)
            columns = terms.flatten().to_numpy().astype(np.int64)
            tf = tfs.flatten().to_numpy().astype(np.int64)
            value = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(ends)))
            docs, order = search.tree(columns, ends - ends[0], value.astype(float))
            number = table.column("doc_id").chunk(0)
            none = np.asarray(number.is_null().to_numpy(zero_copy_only=False))[order]
            ids = number.fill_null(LAST).to_numpy()[order]
            (search.walk if seeds is None else search.best_leaves)(docs, ids, none)

        rows = cells = 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                more = pc.sum(pc.list_value_length(piece.column("terms"))).as_py()
                if held and (rows + piece.num_rows > most or cells + more > TREE_CELLS):
                    climb()
                    rows = cells = 0
                held.append(piece)
                rows, cells = rows + piece.num_rows, cells + more
        if held:
            climb()
        yield search.found(k if seeds is None else seeds)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    asked = stored(item_terms(items, item_column, item_text))
    blocks = [r.block for r in asked.select("block").distinct().sort("block").toLocalIterator()]
    spark, kind = docs.sparkSession, items.schema[item_column].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    if not blocks:
        return spark.createDataFrame([], schema)
    parts = (_block(docs, asked.filter((F.col("block.task") == b.task) & (F.col("block.part") == b.part)), k, doc_column, text_column) for b in blocks)
    if len(blocks) == 1:
        return next(parts)
    folder = work_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _block(docs: DataFrame, items: DataFrame, k: int, doc_column: str, text_column: str) -> DataFrame:
    """One block: its items (at most ITEMS, at most TERMS terms, or a single one) are what tasks are sent."""
    rows = items.select("item", "item_id", "terms").sort("item").collect()
    words = {t: n for n, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    vectors = [np.array(sorted(words[bytes(t)] for t in r.terms), np.int64) for r in rows]
    vector_of = stored(counted(docs, words, doc_column, text_column))
    total = vector_of.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("length")).first()
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], items.select(F.lit(0).alias("item"), "item_id").schema)
    if not total.n:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    # One row per term of the block.
    df = np.zeros(len(words), np.int64)
    for r in vector_of.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * d + 1))) for d in df.tolist()], float)
    result = "item int, doc_id long, score long"
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = Window.partitionBy("item").orderBy(*order)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    tasks = vector_of.rdd.getNumPartitions()
    few = min(k, 4 + -(-2 * k // tasks))
    seeds = vector_of.mapInArrow(searcher(vectors, weights, total.n, total.length, k, None, few), result)
    floors = np.zeros(len(rows), np.int64)
    for r in ranked(seeds).filter(F.col("rank") == k).select("item", "score").collect():
        floors[r.item] = r.score
    walked = vector_of.mapInArrow(searcher(vectors, weights, total.n, total.length, k, floors), result)
    return ranked(walked).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
