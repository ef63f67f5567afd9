"""What the operators of this package share: stored tables and byte views of Arrow texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clipsight.session import ensure_checkpoint_dir

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
#: Modulus of the rolling hashes, a Mersenne prime, and a base for each of their two halves.
PRIME = np.uint64((1 << 31) - 1)
BASES = (1_103_515_245, 1_640_531_527)


def work_folder(spark: SparkSession) -> str:
    """A new path below the shared folder named by ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        ensure_checkpoint_dir(spark)
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/clipsight-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe when executors go."""
    path = work_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts together, n + 1 offsets) of an Arrow string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def compressed(text: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", compression_level=3)
    data, offsets = text_views(text)
    raw = memoryview(data)
    return pa.array([codec.compress(raw[a:b], asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())


def decompressed(blobs: pa.Array, sizes: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(b, s, asbytes=True) if s else b"" for b, s in zip(blobs.to_pylist(), sizes.to_pylist())], pa.binary())


def runs_of(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(first, after last) of consecutive texts of about ``size`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def releasing(run: Callable[[Iterator], Iterator], release: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """A task function that gives up what it has remembered when the task ends: workers live on."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**62 as smaller ones of the same residue, below 2**32."""
    return (x & PRIME) + (x >> np.uint64(31))


def residues(x: np.ndarray) -> np.ndarray:
    """The residues of numbers below 2**63."""
    x = folded(folded(x))
    return np.where(x >= PRIME, x - PRIME, x)


def powers(n: int, base: int) -> np.ndarray:
    """The first n powers of a base modulo the prime."""
    out = np.ones(max(n, 1), np.uint32)
    have, step = 1, base % int(PRIME)
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = residues(out[:more].astype(np.uint64) * np.uint64(step))
        have, step = have + more, step * step % int(PRIME)
    return out


class RangeHash:
    """Hashes of ranges of symbols by differences of prefix sums.

    Each half is a polynomial in a base of its own modulo a prime, so no structure of
    a text makes different ranges alike, as powers of two do; two ranges of n symbols
    meet by chance less than (n / 2**31)**2 of the time, of ordinary texts once in 2**62.
    Where equality decides a result the symbols themselves are compared.
    """

    def __init__(self):
        self.up = [np.ones(1, np.uint32) for _ in BASES]
        self.down = [np.ones(1, np.uint32) for _ in BASES]

    def sums(self, *values: np.ndarray) -> list[np.ndarray]:
        """Prefix sums of a text whose symbols have these values (below the prime), one array per half."""
        n = len(values[0])
        if n + 1 > len(self.up[0]):
            self.up = [powers(n + 1, b) for b in BASES]
            self.down = [powers(n + 1, pow(b, -1, int(PRIME))) for b in BASES]
        out = []
        for value, up in zip(values, self.up):
            sums = np.zeros(n + 1, np.uint64)
            product = sums[1:]
            np.multiply(value, up[:n], out=product, dtype=np.uint64)
            high = product >> np.uint64(31)
            product &= PRIME
            product += high
            np.cumsum(product, out=product)
            out.append(sums)
        return out

    @staticmethod
    def joined(halves: list[np.ndarray]) -> np.ndarray:
        return mixed(halves[0] << np.uint64(31) | halves[1])

    def ranges(self, sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.joined([residues(folded(residues(x[ends] - x[starts]) * down[starts])) for x, down in zip(sums, self.down)])


class Rolling(RangeHash):
    """Hashes of ranges of bytes."""

    def __init__(self, seed: int = 7):
        super().__init__()
        self.tables = np.random.default_rng(seed).integers(1, int(PRIME), (len(BASES), 256), dtype=np.uint32)

    def prefix(self, data: np.ndarray) -> list[np.ndarray]:
        return self.sums(*[table[data] for table in self.tables])


class Stretches:
    """Hashes of all byte ranges of one short width, modulo 2**64: to choose places, not to tell texts apart."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table, self.factor = rng.integers(0, 1 << 64, 256, dtype=np.uint64), 0x9E3779B97F4A7C15
        self.up = self.down = np.ones(1, np.uint64)

    def every(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, f, np.uint64)])) for f in (self.factor, pow(self.factor, -1, 1 << 64)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        return mixed((sums[width:] - sums[:-width]) * self.down[: len(sums) - width])


def same_ranges(left: np.ndarray, starts: np.ndarray, ends: np.ndarray, right: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which ranges of ``left`` hold the same symbols as those of ``right``."""
    same = ends - starts == other_ends - others
    rows = np.flatnonzero(same)
    sizes = ends[rows] - starts[rows]
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()))
    differs = left[place + np.repeat(starts[rows] - begin, sizes)] != right[place + np.repeat(others[rows] - begin, sizes)]
    if differs.any():
        same[np.unique(np.repeat(rows, sizes)[differs])] = False
    return same


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every (start, count), one after the other."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    full = counts > 0
    starts, counts = starts[full].astype(np.int64), counts[full].astype(np.int64)
    if not len(starts):
        return out[:0]
    at = np.cumsum(counts) - counts
    out[at[0]] = starts[0]
    out[at[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name
