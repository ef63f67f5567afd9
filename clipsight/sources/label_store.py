"""A label store that is written in deltas and merged when it is read.

Paths are dealt to hash buckets.  A bucket has a base file and deltas on top of it; an
update writes only its own rows, and of the store it reads only the paths of the buckets
it touches.  ``compact`` folds deltas into a new base, bucket by bucket.

Every bucket has versions of its own: entry ``versions/bucket-B/N`` names the files that
make up version N and is created exclusively, so of two writers that build on the same
version of a bucket the second is refused, while writers of different buckets do not
meet.  Files come before the entry that names them; a reader sees a bucket before or
after an update, never half of one.  An update of several buckets that is refused in one
of them can be given again: its rows then overwrite themselves.

Rows are those of ``review.upsert_labels``: every stored row of an updated path is
overwritten in place, and a new path is appended behind the highest row of the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsight.operators.review import LABEL_COLUMNS
from clipsight.operators.skew import lookup_join
from clipsight.sources.writers import StoreChanged

BUCKETS = 256
_ROW = "row_no long, rel_path string, " + ", ".join(f"{c} string" for c in LABEL_COLUMNS)
#: A delta's row: the number it has if the path was new then (else null), the bucket's version it makes.
_DELTA = f"{_ROW}, version long"


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


class LabelStore:
    """The store below ``folder``; ``buckets`` is fixed when the folder is first written."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.system = _system(spark, self.folder)
        entry = f"{self.folder}/buckets"
        if not self.system.exists(_path(spark, entry)):
            self._create(entry, str(buckets))
        self.buckets = int(self._read(entry))

    def _create(self, name: str, text: str) -> bool:
        """Create a small file that must not be there yet; says whether it was this call that did."""
        try:
            out = self.system.create(_path(self.spark, name), False)
        except Exception:  # noqa: BLE001 - file systems differ in what they raise
            if self.system.exists(_path(self.spark, name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, name: str) -> str:
        stream = self.system.open(_path(self.spark, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("rel_path"), F.lit(self.buckets)).cast("int").alias("bucket")

    def versions(self) -> dict[int, dict]:
        """The newest entry of every bucket that was ever written: version, base, deltas, highest row."""
        top = _path(self.spark, f"{self.folder}/versions")
        if not self.system.exists(top):
            return {}
        found = {}
        for bucket in self.system.listStatus(top):
            newest = max(int(x.getPath().getName()) for x in self.system.listStatus(bucket.getPath()))
            entry = json.loads(self._read(f"{bucket.getPath().toString()}/{newest:09d}"))
            found[int(bucket.getPath().getName().removeprefix("bucket-"))] = entry | {"version": newest}
        return found

    def _commit(self, bucket: int, version: int, entry: dict) -> None:
        if not self._create(f"{self.folder}/versions/bucket-{bucket}/{version:09d}", json.dumps(entry)):
            raise StoreChanged(f"version {version} of bucket {bucket} below {self.folder} exists already")

    def _files(self, names: Iterable[str], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{n}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self, buckets: Iterable[int] | None = None, known: dict[int, dict] | None = None) -> DataFrame:
        """The rows as they are now, of all buckets or of some."""
        known = self.versions() if known is None else known
        chosen = [e for b, e in known.items() if buckets is None or b in set(buckets)]
        base = self._files([e["base"] for e in chosen if e["base"]], _ROW)
        deltas = self._files([d for e in chosen for d in e["deltas"]], _DELTA)
        latest = deltas.groupBy("rel_path").agg(F.max_by(F.struct(*LABEL_COLUMNS), "version").alias("u"), F.min("row_no").alias("appended"))
        # A path that was new in a delta is not in the base below it.
        new = latest.filter("appended is not null").select(F.col("appended").alias("row_no"), "rel_path", "u.*")
        met = lookup_join(base, latest.drop("appended"), ["rel_path"])
        over = lambda c: F.when(F.col("u").isNull(), F.col(c)).otherwise(F.col(f"u.{c}")).alias(c)
        return met.select("row_no", "rel_path", *[over(c) for c in LABEL_COLUMNS]).unionByName(new)

    def _write(self, rows: DataFrame, kind: str) -> dict[int, str]:
        """Write rows that have ``bucket`` in one job; the folder of every bucket that has rows."""
        name = f"data/{kind}-{uuid.uuid4().hex}"
        # Rows of a bucket meet in one file per task at most; AQE splits what is too large.
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        found = self.system.listStatus(_path(self.spark, f"{self.folder}/{name}"))
        folders = [x.getPath().getName() for x in found if x.getPath().getName().startswith("bucket=")]
        return {int(x.removeprefix("bucket=")): f"{name}/{x}" for x in folders}

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` (row_no, rel_path, label columns) the whole content; for the first load."""
        known = self.versions()
        written = self._write(rows.select("row_no", "rel_path", *LABEL_COLUMNS, self._bucket()), "base")
        highest = dict(self._highest(written))
        for bucket in written.keys() | known.keys():
            version = known.get(bucket, {"version": 0})["version"] + 1
            self._commit(bucket, version, {"base": written.get(bucket), "deltas": [], "highest": highest.get(bucket, -1)})

    def _highest(self, written: dict[int, str]) -> list[tuple[int, int]]:
        """Highest row of every written bucket: at most one row per bucket comes back."""
        rows = self._files(written.values(), _ROW).groupBy(self._bucket()).agg(F.max("row_no").alias("n"))
        return [(r.bucket, -1 if r.n is None else r.n) for r in rows.collect()]

    def update(self, updates: DataFrame) -> list[int]:
        """Apply updates (``seq``, ``rel_path``, label columns); the buckets written.

        Several updates of one path: the last ``seq`` counts, placed where the first
        one was appended.
        """
        known = self.versions()
        start = max((e["highest"] for e in known.values()), default=-1) + 1
        values = F.struct(*[F.col(c).cast("string").alias(c) for c in LABEL_COLUMNS])
        latest = updates.groupBy("rel_path").agg(F.max_by(values, "seq").alias("u"), F.min("seq").alias("first_seq")).withColumn("bucket", self._bucket())
        # At most one row per bucket.
        touched = [r.bucket for r in latest.select("bucket").distinct().collect()]
        if not touched:
            return []
        there = self.current(touched, known).select("rel_path").distinct().withColumn("stored", F.lit(True))
        number = F.when(F.col("stored").isNull(), F.col("first_seq").cast("long") + F.lit(start))
        after = F.create_map(*[F.lit(x) for b in touched for x in (b, known.get(b, {"version": 0})["version"] + 1)])
        delta = latest.join(there, "rel_path", "left").select(
            number.alias("row_no"), "rel_path", "u.*", after[F.col("bucket")].cast("long").alias("version"), "bucket")
        written = self._write(delta, "delta")
        highest = dict(self._highest(written))
        for bucket, name in sorted(written.items()):
            entry = known.get(bucket, {"version": 0, "base": None, "deltas": [], "highest": -1})
            top = max(entry["highest"], highest.get(bucket, -1))
            self._commit(bucket, entry["version"] + 1, {"base": entry["base"], "deltas": [*entry["deltas"], name], "highest": top})
        return sorted(written)

    def compact(self, deltas: int = 4) -> list[int]:
        """Fold the deltas of buckets that have at least so many into new bases; the buckets written."""
        known = self.versions()
        due = {b for b, e in known.items() if len(e["deltas"]) >= deltas}
        if not due:
            return []
        written = self._write(self.current(due, known).withColumn("bucket", self._bucket()), "base")
        for bucket in sorted(due):
            entry = known[bucket]
            self._commit(bucket, entry["version"] + 1, {"base": written.get(bucket), "deltas": [], "highest": entry["highest"]})
        return sorted(due)
