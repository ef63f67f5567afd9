"""Row-wise enrichment by a caller's function, and frame sampling."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Thread

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(
    rows: DataFrame,
    key: str,
    column: str,
    fn: Callable[[str], str],
    *,
    keep: Sequence[str] = (),
    partitions: int | None = None,
    max_retries: int = 0,
    base_delay_s: float = 1.0,
    timeout_s: float | None = None,
    absent: str | None = None,
    concurrency: int = 1,
    journal: str | None = None,
) -> DataFrame:
    """``(key, *keep, output, error, tries, elapsed_s)``: one row per input, whatever happens.

    ``fn`` runs inside the tasks (for a model: its client call).  A row that
    still fails after its retries becomes an error row and the others go on.
    Retries wait ``base_delay_s`` doubled each time, or as long as the error's
    ``retry_after`` says, and up to half as long again, so that tasks do not come back
    together; ``timeout_s`` bounds one try.  A task makes ``concurrency`` calls at a time.
    With ``absent``, a null input is not sent to ``fn`` but becomes an error row of
    that text, without a try.  ``partitions`` spreads a small table of slow calls over that many tasks.

    Key and kept columns are passed on as they came, never through Python.  The plan is
    lazy and a lost task starts again; with ``journal``, a folder that all executors
    reach, answers are written there as they come and a row that has one is not sent
    again, whichever task or later run asks.  Without it, store the result
    (``writers.stored``) before using it more than once.
    """
    carried = [key, *keep]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried]

    def attempt(value: str) -> str:
        if timeout_s is None:
            return fn(value)
        # A try of its own thread: one that hangs keeps that thread and no later row waits for it.
        answer: Future = Future()

        def call() -> None:
            try:
                answer.set_result(fn(value))
            except BaseException as exc:  # noqa: BLE001 - handed to the waiting side
                answer.set_exception(exc)

        Thread(target=call, daemon=True).start()
        return answer.result(timeout=timeout_s)

    def one(value: str) -> tuple:
        if absent is not None and value is None:
            return None, absent, 0, 0.0
        started = time.perf_counter()
        for tries in range(1, max_retries + 2):
            try:
                return attempt(value), None, tries, time.perf_counter() - started
            except Exception as exc:  # noqa: BLE001 - any failure is a result here
                problem = str(exc) or type(exc).__name__
                if tries <= max_retries:
                    hint = getattr(exc, "retry_after", None)
                    wait = base_delay_s * 2 ** (tries - 1) if hint is None else float(hint)
                    time.sleep(wait * random.uniform(1.0, 1.5))
        return None, problem, tries, time.perf_counter() - started

    def answers(values: list) -> Iterator[tuple]:
        if concurrency <= 1:
            yield from map(one, values)
            return
        with ThreadPoolExecutor(concurrency) as pool:
            yield from pool.map(one, values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = None if journal is None else Journal(journal)
        for batch in batches:
            # So many rows at a time that answers reach the journal soon.
            for at in range(0, batch.num_rows, CALLS):
                part = batch.slice(at, CALLS)
                values = part.column(column).to_pylist()
                if notes is None:
                    out = list(answers(values))
                else:
                    marks, buckets = part.column("_mark").to_pylist(), part.column("_bucket").to_pylist()
                    out = [notes.found(b, m) for b, m in zip(buckets, marks)]
                    asked = [k for k, a in enumerate(out) if a is None]
                    for k, answer in zip(asked, answers([values[k] for k in asked])):
                        out[k] = answer
                        if answer[1] is None:
                            notes.add(buckets[k], marks[k], answer)
                    notes.flush()
                types = [pa.string(), pa.string(), pa.int32(), pa.float64()]
                columns = [part.column(c) for c in carried] + [pa.array(list(x), t) for x, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "output", "error", "tries", "elapsed_s"])

    schema = ", ".join([*kinds, "output string", "error string", "tries int", "elapsed_s double"])
    inputs = rows.select(*carried, *([] if column in carried else [column]))
    if journal is not None:
        mark = F.sha2(F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))), 256)
        bucket = F.pmod(F.xxhash64("_mark"), F.lit(JOURNAL_BUCKETS)).cast("int")
        inputs = inputs.withColumn("_mark", mark).withColumn("_bucket", bucket).repartition(partitions or JOURNAL_BUCKETS, "_bucket").sortWithinPartitions("_bucket")
    elif partitions:
        inputs = inputs.repartition(partitions)
    return inputs.mapInArrow(work, schema)


#: Rows of a batch that are asked for before the next are; folders that a journal is dealt to.
CALLS, JOURNAL_BUCKETS = 64, 64


class Journal:
    """Answers below a shared folder, in files of rows by bucket; only one bucket is held at a time."""

    def __init__(self, folder: str):
        self.files, self.root = FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (LocalFileSystem(), folder)
        self.bucket, self.known, self.new = -1, {}, {}

    def _open(self, bucket: int) -> None:
        if bucket == self.bucket:
            return
        self.bucket, self.known = bucket, {}
        where = FileSelector(f"{self.root}/bucket={bucket}", allow_not_found=True)
        for info in self.files.get_file_info(where):
            if info.type == FileType.File and info.base_name.endswith(".jsonl"):
                with self.files.open_input_stream(info.path) as stream:
                    for line in stream.read().decode().splitlines():
                        mark, output, tries, elapsed = json.loads(line)
                        self.known[mark] = (output, None, tries, elapsed)

    def found(self, bucket: int, mark: str) -> tuple | None:
        self._open(bucket)
        return self.known.get(mark)

    def add(self, bucket: int, mark: str, answer: tuple) -> None:
        self.new.setdefault(bucket, []).append((mark, answer[0], answer[2], answer[3]))

    def flush(self) -> None:
        """One new file per bucket, in place under its name only when it is whole."""
        for bucket, lines in self.new.items():
            folder, name = f"{self.root}/bucket={bucket}", uuid.uuid4().hex
            self.files.create_dir(folder, recursive=True)
            with self.files.open_output_stream(f"{folder}/{name}.part") as stream:
                stream.write("".join(json.dumps(x) + "\n" for x in lines).encode())
            self.files.move(f"{folder}/{name}.part", f"{folder}/{name}.jsonl")
            if bucket == self.bucket:
                self.known.update({m: (o, None, t, e) for m, o, t, e in lines})
        self.new = {}


def tally(enriched: DataFrame) -> DataFrame:
    """One row: total, done, failed, and the exit status a batch run would report."""
    return enriched.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("error").isNull()).alias("n_done"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
    ).withColumn("status", (F.col("n_failed") > 0).cast("int"))


def failures(enriched: DataFrame, key: str) -> DataFrame:
    """Failed rows with their whole error text."""
    return enriched.filter("error is not null").select(key, "error")


def with_step(frames: DataFrame, native_fps: str, fps: int) -> DataFrame:
    """Add ``step``: every how many frames one is kept; an absent or zero native rate means ``fps``."""
    rate = F.coalesce(F.nullif(F.col(native_fps).cast("double"), F.lit(0.0)), F.lit(float(fps)))
    return frames.withColumn("step", F.greatest(F.lit(1), F.rint(rate / fps).cast("int")))


def sample_frames(frames: DataFrame, key: str, native_fps: str, fps: int) -> DataFrame:
    """Frames kept when sampling at about ``fps``; an odd number above one loses its last.

    ``frames`` has (key, idx, native_fps) with ``idx`` dense from 0.  The frame
    to drop is known from the highest index, so it is removed by an anti-join on
    (key, idx): no window over a clip, no skew on long clips.
    """
    stepped = with_step(frames, native_fps, fps)
    kept = stepped.filter(F.col("idx") % F.col("step") == 0)
    odd_last = (
        kept.groupBy(key)
        .agg(F.max("idx").alias("idx"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 and _n % 2 = 1")
        .select(key, "idx")
    )
    return kept.join(odd_last, [key, "idx"], "left_anti")


def without_frames(clips: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Clips for which no frame was decoded (an error case)."""
    return clips.join(frames.select(key).distinct(), key, "left_anti").withColumn("error", F.lit("no frames"))
