"""WARC archives written and read as a table of record chunks.

Pages become WARC records in text files that Spark writes and reads itself, so any
store Spark knows will do.  A payload of more than ``chunk`` characters becomes
several records (the first one plus ``continuation`` segments): rows of record
identifier and chunk number, so no reader holds more than a chunk of it.  The writer
does: it hashes a whole payload at once and has all its chunks in one row.
Records of one chunk are checked where they are read; for the others a running
SHA-1 is carried from chunk to chunk (``running_digests``).

Files are cut at the line ``WARC/1.1`` behind an empty line.  A payload that holds
these characters is cut into segments in the middle of them, so a cut is never
mistaken.

Defined cases: a null payload is empty; a null url has no target line; control
characters of a url become blanks' escapes; a null identifier is kept as null and
never serves as the origin of a revisit while another identifier has the same
payload.  Repeated rows are records of their own; among rows of equal payload all
that carry the smallest identifier are responses.  An empty table gives an empty
archive.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Characters in a chunk, and records in a file.
CHUNK, RECORDS_PER_FILE = 1 << 16, 50_000


def base32(digest: Column) -> Column:
    """Upper-case base 32 of a SHA-1 given in hexadecimal: eight groups of 20 bits."""
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def chunks(payload: Column, size: int) -> Column:
    """A payload in order, in pieces of at most ``size`` characters none of which holds the version mark."""
    apart = F.split(payload, r"(?<=WA)(?=RC/1\.1)", -1)
    pieces = F.flatten(F.transform(apart, lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))))
    return F.when(F.octet_length(payload) == 0, F.array(F.lit(""))).otherwise(pieces)


def with_origins(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Adds ``origin``: the smallest identifier among the records of the same payload, null for itself."""
    large = F.col("payload_bytes") >= least_bytes
    firsts = (
        pages.filter(large)
        .groupBy("digest", "payload_bytes")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("d"), F.col("payload_bytes").alias("b"), "first")
    )
    joined = pages.join(firsts, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")) & large, "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("origin", F.when(other, F.col("first"))).drop("d", "b", "first")


def line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.concat(F.lit(f"{END}{name}: "), value.cast("string"))


def records(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row ``value`` per record or segment, without the closing empty lines."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    )
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32(F.sha1(F.encode("payload", "UTF-8"))))
    marked = with_origins(base, least_bytes).withColumn("again", F.col("origin").isNotNull()).withColumn("record", F.uuid())
    parts = marked.withColumn("parts", F.when(F.col("again"), F.array(F.lit(""))).otherwise(chunks(F.col("payload"), chunk))).drop("payload")
    rows = parts.select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "piece")).drop("parts")
    first = F.col("at") == 0
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes"), F.lit(END + END))
    rows = rows.withColumn("block", F.when(first, F.concat(http, F.col("piece"))).otherwise(F.col("piece")))
    name = lambda at: F.concat(F.lit("<urn:uuid:"), F.col("record"), F.when(at > 0, F.concat(F.lit("-"), at.cast("string"))).otherwise(F.lit("")), F.lit(">"))
    several = F.col("n") > 1
    header = F.concat_ws(
        "",
        F.lit(VERSION),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("at"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.when(first, F.col("url"))),
        line("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        line("WARC-Segment-Number", F.when(several, F.col("at") + 1)),
        line("WARC-Segment-Origin-ID", F.when(~first, name(F.lit(0)))),
        line("Page-ID", F.when(first, F.col("page_id"))),
        line("Page-Bytes", F.when(first, F.col("payload_bytes"))),
        line("Refers-To-Page-ID", F.when(first, F.col("origin"))),
        line("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        line("Content-Length", F.octet_length("block")),
        F.lit(END + END),
    )
    return rows.select(F.concat(header, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, folder: str, **options) -> None:
    """Write gzip-compressed archives of all pages below ``folder``."""
    (
        records(pages, **options)
        .write.option("lineSep", END + END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(folder)
    )


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every record and segment of the archives: its headers and its piece of the payload."""
    lines = spark.read.option("lineSep", f"{END}{END}{VERSION}{END}").text(folder)
    cut = F.instr("value", END + END)
    split = lines.select(
        F.concat(F.lit(END), F.expr("left(value, instr(value, '\r\n\r\n') - 1)"), F.lit(END)).alias("header"),
        F.expr("substr(value, instr(value, '\r\n\r\n') + 4)").alias("rest"),
        cut.alias("cut"),
    ).filter("cut > 0")
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)", 1), F.lit(""))
    parsed = split.select(
        field("WARC-Type").alias("kind"),
        F.regexp_extract(field("WARC-Record-ID"), "<urn:uuid:([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1).alias("record"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(0)).alias("segment"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("digest"),
        field("Page-ID").cast("long").alias("page_id"),
        field("Page-Bytes").cast("long").alias("payload_bytes"),
        field("Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("Content-Length").cast("long").alias("block_bytes"),
        "rest",
    )
    # The last record of a file keeps its closing empty lines.
    block = F.when(F.octet_length("rest") > F.col("block_bytes"), F.expr("left(rest, length(rest) - 4)")).otherwise(F.col("rest"))
    body = F.expr("substr(block, instr(block, '\r\n\r\n') + 4)")
    return parsed.withColumn("block", block).withColumn("piece", F.when(F.col("kind") == "continuation", F.col("block")).otherwise(body)).drop("rest", "block")


def running_digests(pieces: DataFrame) -> DataFrame:
    """(record, segment, bytes_so_far, digest_so_far) of chunk rows (record, segment, piece).

    Rows are dealt out by record and sorted, and one digest state goes from row to
    row: memory holds a batch of chunks, whatever the length of the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, state, size = None, None, 0
        for batch in batches:
            sizes, digests = [], []
            names = batch.column(0).to_pylist()
            for name, piece in zip(names, batch.column(2)):
                if name != record or state is None:
                    record, state, size = name, hashlib.sha1(), 0
                data = piece.as_buffer()
                state.update(data)
                size += len(data)
                sizes.append(size)
                digests.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=["record", "segment", "bytes_so_far", "digest_so_far"],
            )

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select("record", "segment", F.encode("piece", "UTF-8").alias("piece"))
    return rows.repartition(n, "record").sortWithinPartitions("record", "segment").mapInArrow(run, "record string, segment int, bytes_so_far long, digest_so_far string")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page record.

    Size and digest of a response are those of the payload as read; a revisit has
    no payload and gives those of its header.
    """
    rows = read_chunks(spark, folder)
    whole = rows.filter("segment = 0")
    stored = F.col("kind") == "response"
    alone = whole.select(
        "page_id",
        F.when(stored, F.octet_length("piece").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, base32(F.sha1(F.encode("piece", "UTF-8")))).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )
    several = rows.filter("segment > 0")
    ends = running_digests(several).groupBy("record").agg(F.max_by(F.struct("bytes_so_far", "digest_so_far"), "segment").alias("end"))
    heads = several.filter("kind <> 'continuation'").select("record", "page_id", F.col("kind").alias("record_type"), "refers_to")
    long = heads.join(ends, "record").select(
        "page_id", F.col("end.bytes_so_far").alias("payload_bytes"), base32(F.col("end.digest_so_far")).alias("payload_digest"), "record_type", "refers_to"
    )
    return alone.unionByName(long)
