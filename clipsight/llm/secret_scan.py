"""Secret scans with corpus-wide ownership of every candidate, in SQL functions only.

``scan`` finds the fixed patterns and, as weaker candidates, long tokens that mix
letters and digits.  ``ownership`` counts for every candidate value in how many
repositories (documents) and under how many owners (sources) it occurs.  A value
under several owners, or in more than ``COMMON`` repositories of its one owner, is a
copied example; one that only one owner has in few repositories and that is varied
enough to be real is live-looking.  ``findings`` keeps all spans of the fixed
patterns and adds those tokens that are live-looking; ``counts`` has the owners and
repositories of every place.

Defined cases: a null text is empty; a null owner or repository counts as one of
its own; repeated rows are rows of the result of their own, and count once in the
frequencies (same repository).  A text without a find has empty span lists.
Overlapping finds of different kinds all stay.  Empty tables give no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsight.llm.shared import fresh_name, stored

#: The patterns of the kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9_-]{20,}"
KINDS = ["assign", "access", "hex", "token"]
#: Least length of an assigned value; least number of different characters of a live-looking value.
ASSIGNED, VARIED = 6, 8
#: Most repositories of one owner in which a value is still that owner's own.
COMMON = 10


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches, leftmost first and not overlapping, as (start, kind, end, value).

    The pieces between the matches and the matches take turns, so their lengths give
    the places; each text is cut once and no place is searched for again.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = lambda start, value: F.struct(
        start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(value)).cast("int").alias("end"), value.alias("value")
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    step = lambda done, pair: F.struct(
        (done["at"] + F.length(pair["gap"]) + F.length(pair["hit"])).cast("int").alias("at"),
        F.concat(done["found"], F.array(span((done["at"] + F.length(pair["gap"])).cast("int"), pair["hit"]))).alias("found"),
    )
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(0))), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda done: done["found"])
    return F.when(F.size(hits) == 0, empty).otherwise(walked)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner_column: str = "source") -> DataFrame:
    """(doc_id, owner, tag, base, tokens): a hash of the text, spans of the fixed patterns and of weaker candidates per row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(owner_column).cast("string").alias("owner"), F.xxhash64(text).alias("tag"), text.alias("t"))
    t = F.col("t")
    assigned = F.transform(
        F.filter(located(t, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= ASSIGNED),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.regexp_extract(x["value"], ASSIGN, 1).alias("value")),
    )
    rows = rows.select("doc_id", "owner", "tag", F.array_sort(F.concat(assigned, located(t, ACCESS, 1), located(t, HEX, 2))).alias("base"), located(t, TOKEN, 3).alias("long"))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    return rows.select("doc_id", "owner", "tag", "base", F.filter("long", lambda x: mixed(x) & apart(x)).alias("tokens"))


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per candidate: its place, the hash of its value and whether that looks real."""
    row = scanned.select("doc_id", "owner", "tag", F.explode(F.concat("base", "tokens")).alias("c"))
    return row.select(
        "doc_id", "owner", "tag", "c.start", "c.kind", "c.end",
        F.sha2(F.col("c.value"), 256).alias("hash"),
        (F.size(F.array_distinct(F.split("c.value", ""))) >= VARIED).alias("varied"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories): every step combines before it shuffles, so a frequent value is no hot key."""
    held = found.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    by_doc = held.groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
    repositories = by_doc.groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(repositories, "hash")


def findings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner_column: str = "source") -> DataFrame:
    """Per row: doc_id, owner, a hash of the text, all spans (base and added), how many are live-looking or copied examples, and owners and repositories of each."""
    scanned = stored(scan(docs, id_column, text_column, owner_column))
    found = candidates(scanned)
    copied = (F.col("owners") > 1) | (F.col("repositories") > COMMON)
    judged = found.join(ownership(found), "hash").withColumn("copied", copied).withColumn("live", ~F.col("copied") & F.col("varied"))
    span = F.struct("start", "kind", "end")
    per_place = judged.groupBy("doc_id", "owner", "tag", "start", "kind", "end").agg(*[F.max(c).alias(c) for c in ("live", "copied", "owners", "repositories")])
    verdicts = per_place.groupBy("doc_id", "owner", "tag").agg(
        F.collect_list(F.when(F.col("live"), span)).alias("live"),
        F.collect_list(F.when(F.col("copied"), span)).alias("copied"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))).alias("counts"),
    )
    verdicts = verdicts.select(F.col("doc_id").alias("v_id"), F.col("owner").alias("v_owner"), F.col("tag").alias("v_tag"), "live", "copied", "counts")
    has = F.size(F.concat("base", "tokens")) > 0
    same = F.col("doc_id").eqNullSafe(F.col("v_id")) & F.col("owner").eqNullSafe(F.col("v_owner")) & (F.col("tag") == F.col("v_tag"))
    joined = scanned.join(verdicts, same & has, "left")
    place = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    live, copied = F.coalesce("live", none), F.coalesce("copied", none)
    base, tokens = F.transform("base", place), F.transform("tokens", place)
    return joined.select(
        "doc_id",
        "owner",
        "tag",
        base.alias("base"),
        F.array_sort(F.concat(base, F.array_intersect(tokens, live))).alias("spans"),
        F.size(F.array_intersect(F.concat(base, tokens), live)).cast("long").alias("n_live"),
        F.size(F.array_intersect(F.concat(base, tokens), copied)).cast("long").alias("n_copied"),
        F.coalesce("counts", F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint>>")).alias("counts"),
    )


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; a span within reach of one before joins it."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def step(done: Column, x: Column) -> Column:
        between = F.concat(done["out"], F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(x["start"] < done["at"], done["out"]).otherwise(between).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner_column: str = "source") -> DataFrame:
    """All rows and columns of ``docs``, with the spans replaced in the text."""
    tag, spans, r_id, r_owner, r_tag = (fresh_name(docs, x) for x in ("tag", "spans", "r_id", "r_owner", "r_tag"))
    found = findings(docs, id_column, text_column, owner_column).filter(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias(r_id), F.col("owner").alias(r_owner), F.col("tag").alias(r_tag), F.col("spans").alias(spans)).dropDuplicates([r_id, r_owner, r_tag])
    text = F.col(f"`{text_column}`")
    rows = docs.withColumn(tag, F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(r_id)) & F.col(f"`{owner_column}`").cast("string").eqNullSafe(F.col(r_owner)) & (F.col(tag) == F.col(r_tag))
    joined = rows.join(found, same, "left")
    new = F.when(F.col(spans).isNull(), text).otherwise(replaced(text, F.col(spans)))
    return joined.select(*[new.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])
