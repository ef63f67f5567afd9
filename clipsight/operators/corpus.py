"""Prompt corpus: unwrap, vary, explode and check nested JSON documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsight.functions import documents as D
from clipsight.operators.skew import lookup_join

#: Matrix rows that one array holds.
MATRIX_ROWS = 1000


def unwrapped(docs: DataFrame, column: str = "json") -> DataFrame:
    """Unwrap each document; ``error`` is set where it (or its inner text) is not JSON."""
    inner = D.unwrap(F.col(column))
    return docs.withColumn("document", inner).withColumn(
        "error", F.when(F.col("document").isNull(), F.lit("not json"))
    )


def parsed(docs: DataFrame, column: str = "json") -> DataFrame:
    """Add the typed document ``doc`` (NULL fields where absent) for JSON text that is an object."""
    return docs.withColumn("doc", F.from_json(F.col(column), D.PROMPT_SCHEMA))


def parts(docs: DataFrame, part: str) -> DataFrame:
    """One row per element of ``subjects`` / ``actions`` / ``segments`` /
    ``text_and_signage_elements``; documents without elements keep one row."""
    rest = [c for c in docs.columns if c != "doc"]
    return docs.select(*rest, F.posexplode_outer(f"doc.{part}").alias("part_no", "part"))


def vary(base: DataFrame, matrix: DataFrame, axes: Sequence[str], overrides: DataFrame | None = None) -> DataFrame:
    """Every base prompt with every matrix row.

    ``base`` has ``prompt_idx``; ``matrix`` has ``row`` and the axis columns.  It
    becomes an array that each base row explodes, so nothing is shuffled; a matrix
    of more than ``MATRIX_ROWS`` rows becomes several arrays, joined by their
    number.  ``overrides`` (prompt_idx, row, axis, value) replace single axes.
    """
    rows = F.collect_list(F.struct("row", *axes)).alias("_rows")
    blocks = -(-matrix.count() // MATRIX_ROWS)
    if blocks <= 1:
        arrays = base.withColumn("_rows", matrix.agg(rows).scalar())
    else:
        block = F.pmod(F.xxhash64("row", *axes), F.lit(blocks)).alias("_block")
        numbered = base.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        arrays = numbered.join(matrix.groupBy(block).agg(rows), "_block").drop("_block")
    varied = arrays.select("*", F.inline("_rows")).drop("_rows")
    if overrides is None:
        return varied
    pinned = overrides.groupBy("prompt_idx", "row").agg(
        *[F.max(F.when(F.col("axis") == a, F.col("value"))).alias(f"_{a}") for a in axes]
    )
    joined = lookup_join(varied, pinned, ["prompt_idx", "row"])
    return joined.withColumns({a: F.coalesce(f"_{a}", a) for a in axes}).drop(*[f"_{a}" for a in axes])


def merge_fields(docs: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Deep merge: replace nested fields (``lighting.conditions``) of ``doc``, keep the rest."""
    doc = F.col("doc")
    for path, value in fields.items():
        doc = doc.withField(path, value)
    return docs.withColumn("doc", doc)


def variant_names(prompt_idx: Column, row: Column) -> Column:
    return F.concat(F.lit("prompt_"), prompt_idx.cast("string"), F.lit("_"), row, F.lit(".json"))


def _keys(json: Column) -> Column:
    return F.array_join(F.sort_array(F.json_object_keys(json)), ",")


def _facts(m: Column) -> dict[str, Column]:
    """What must not change between a base prompt and its variants, as texts by rule.

    ``m`` maps the top-level keys to the JSON text below them: the document is
    parsed once, and only small pieces of it again.
    """
    def count(field: str) -> Column:
        return F.coalesce(F.json_array_length(m[field]), F.lit(0)).cast("string")

    counted = F.from_json(
        m["subjects"], "array<struct<description:string,number_of_subjects:int,number_of_arms:int,number_of_legs:int>>"
    )
    first = F.from_json(m["subjects"], "array<string>")
    subjects = F.transform(
        counted, lambda x: F.concat_ws("/", x["number_of_subjects"], x["number_of_arms"], x["number_of_legs"])
    )
    size = F.from_json(m["resolution"], "struct<H:int,W:int>")
    beats = F.from_json(m["segments"], "array<struct<time_range:string>>")
    return {
        "keys": F.array_join(F.sort_array(F.map_keys(m)), ","),
        "lighting_keys": _keys(m["lighting"]),
        "aesthetics_keys": _keys(m["aesthetics"]),
        "duration": m["duration"],
        "fps": m["fps"],
        "resolution": F.concat_ws("x", size["H"], size["W"]),
        "aspect_ratio": m["aspect_ratio"],
        "n_segments": count("segments"),
        "n_actions": count("actions"),
        "n_subjects": count("subjects"),
        "n_signage": count("text_and_signage_elements"),
        "subject_counts": F.array_join(subjects, ","),
        "subject_identity": F.array_join(F.transform(counted, lambda x: F.coalesce(x["description"], F.lit(""))), "|"),
        "subject_keys": F.array_join(F.transform(first, _keys), "|"),
        "segment_times": F.array_join(F.transform(beats, lambda x: F.coalesce(x["time_range"], F.lit(""))), ","),
    }


def _with_facts(docs: DataFrame, keep: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    opened = docs.select(*keep, F.from_json("json", "map<string,string>").alias("m"))
    facts = _facts(F.col("m"))
    return opened.select(*keep, *[value.alias(prefix + rule) for rule, value in facts.items()]), list(facts)


def _compared(variants: DataFrame, base: DataFrame) -> tuple[DataFrame, list[str]]:
    """Facts of every variant next to those of its base; only the short fact strings are joined."""
    want, rules = _with_facts(base, ["prompt_idx"], "want_")
    got, _ = _with_facts(variants, ["file", "prompt_idx"], "got_")
    return lookup_join(got, want, ["prompt_idx"]), rules


def _holds(rule: str) -> Column:
    return F.col(f"got_{rule}").eqNullSafe(F.col(f"want_{rule}"))


def invariant_sweep(variants: DataFrame, base: DataFrame) -> DataFrame:
    """``(file, rule, ok, got, want)`` for every variant and every invariant.

    Both sides have ``prompt_idx`` and ``json``; variants also ``file``.
    """
    joined, rules = _compared(variants, base)
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), _holds(r).alias("ok"), F.col(f"got_{r}").alias("got"), F.col(f"want_{r}").alias("want"))
            for r in rules
        ]
    )
    return joined.select("file", F.inline(rows))


def invariant_totals(variants: DataFrame, base: DataFrame) -> DataFrame:
    """``(rule, n_ok, n_broken)``, counted in one pass: no row per variant and rule is made."""
    joined, rules = _compared(variants, base)
    counted = joined.agg(*[F.count_if(_holds(r)).alias(f"ok_{r}") for r in rules], *[F.count_if(~_holds(r)).alias(f"no_{r}") for r in rules])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"ok_{r}").alias("n_ok"), F.col(f"no_{r}").alias("n_broken")) for r in rules])
    return counted.select(F.inline(rows))


def marker_table_checks(docs: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``(key, rule, hits, ok)`` by a table of rules ``(prompt_idx, rule, field, pattern, least, most)``.

    ``docs`` has ``key``, ``prompt_idx`` and the columns that ``field`` names; a
    rule counts in the documents of its base prompt, and a missing field has no
    hits.  A base prompt has few rules, so their table is the looked-up side.
    """
    fields = [c for c in docs.columns if c not in (key, "prompt_idx")]
    texts = F.create_map(*[x for c in fields for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    held = lookup_join(docs.select(key, "prompt_idx", texts.alias("_texts")), rules, ["prompt_idx"], "inner")
    counted = held.withColumn("hits", F.regexp_count(F.coalesce(F.try_element_at("_texts", F.col("field")), F.lit("")), F.col("pattern")).cast("long"))
    return counted.select(key, "rule", "hits", F.col("hits").between(F.col("least"), F.col("most")).alias("ok"))


def marker_checks(docs: DataFrame, key: str, column: str, rules: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """``(key, rule, hits, ok)``: each rule is (name, pattern, least, most) counts over the whole text."""
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.regexp_count(F.col(column), F.lit(pattern)).cast("long").alias("hits"),
                F.lit(least).alias("least"),
                F.lit(most).alias("most"),
            )
            for name, pattern, least, most in rules
        ]
    )
    return docs.select(key, F.inline(checks)).select(
        key, "rule", "hits", F.col("hits").between(F.col("least"), F.col("most")).alias("ok")
    )


def segment_rules(docs: DataFrame, key: str, ranges: str = "ranges", duration: str = "duration") -> DataFrame:
    """Timing rules per document, from its array of ``M:SS-M:SS`` texts and its ``5s`` duration.

    ``readable``: all ranges parse; ``last_long_enough``: the last one lasts two
    seconds or more; ``contiguous``: each starts where the one before ended;
    ``fills_clip``: the last one ends at the duration.
    """
    spans = docs.select(
        key,
        F.transform(F.col(ranges), D.seconds_range).alias("s"),
        D.duration_seconds(F.col(duration)).alias("duration_s"),
    )
    s, last = F.col("s"), F.try_element_at(F.col("s"), F.lit(-1))
    follows = F.transform(s, lambda x, i: (i == 0) | (x["start_s"] == F.get(s, i - 1)["end_s"]))
    no = F.lit(False)
    return spans.select(
        key,
        F.size(s).cast("long").alias("n_segments"),
        F.coalesce((F.size(s) > 0) & F.forall(s, lambda x: x.isNotNull()), no).alias("readable"),
        F.coalesce(last["end_s"] - last["start_s"] >= 2, no).alias("last_long_enough"),
        F.forall(follows, lambda x: F.coalesce(x, no)).alias("contiguous"),
        F.coalesce(last["end_s"] == F.col("duration_s"), no).alias("fills_clip"),
    )
