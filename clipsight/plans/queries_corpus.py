"""Queries over prompt documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipsight.functions import documents as D
from clipsight.functions import put_first
from clipsight.operators import corpus
from clipsight.plans import inputs as I
from clipsight.plans.registry import Tables, register, with_inputs

UNWRAP_SQL = """
SELECT event_id, CASE WHEN NOT json_valid(j) THEN NULL
                      WHEN json_type(doc, '$.prompt') = 'VARCHAR' THEN
                        CASE WHEN json_valid(json_extract_string(doc, '$.prompt')) THEN json_extract_string(doc, '$.prompt') END
                      ELSE j END AS document
FROM (SELECT event_id, j, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS doc FROM wrapped)
"""
register(
    "unwrap_prompt",
    lambda t: corpus.unwrapped(t.derive(I.WRAPPED_PROMPTS), "j").select("event_id", "document", "error"),
    with_inputs(
        "SELECT event_id, document, CASE WHEN document IS NULL THEN 'not json' END AS error FROM unwrapped",
        wrapped=I.WRAPPED_PROMPTS,
        unwrapped=UNWRAP_SQL,
    ),
)
register(
    "compact_json",
    lambda t: t.events.select("event_id", D.compact(F.concat(F.lit('{"é" : '), "props", F.lit(' }'))).alias("compact")),
    """SELECT event_id, '{"' || chr(92) || 'u00e9":' || replace(props, ' ', '') || '}' AS compact FROM events""",
)
register(
    "json_validity",
    lambda t: t.derive(I.WRAPPED_PROMPTS).groupBy(D.is_json(F.col("j")).alias("is_json")).agg(F.count(F.lit(1)).alias("n")),
    with_inputs("SELECT json_valid(j) AS is_json, count(*) AS n FROM wrapped GROUP BY 1", wrapped=I.WRAPPED_PROMPTS),
)

RANGES_SQL = """
SELECT o_orderkey, duration,
       list_transform(string_split(ranges, '|'), lambda x: CASE WHEN regexp_matches(x, '^\\d+:\\d\\d-\\d+:\\d\\d$') THEN
         [CAST(regexp_extract(x, '^(\\d+):(\\d\\d)-(\\d+):(\\d\\d)$', 1) AS INT) * 60 + CAST(regexp_extract(x, '^(\\d+):(\\d\\d)-(\\d+):(\\d\\d)$', 2) AS INT),
          CAST(regexp_extract(x, '^(\\d+):(\\d\\d)-(\\d+):(\\d\\d)$', 3) AS INT) * 60 + CAST(regexp_extract(x, '^(\\d+):(\\d\\d)-(\\d+):(\\d\\d)$', 4) AS INT)] END) AS s
FROM ranged
"""
register(
    "time_range_rules",
    lambda t: corpus.segment_rules(t.derive(I.TIME_RANGES).withColumn("ranges", F.split("ranges", "\\|")), "o_orderkey"),
    with_inputs(
        """
SELECT o_orderkey, len(s) AS n_segments, coalesce(len(list_filter(s, lambda x: x IS NULL)) = 0, false) AS readable,
       coalesce(s[-1][2] - s[-1][1] >= 2, false) AS last_long_enough,
       coalesce(s[2][1] = s[1][2], false) AND (len(s) < 3 OR coalesce(s[3][1] = s[2][2], false)) AS contiguous,
       coalesce(s[-1][2] = CAST(replace(duration, 's', '') AS DOUBLE), false) AS fills_clip
FROM spans
""",
        ranged=I.TIME_RANGES,
        spans=RANGES_SQL,
    ),
)
register(
    "variation_cross",
    lambda t: corpus.vary(
        t.derive(I.BASE_PROMPTS), t.derive(I.MATRIX), ["weather", "region"], t.derive(I.OVERRIDES)
    ).withColumn("file", corpus.variant_names(F.col("prompt_idx"), F.col("row"))),
    with_inputs(
        """
SELECT b.prompt_idx, b.scenario, m."row", coalesce(o.value, m.weather) AS weather, m.region,
       'prompt_' || CAST(b.prompt_idx AS VARCHAR) || '_' || m."row" || '.json' AS file
FROM base b CROSS JOIN matrix m LEFT JOIN overrides o ON o.prompt_idx = b.prompt_idx AND o."row" = m."row"
""",
        base=I.BASE_PROMPTS,
        matrix=I.MATRIX.replace("AS row", 'AS "row"'),
        overrides=I.OVERRIDES.replace("AS row", 'AS "row"'),
    ),
)


FACT_RULES = {
    "keys": "array_to_string(list_sort(json_keys({j})), ',')",
    "lighting_keys": "array_to_string(list_sort(json_keys({j}, '$.lighting')), ',')",
    "aesthetics_keys": "array_to_string(list_sort(json_keys({j}, '$.aesthetics')), ',')",
    "duration": "json_extract_string({j}, '$.duration')",
    "fps": "json_extract_string({j}, '$.fps')",
    "resolution": "json_extract_string({j}, '$.resolution.H') || 'x' || json_extract_string({j}, '$.resolution.W')",
    "aspect_ratio": "json_extract_string({j}, '$.aspect_ratio')",
    "n_segments": "CAST(json_array_length({j}, '$.segments') AS VARCHAR)",
    "n_actions": "CAST(json_array_length({j}, '$.actions') AS VARCHAR)",
    "n_subjects": "CAST(json_array_length({j}, '$.subjects') AS VARCHAR)",
    "n_signage": "CAST(coalesce(json_array_length({j}, '$.text_and_signage_elements'), 0) AS VARCHAR)",
    "subject_counts": "array_to_string(list_transform(range(0, CAST(json_array_length({j}, '$.subjects') AS INT)), lambda i: concat_ws('/', "
                      "json_extract_string({j}, '$.subjects[' || i || '].number_of_subjects'), "
                      "json_extract_string({j}, '$.subjects[' || i || '].number_of_arms'), "
                      "json_extract_string({j}, '$.subjects[' || i || '].number_of_legs'))), ',')",
    "subject_identity": "array_to_string(list_transform(range(0, CAST(json_array_length({j}, '$.subjects') AS INT)), lambda i: "
                        "coalesce(json_extract_string({j}, '$.subjects[' || i || '].description'), '')), '|')",
    "subject_keys": "array_to_string(list_transform(range(0, CAST(json_array_length({j}, '$.subjects') AS INT)), lambda i: "
                    "array_to_string(list_sort(json_keys(json_extract({j}, '$.subjects[' || i || ']'))), ',')), '|')",
    "segment_times": "array_to_string(json_extract_string({j}, '$.segments[*].time_range'), ',')",
}
SWEEP_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{rule}' AS rule,
       count(*) FILTER (WHERE {fact.format(j='v.json')} IS NOT DISTINCT FROM {fact.format(j='b.json')}) AS n_ok,
       count(*) FILTER (WHERE {fact.format(j='v.json')} IS DISTINCT FROM {fact.format(j='b.json')}) AS n_broken
FROM variants v LEFT JOIN bases b ON v.prompt_idx = b.prompt_idx"""
    for rule, fact in FACT_RULES.items()
)
register("invariant_sweep", lambda t: corpus.invariant_totals(t.derive(I.VARIANT_DOCUMENTS), t.derive(I.BASE_DOCUMENTS)), with_inputs(SWEEP_SQL, variants=I.VARIANT_DOCUMENTS, bases=I.BASE_DOCUMENTS))

DETAIL_SQL = "\nUNION ALL\n".join(
    f"""SELECT v.file, '{rule}' AS rule, {fact.format(j='v.json')} IS NOT DISTINCT FROM {fact.format(j='b.json')} AS ok,
       {fact.format(j='v.json')} AS got, {fact.format(j='b.json')} AS want FROM variants v LEFT JOIN bases b ON v.prompt_idx = b.prompt_idx"""
    for rule, fact in FACT_RULES.items()
)
register(
    "invariant_details",
    lambda t: corpus.invariant_sweep(t.derive(I.VARIANT_DOCUMENTS), t.derive(I.BASE_DOCUMENTS)),
    with_inputs(DETAIL_SQL, variants=I.VARIANT_DOCUMENTS, bases=I.BASE_DOCUMENTS),
)

# Rules of a base prompt: how often a pattern may occur in a field.
MARKER_RULES = """
SELECT p_partkey AS prompt_idx, 'colour' AS rule, 'text' AS field, split_part(p_type, ' ', 3) AS pattern, 0 AS least, 0 AS most FROM {part}
UNION ALL SELECT p_partkey, 'sentences', 'text', '[.!?]', CAST(p_size AS INT), 1000000 FROM {part} WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'language', 'lang', 'en', 1, 1 FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'absent', 'no_field', 'x', 1, 2 FROM {part} WHERE p_partkey % 50 = 0
"""
MARKED_DOCUMENTS = "SELECT doc_id, doc_id % 150 AS prompt_idx, text, lang FROM {documents}"
register(
    "marker_table",
    lambda t: corpus.marker_table_checks(t.derive(MARKED_DOCUMENTS), t.derive(MARKER_RULES), "doc_id"),
    with_inputs(
        """
WITH counted AS (
  SELECT d.doc_id, r.rule, r.least, r.most, len(regexp_extract_all(
    CASE r.field WHEN 'text' THEN d.text WHEN 'lang' THEN d.lang ELSE '' END, r.pattern)) AS hits
  FROM docs d JOIN rules r ON d.prompt_idx = r.prompt_idx)
SELECT doc_id, rule, hits, hits BETWEEN least AND most AS ok FROM counted
""",
        docs=MARKED_DOCUMENTS,
        rules=MARKER_RULES,
    ),
)

# (rule, pattern, least hits, most hits)
MARKERS = [
    ("has_sentences", "[.!?]", 1, 1_000_000_000),
    ("few_digits", "[0-9]+", 0, 20),
    ("no_copyright", "(?i)copyright", 0, 0),
    ("names_the", "(?i)the", 3, 1_000_000_000),
]
register(
    "marker_checks",
    lambda t: corpus.marker_checks(t.documents, "doc_id", "text", MARKERS),
    "\nUNION ALL\n".join(
        f"""SELECT doc_id, '{name}' AS rule, len(regexp_extract_all(text, '{pattern}')) AS hits,
       len(regexp_extract_all(text, '{pattern}')) BETWEEN {least} AND {most} AS ok FROM documents"""
        for name, pattern, least, most in MARKERS
    ),
)


register(
    "list_merge",
    lambda t: t.part.select(
        "p_partkey",
        F.array_join(put_first(F.split(F.lower("p_type"), "o"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_name"), " ")), ",").alias("merged"),
    ),
    """
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS merged
FROM (SELECT p_partkey, list_concat(string_split(lower(p_type), 'o'), string_split(concat_ws(' ', p_name, p_brand, p_name), ' ')) AS l
      FROM part)
""",
)


def scenery(t: Tables):
    """Deep merge: new lighting conditions, everything else kept."""
    docs = corpus.parsed(t.derive(I.BASE_DOCUMENTS))
    merged = corpus.merge_fields(docs, {"lighting.conditions": F.concat(F.lit("fog "), F.col("prompt_idx").cast("string"))})
    return merged.select("prompt_idx", "doc.lighting.conditions", "doc.lighting.shadows", "doc.fps")


register(
    "scenery_merge",
    scenery,
    "SELECT c_custkey AS prompt_idx, 'fog ' || CAST(c_custkey AS VARCHAR) AS conditions, 'long' AS shadows, 24 AS fps FROM customer",
)
register(
    "document_parts",
    lambda t: corpus.parts(corpus.parsed(t.derive(I.VARIANT_DOCUMENTS)), "subjects").select(
        "file", "part_no", "part.description", "part.number_of_legs"
    ),
    with_inputs(
        """
WITH counted AS (SELECT *, CAST(json_array_length(json, '$.subjects') AS INT) AS n FROM variants),
parts AS (SELECT file, json, unnest(range(0, n)) AS i FROM counted UNION ALL SELECT file, json, NULL FROM counted WHERE n = 0)
SELECT file, i AS part_no, json_extract_string(json, '$.subjects[' || i || '].description') AS description,
       CAST(json_extract_string(json, '$.subjects[' || i || '].number_of_legs') AS INT) AS number_of_legs
FROM parts
""",
        variants=I.VARIANT_DOCUMENTS,
    ),
)
