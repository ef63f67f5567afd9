"""Registered queries of this package: one per operator, over whole tables.

``QUERIES`` maps a name to a function of (session, folder of tables); ``SQL`` has
the same result as SQL where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from clipsight.llm import (
    backoff,
    bestfit_packing,
    bpe_trees,
    conversation_repair,
    dual_tree,
    fertility,
    license_rules,
    oph_dedup,
    pii_disclosure,
    secret_scan,
    suffix_dedup,
    topk_search,
    warc,
)
from clipsight.llm.shared import tables, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Vocabulary files of the tokenizer queries.
WORD_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(tables(spark, sf_dir, "documents"))


@query
def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(tables(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


@query
def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(tables(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


@query
def op4_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph_dedup.groups(tables(spark, sf_dir, "documents"))


@query
def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.findings(tables(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


@query
def op6_range_partitioned_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_counts(tables(spark, sf_dir, "documents"))


@query
def op7_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(tables(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    warc.write_archives(tables(spark, sf_dir, "pages"), folder)
    return warc.read_records(spark, folder)


@query
def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(tables(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


@query
def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trees.encoded(tables(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


@query
def op11_target_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "conversations")
    return conversation_repair.repaired(conversation_repair.damaged(rows), rows.select("conv_id"))


@query
def op12_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.report(tables(spark, sf_dir, "documents"))


@query
def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


SQL["op4_one_permutation_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS doc, doc_id AS found FROM documents
  UNION SELECT doc, b FROM reached JOIN both_ways ON a = found),
least AS (SELECT doc, min(found) AS component_id FROM reached GROUP BY doc)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc = doc_id
"""

SQL["op7_tiled_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

SQL["op9_warc_chunks"] = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((16 * (strpos('0123456789abcdef', substr(h, 1 + 5 * (i // 4), 1)) - 1) + strpos('0123456789abcdef', substr(h, 2 + 5 * (i // 4), 1)) - 1) * 4096
      + (strpos('0123456789abcdef', substr(h, 3 + 5 * (i // 4), 1)) - 1) * 256
      + (strpos('0123456789abcdef', substr(h, 4 + 5 * (i // 4), 1)) - 1) * 16
      + strpos('0123456789abcdef', substr(h, 5 + 5 * (i // 4), 1)) - 1)
     // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS INTEGER), 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""

_PLACES = "list_filter(list_transform(range(1, len({h}) + 1), lambda i: {{'start': list_sum(list_transform(list_slice({g}, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice({h}, 1, i - 1), lambda x: length(x))), 0), 'v': {h}[i]}}), lambda x: {keep})"
_ASSIGN = secret_scan.ASSIGN.replace("'", "''")
SQL["op5_secret_ownership"] = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT doc_id, source,
    regexp_split_to_array(t, '{_ASSIGN}') AS g0, regexp_extract_all(t, '{_ASSIGN}') AS h0,
    regexp_split_to_array(t, '{secret_scan.ACCESS}') AS g1, regexp_extract_all(t, '{secret_scan.ACCESS}') AS h1,
    regexp_split_to_array(t, '{secret_scan.HEX}') AS g2, regexp_extract_all(t, '{secret_scan.HEX}') AS h2,
    regexp_split_to_array(t, '{secret_scan.TOKEN}') AS g3, regexp_extract_all(t, '{secret_scan.TOKEN}') AS h3
  FROM t),
found AS (
  SELECT doc_id, source,
    {_PLACES.format(g="g0", h="h0", keep=f"length(regexp_extract(x.v, '{_ASSIGN}', 1)) >= 6")} AS p0,
    {_PLACES.format(g="g1", h="h1", keep="true")} AS p1,
    {_PLACES.format(g="g2", h="h2", keep="true")} AS p2,
    {_PLACES.format(g="g3", h="h3", keep="regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]')")} AS p3
  FROM cut),
places AS (
  SELECT doc_id, source, kind, u.start AS start, u.start + length(u.v) AS stop,
    CASE WHEN kind = 0 THEN regexp_extract(u.v, '{_ASSIGN}', 1) ELSE u.v END AS value
  FROM (SELECT doc_id, source, 0 AS kind, unnest(p0) AS u FROM found
    UNION ALL SELECT doc_id, source, 1, unnest(p1) FROM found
    UNION ALL SELECT doc_id, source, 2, unnest(p2) FROM found
    UNION ALL SELECT doc_id, source, 3, unnest(p3) FROM found)),
kept AS (
  SELECT * FROM places p
  WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM places b WHERE b.doc_id = p.doc_id AND b.kind < 3 AND b.start < p.stop AND p.start < b.stop)),
judged AS (
  SELECT *, list_unique(string_split(value, '')) >= 8 AS varied, owners FROM kept
  JOIN (SELECT value AS w, count(DISTINCT source) AS owners FROM kept GROUP BY value) ON value = w),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (owners = 1 AND varied) AS n_live, count(*) FILTER (owners > 1) AS n_copied,
    string_agg(concat_ws(':', (['assign', 'access', 'hex', 'token'])[kind + 1], start, stop), ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(concat_ws(':', (['assign', 'access', 'hex', 'token'])[kind + 1], start, stop), ',' ORDER BY start, kind) FILTER (kind < 3 OR owners = 1 AND varied) AS spans
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


def _license_sql() -> str:
    """Rules as nested replacements over the sequence of numbers, one step per rule."""
    number = {name: n for n, name in enumerate(license_rules.SENTENCES, 1)}
    table = ", ".join(f"('{text}', {n})" for text, n in license_rules.known(license_rules.SENTENCES).items())
    names = ", ".join(f"'{name}'" for name in license_rules.SENTENCES)
    steps, before = [], "r0"
    for k, (licence, sequence) in enumerate(license_rules.RULES, 1):
        text = "".join(f",{number[x]}," for x in sequence)
        steps.append(
            f"r{k} AS (SELECT doc_id, numbers, replace(rest, '{text}', '|') AS rest, "
            f"list_concat(found, list_transform(range(0, (length(rest) - length(replace(rest, '{text}', '|'))) // {len(text) - 1}), lambda i: '{licence}')) AS found FROM {before})"
        )
        before = f"r{k}"
    return f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(s, 1) AS place, unnest(s) AS s
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{license_rules.CUT}') AS s FROM documents)),
sentence(text, n) AS (VALUES {table}),
hits AS (
  SELECT doc_id, list(n ORDER BY place) AS numbers
  FROM lines JOIN sentence ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = text GROUP BY doc_id),
r0 AS (
  SELECT doc_id, numbers, ',' || array_to_string(list_transform(numbers, lambda n: ',' || n || ','), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM hits),
{", ".join(steps)}
SELECT d.doc_id, CAST(coalesce(len(numbers), 0) AS BIGINT) AS n_known,
  coalesce(array_to_string(list_transform(numbers, lambda n: ([{names}])[n]), ','), '') AS known,
  coalesce(array_to_string(list_transform(range(1, len(found) + 1), lambda i: CASE WHEN list_position(found, found[i]) = i THEN found[i] END), ','), '') AS licences,
  CAST(coalesce(len(found), 0) AS BIGINT) AS n_matches
FROM documents d LEFT JOIN {before} USING (doc_id)
"""


SQL["op1_license_sentence_rules"] = _license_sql()

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op13_dual_tree_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sized AS (SELECT doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sized),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN weight USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""

_KINDS = ", ".join(f"({n}, '{p}')" for n, p in enumerate(pii_disclosure.PLAIN.values()))
_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INT) WHEN CAST(digits[i] AS INT) < 5 THEN 2 * CAST(digits[i] AS INT) ELSE 2 * CAST(digits[i] AS INT) - 9 END))"
_SPAN = "concat_ws(':', (['email', 'ip', 'card', 'phone', 'general', 'remove'])[kind + 1], start, stop)"
_WORDS = r"regexp_extract_all({}, '[\p{{L}}]+')"
_NEAR = pii_disclosure.NEAR
SQL["op12_disclosure_sanitiser"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, kind, regexp_split_to_array(t, p) AS g, regexp_extract_all(t, p) AS h FROM t, (VALUES {_KINDS}) AS v(kind, p)),
hit AS (
  SELECT doc_id, kind, h[i] AS value, g[i] AS gap, g[i + 1] AS next,
    coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM cut)),
sized AS (SELECT *, start + length(value) AS stop, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM hit),
base AS (
  SELECT *, concat_ws(':', kind, CASE kind WHEN 0 THEN lower(value) WHEN 1 THEN value ELSE digits END) AS entity,
    list_distinct(list_concat(
      {_WORDS.format(f"CASE WHEN length(gap) > {_NEAR} THEN regexp_replace(right(gap, {_NEAR + 1}), '^[{chr(92)}p{{L}}]+', '') ELSE gap END")},
      {_WORDS.format(f"CASE WHEN length(next) > {_NEAR} THEN regexp_replace(left(next, {_NEAR + 1}), '[{chr(92)}p{{L}}]+{chr(92)}z', '') ELSE next END")})) AS near
  FROM sized
  WHERE kind = 0 OR kind = 1 AND len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS HUGEINT), 256) > 255)) = 0
    OR kind = 2 AND length(digits) BETWEEN 14 AND 19 AND {_LUHN} % 10 = 0 OR kind = 3 AND length(digits) BETWEEN 10 AND 15),
pairs AS (SELECT doc_id, entity, list_sort(near) AS around, unnest(near) AS word FROM base),
likely AS (SELECT entity, word, count(DISTINCT doc_id) AS joint FROM pairs GROUP BY ALL HAVING count(DISTINCT around) >= {pii_disclosure.SUPPORT}),
entities AS (SELECT entity, count(DISTINCT doc_id) AS df_c FROM base GROUP BY entity),
words AS (SELECT word, count(*) AS df_t FROM (SELECT unnest(list_distinct({_WORDS.format('t')})) AS word FROM t) GROUP BY word),
telling AS (
  SELECT entity, word, round(ln(joint * n / (df_t * df_c)) / ln(n / df_c), 9) AS share
  FROM likely JOIN words USING (word) JOIN entities USING (entity), (SELECT count(*) AS n FROM t) WHERE n > df_c),
hidden AS (
  SELECT doc_id, word, CASE WHEN max(share) >= {pii_disclosure.REMOVE} THEN 5 ELSE 4 END AS kind
  FROM pairs JOIN telling USING (entity, word) WHERE share >= {pii_disclosure.GENERAL} GROUP BY ALL),
said AS (
  SELECT doc_id, h[i] AS word, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT doc_id, regexp_split_to_array(t, '[\p{{L}}]+') AS g, {_WORDS.format('t')} AS h FROM t WHERE doc_id IN (SELECT doc_id FROM hidden)))),
added AS (
  SELECT doc_id, kind, start, start + length(word) AS stop FROM said s JOIN hidden USING (doc_id, word)
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start < s.start + length(word) AND s.start < b.stop)),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    string_agg({_SPAN}, ',' ORDER BY start, kind) FILTER (kind < 4) AS base, string_agg({_SPAN}, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (kind = 4) AS n_general, count(*) FILTER (kind = 5) AS n_remove
  FROM (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_general, 0) AS n_general, coalesce(n_remove, 0) AS n_remove
FROM documents LEFT JOIN listed USING (doc_id)
"""
