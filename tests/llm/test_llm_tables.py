"""Search, packing, archives, the registered queries and the pipeline."""

import base64
import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import compare, database
from llm_cases import PIECE_FILE, WORD_FILE, awkward, awkward_texts, cut_bytes, near_components, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from clipsight.llm import bestfit_packing, queries, topk_search, warc

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
library = Tokenizer.from_file(WORD_FILE)


def test_search_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=8).round(1).tolist() for i in range(300)}
    for i in range(120, 200):
        vectors[i] = [0.5] * 8  # ties
    rows = [(i, v, i) for i, v in vectors.items()]
    rows += [(1000, None, 0), (1100, [1.0, None] * 4, 0), (1200, [float("nan")] * 8, 0), (1300, [float("inf")] * 8, 0), (1400, [], 0), (1500, [1.0, 2.0], 0), (1600, [2.0, 2.0], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    have = defaultdict(list)
    for r in topk_search.search(df, F.col("vec_id") % 100 == 0, 10, block=2).collect():
        have[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int) for i, v in vectors.items()}
    for q in (0, 100, 200):
        want = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        assert sorted(have[q]) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert sorted(have[1500]) == [(1, 1600, 1024 * 2048 * 3)]
    assert set(have) == {0, 100, 200, 1500, 1600}
    assert topk_search.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_search_of_odd_vectors_and_columns(spark):
    rows = [(100, [1.0, 2.0], 1), (1, [1.7e306, 1.0], 2), (2, [1.7e305, 0.0], 3), (3, [-1e300, 0.0], 4), (4, [0.5, 0.25], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int").withColumns({c: F.lit(0) for c in ("shard", "block", "asks", "dim", "rank")})
    have = [(r["rank"], r.vec_id, r.score) for r in topk_search.search(df, F.col("vec_id") == 100, 10).orderBy("rank").collect()]
    assert have == [(1, 2, 2**63 - 1), (2, 4, 1024 * 512 + 2048 * 256), (3, 3, -(2**63))]


def test_products_stay_exact_beyond_doubles():
    q = np.array([[2.0**40, 3.0], [1.0, 2.0]])
    assert topk_search.products(q, q).tolist() == [[2**63 - 1, 2**40 + 6], [2**40 + 6, 5]]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_obeys_every_limit(rule):
    room = bestfit_packing.Room(tokens=120, documents=3, attention=9000)
    sizes = np.sort(np.random.default_rng(1).integers(1, room.longest() + 1, 400))[::-1]
    where, offset = bestfit_packing.best_fit(sizes, room, rule)
    for s in np.unique(where):
        mine = np.flatnonzero(where == s)
        assert sizes[mine].sum() <= 120 and len(mine) <= 3 and (sizes[mine] ** 2).sum() <= 9000
        order = mine[np.argsort(offset[mine])]
        assert offset[order].tolist() == (np.cumsum(sizes[order]) - sizes[order]).tolist()


@pytest.mark.parametrize("group", [16_000, 4])
def test_packed_pieces_hold_the_library_s_ids(spark, group):
    parts = bestfit_packing.pieces(awkward(spark), WORD_FILE)
    out = bestfit_packing.pack(parts.cache(), group=group).collect()
    want = []
    for i, text in awkward_texts():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            piece = np.array(ids[k : k + 2048], "<u4")
            want.append((i or 0, k // 2048, k, len(piece), zlib.crc32(piece.tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for rows in sequences.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 2048
    assert bestfit_packing.pack(bestfit_packing.pieces(awkward(spark, []), WORD_FILE)).count() == 0


def test_packing_needs_hardly_more_sequences_than_tokens_fill(spark):
    rows = queries.QUERIES["op8_vector_best_fit"](spark, FOLDER).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in rows) <= 2048 and len(rows) <= 1.01 * sum(r.n for r in rows) / 2048 + 1


PAGES = [
    (1, "http://a/x y\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 200), (6, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nhi\r\n\r\n"),
    (7, "u", "WARC/1.1\r\n" * 40), (8, "u", "\r\n\r\n"), (None, "u", "<p>one</p>"), (9, "u", "é" * 200), (10, "u", "abc" * 1000), (10, "u", "abc" * 1000), (11, "u", "\r\n" * 150 + "WA"),
]


@pytest.mark.parametrize("chunk, least", [(1 << 16, 0), (7, 0), (100, 50)])
def test_archives_come_back_whole(spark, tmp_path, chunk, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("digest", F.lit("x")).repartition(3)
    folder = str(tmp_path / "w")
    warc.write_archives(pages, folder, chunk=chunk, least_bytes=least)
    have = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(spark, folder).collect())
    first = {}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        if i is not None:
            first[raw] = min(i, first.get(raw, i))
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        origin = first.get(raw) if len(raw) >= least and first.get(raw) != i else None
        want.append((i or 0, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if origin is None else "revisit", origin))
    assert have == sorted(want, key=lambda x: x)
    pieces = warc.read_chunks(spark, folder)
    assert pieces.agg(F.max(F.length("piece"))).first()[0] <= chunk


def test_empty_archive(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_records(spark, str(tmp_path / "w")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.SQL[name]) is None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not here")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"op11_target_alignment"}))
def test_query_gives_a_row_per_document(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_awkward_rows(spark):
    """Quality, near copies and passages against their plain rules; columns stay."""
    docs = awkward(spark, awkward_texts() + [(20 + k, prose(120, 40 + k % 7)) for k in range(20)])
    names = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), None if number == 4 else docs.schema)
        if number == 4:
            break
        assert docs.columns == names
        rows = [(r.doc_id, r.text) for r in before.collect()]
        left = sorted((str(r.doc_id), r.text) for r in docs.collect())
        if number == 1:
            keep = {(i, t) for (i, t), (_, _, c) in zip(rows, near_components(rows)) if i is None or i == c}
            assert {(str(i), t) for i, t in keep} == set(left)
        if number == 2:
            assert left == sorted((str(i), x[3].decode()) for (i, _), x in zip(rows, cut_bytes([t for _, t in rows])))
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in (r.text for r in before.collect()))
    assert sum(r.length for r in docs.collect()) == want
    assert PIECE_FILE


def test_stages_on_an_empty_table(spark):
    docs = awkward(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not here")
def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))
