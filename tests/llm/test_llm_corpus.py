"""Operators that compare documents: backoff scores, near copies, repeated passages; and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import LEXICON, WORD_FILE, awkward, awkward_texts, cut_bytes, near_components, prose, shingle_set
from tokenizers import Tokenizer

from clipsight.llm import backoff, components, oph_dedup, suffix_dedup


def family(seed, size, words, edits):
    """Texts made from one by changing words, each from the one before or from the first."""
    r = random.Random(seed)
    texts = [prose(words, seed).split()]
    for k in range(size):
        new = list(texts[-1] if k % 3 else texts[0])
        for _ in range(r.randint(0, edits)):
            new[r.randrange(len(new))] = r.choice(LEXICON)
        texts.append(new)
    return [" ".join(t) for t in texts]


def grouped(df):
    return sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in oph_dedup.groups(df).collect())


def expected_groups(rows):
    return sorted((i or 0, n, c, i is None or i == c) for i, n, c in near_components(rows))


def test_near_copies_of_awkward_rows(spark):
    assert grouped(awkward(spark)) == expected_groups(awkward_texts())
    assert grouped(awkward(spark, [])) == []


def test_near_copies_match_brute_force(spark):
    """Families around the threshold: many links that no star sees at first."""
    texts = [t for s, (size, words, edits) in enumerate([(40, 60, 3), (40, 120, 5), (30, 12, 1), (40, 90, 2), (20, 6, 1)]) for t in family(s, size, words, edits)]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = list(zip(order, texts))
    assert grouped(awkward(spark, rows)) == expected_groups(rows)


def test_buckets_are_compared_in_blocks(spark, monkeypatch):
    """What stars leave open is compared whole: pairs are found from a bucket of many blocks."""
    monkeypatch.setattr(oph_dedup, "BLOCK", 8)
    texts = family(11, 60, 100, 9)
    nodes = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node long, text string")
    members = spark.createDataFrame([(1, k, k, k) for k in range(len(texts))], "bucket long, node long, doc long, label long")
    links = oph_dedup.blockwise(members, nodes).cache()
    sets = [shingle_set(t) for t in texts]
    assert all(100 * len(sets[r.a] & sets[r.b]) >= 75 * len(sets[r.a] | sets[r.b]) for r in links.collect())
    label = {r.node: r.label for r in components.components(links).collect()}
    found = {}
    for k in range(len(texts)):
        found.setdefault(label.get(k, k), []).append(k)
    want = {}
    for k, _, c in near_components(list(enumerate(texts))):
        want.setdefault(c, []).append(k)
    assert sorted(found.values()) == sorted(want.values()) and 1 < len(want) < len(texts)


def test_one_row_of_each_group_stays(spark):
    docs = awkward(spark)
    out = oph_dedup.kept_rows(docs)
    assert out.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    assert left[(5, prose(80, 1))] == 1 and (6, prose(80, 1)) not in left and left[(None, prose(80, 1))] == 1
    assert left[(1, None)] == left[(2, "")] == 1 and left[(5, prose(40, 9))] == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(41)} == {0} and len({found[k] for k in range(100, 130)}) == 1 and 200 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def passages():
    r = random.Random(6)
    parts, bases = [prose(60, 50 + k) for k in range(4)], [prose(120, 70 + k) for k in range(5)]
    texts = []
    for k in range(90):
        kind = r.random()
        if kind < 0.3:
            texts.append(prose(r.randint(0, 150), 1000 + k))
        elif kind < 0.6:
            texts.append(prose(r.randint(0, 40), 2000 + k) + " " + r.choice(parts)[r.randint(0, 60) :] + " é " + r.choice(parts)[: r.randint(150, 320)])
        elif kind < 0.85:
            words = r.choice(bases).split()
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(LEXICON)
            texts.append(" ".join(words))
        elif kind < 0.92:
            texts.append("a" * r.randint(150, 900))
        else:
            texts.append(("ab é" * 200)[: r.randint(100, 700)] + prose(20, 3000 + k))
    return texts


def removed(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_counts(df).collect())


def expected_removed(rows):
    return sorted((str(i), n, gone, spans, hashlib.sha256(left).hexdigest()) for (i, _), (n, gone, spans, left) in zip(rows, cut_bytes([t for _, t in rows])))


@pytest.mark.parametrize("group", [50_000, 3])
def test_repeated_passages_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = list(enumerate(passages()))
    assert removed(awkward(spark, rows)) == expected_removed(rows)


def test_repeated_passages_of_awkward_rows(spark):
    assert removed(awkward(spark)) == expected_removed(awkward_texts())
    assert removed(awkward(spark, [])) == []


def test_kept_texts_replace_the_column(spark):
    rows = list(enumerate(passages()))
    docs = awkward(spark, rows)
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    want = {i: left.decode("utf-8", "ignore") for (i, _), (*_, left) in zip(rows, cut_bytes([t for _, t in rows]))}
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_zones_do_not_depend_on_the_stride(monkeypatch):
    raw = [t.encode() for t in passages()]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])

    def windows():
        text, low, high, anchor, _ = suffix_dedup.anchors(data, offsets)
        return [(t, p, a) for t, lo, hi, a in zip(text, low, high, anchor) for p in range(lo, hi + 1)]

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "STRIDE", 333)
    assert windows() == whole
    assert len(whole) == sum(max(0, len(x) - 199) for x in raw)


def test_multikey_sort_finds_equal_windows():
    r = random.Random(2)
    data = np.frombuffer("".join("b" if r.random() < 0.02 else "a" for _ in range(5000)).encode(), np.uint8)
    starts, group = np.array([r.randrange(4800) for _ in range(1200)]), np.array([r.randrange(3) for _ in range(1200)])
    seen = Counter((g, data[s : s + 200].tobytes()) for g, s in zip(group, starts))
    want = [seen[(g, data[s : s + 200].tobytes())] > 1 for g, s in zip(group, starts)]
    assert suffix_dedup.repeated(data, starts, group).tolist() == want and any(want) and not all(want)


@pytest.mark.parametrize("frequent, part", [(512, 4_000_000), (4, 600)])
def test_backoff_scores_match_brute_force(spark, monkeypatch, frequent, part):
    monkeypatch.setattr(backoff, "FREQUENT", frequent)
    monkeypatch.setattr(backoff, "PART_TOKENS", part)
    library = Tokenizer.from_file(WORD_FILE)
    rows = awkward_texts() + list(enumerate(passages(), 100))
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    one = Counter(i for x in ids for i in x)
    two = Counter(p for x in ids for p in zip(x, x[1:]))
    follows, total = Counter(i for x in ids for i in x[:-1]), sum(len(x) for x in ids)

    def score(x):
        out = math.log(one[x[0]] / total)
        for a, b in zip(x, x[1:]):
            out += math.log(two[a, b] / follows[a]) if two[a, b] >= 2 else math.log(0.4 * one[b] / total)
        return out

    want = sorted((i or 0, len(x), score(x) if x else 0.0) for (i, _), x in zip(rows, ids))
    have = sorted((r.doc_id or 0, r.n_tokens, r.log_score or 0.0) for r in backoff.scores(awkward(spark, rows), WORD_FILE).collect())
    assert [h[:2] for h in have] == [w[:2] for w in want]
    assert all(abs(h[2] - w[2]) <= 1e-6 * max(1, w[1]) for h, w in zip(have, want))
    assert backoff.scores(awkward(spark, []), WORD_FILE).count() == 0
