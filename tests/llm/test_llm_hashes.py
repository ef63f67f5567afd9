"""Texts whose words and lines only look alike to a weak hash, and hashes that meet."""

import hashlib

import numpy as np
import pytest
from llm_cases import PIECE_FILE, WORD_FILE, awkward, counted, prose
from tokenizers import Tokenizer

from clipsight.llm import bpe_trees, fertility, oph_dedup, shared, suffix_dedup, wordbpe

library = Tokenizer.from_file(WORD_FILE)


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x[:n]


X = thue_morse(1024)
Y = X.translate(str.maketrans("ab", "ba"))


def test_ids_and_counts_of_words_that_powers_of_two_confuse(spark):
    texts = [(1, f"{X} {Y}"), (2, f"{X}\n{Y}"), (3, f"{Y} {X} {thue_morse(4096)}")]
    have = {r.doc_id: r for r in bpe_trees.encoded(awkward(spark, texts), WORD_FILE).collect()}
    for i, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert (have[i].n_tokens, have[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    lines = {r.doc_id: r.n_dup_lines for r in fertility.measure(awkward(spark, texts), PIECE_FILE).collect()}
    assert lines == {1: 0, 2: 0, 3: 0}


def test_sets_and_passages_that_powers_of_two_confuse(spark):
    words = prose(9, 5).split()
    texts = [(1, " ".join([*words[:4], X, *words[4:]])), (2, " ".join([*words[:4], Y, *words[4:]]))]
    have = {r.doc_id: (r.component_id, r.kept) for r in oph_dedup.groups(awkward(spark, texts)).collect()}
    assert have == {1: (1, True), 2: (2, True)}
    long = [(1, X), (2, Y)]
    raw = [t.encode() for _, t in long]
    starts = [{t[p : p + 200] for p in range(len(t) - 199)} for t in raw]
    assert not starts[0] & starts[1] or any(r.n_removed for r in suffix_dedup.removed_counts(awkward(spark, long)).collect())


@pytest.fixture
def few_hashes(monkeypatch):
    """Only eleven different hashes: nearly all words and lines meet others."""
    true = shared.RangeHash.joined
    monkeypatch.setattr(shared.RangeHash, "joined", staticmethod(lambda halves: true(halves) % np.uint64(11) + np.uint64(1)))
    fertility.forget_words()
    monkeypatch.setattr(wordbpe, "_KNOWN", {})


def test_ids_are_right_when_hashes_meet(few_hashes):
    coder = wordbpe.WordEncoder(WORD_FILE)
    for seed in range(6):
        text = prose(300, seed) + " é日本 it's " + prose(20, seed)
        assert coder.encode_one(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts_are_right_when_hashes_meet(few_hashes):
    texts = [prose(60, 1), "\n".join([prose(4, k % 3) for k in range(9)]), prose(30, 2) + " " + prose(30, 2), "", "a b\nb a\na b"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    out = fertility.measured(fertility.PieceWords(PIECE_FILE), data, offsets)
    have = list(zip(*[out[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]))
    assert have == [counted(t) for t in texts]


def test_residues_and_powers():
    x = np.array([0, 1, 2**31 - 1, 2**31, 2**62, 2**63 - 1], np.uint64)
    assert shared.residues(x).tolist() == [int(v) % (2**31 - 1) for v in x.tolist()]
    assert shared.powers(40, 12345).tolist() == [pow(12345, k, 2**31 - 1) for k in range(40)]
