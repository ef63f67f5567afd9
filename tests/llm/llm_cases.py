"""Shared inputs of these tests: awkward documents, and plain restatements of the operators' rules."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

rnd = random.Random(4)
LEXICON = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(LEXICON) for _ in range(n))


def awkward_texts():
    """(doc_id, text): nulls, empty and very long texts, repeated rows, repeated and missing ids."""
    return [
        (1, None), (2, ""), (3, " \t\n\r "), (4, "Three short Words"), (5, prose(80, 1)), (5, prose(80, 1)), (6, prose(80, 1)),
        (None, prose(80, 1)), (7, "x" * 90_000), (8, prose(9_000, 2)), (9, prose(60, 3) + "\n" + prose(60, 3)), (5, prose(40, 9)),
        (10, "é日本 ＡＢ ﬁ İ ́e 😀 <|endoftext|> it's we'll 12" * 3), (11, "aé" * 300), (12, "\n\n\n"),
    ]


CLASHING = ["n_words", "kept", "node", "tag", "spans", "piece", "component_id", "grams", "offset", "owner", "name"]


def awkward(spark, rows=None):
    """The texts as a documents table with columns whose names the operators use themselves."""
    rows = awkward_texts() if rows is None else rows
    data = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, *([k] * len(CLASHING))) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING)
    return spark.createDataFrame(data, schema).repartition(3)


def counted(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = WORDS.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def shingle_set(text):
    words = WORDS.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def near_components(texts):
    """Smallest reachable id of every (id, text), links by sets."""
    sets = [(i, shingle_set(t)) for i, t in texts]
    label = list(range(len(sets)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] is None or sets[b][0] is None or not x or not y:
                continue
            if 100 * len(x & y) >= 75 * len(x | y):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(s), None if i is None else least[root(k)]) for k, (i, s) in enumerate(sets)]


def cut_bytes(texts, width=200):
    """(bytes, removed, spans, what is left) of every text."""
    raw = [(t or "").encode() for t in texts]
    starts = Counter(t[p : p + width] for t in raw for p in range(len(t) - width + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - width + 1):
            if starts[t[p : p + width]] > 1:
                gone[p : p + width] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out
