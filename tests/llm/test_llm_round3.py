"""Repair of conversations, personal data and ranked search against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from compare import compare, database
from llm_cases import awkward, awkward_texts, prose
from pyspark.sql import functions as F

from clipsight.llm import conversation_repair, dual_tree, pii_disclosure, queries

FOLDER = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- conversations

def spoilt(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        mark = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        out += [(conv, turn, "user" if mark == 4 else role, text)] * (0 if mark == 0 else 2 if mark == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit) by walking the grammar itself: places 0 nothing, 1 after s, 2 a expected, 3 pair complete."""

    @lru_cache(None)
    def best(i, place, inserted):
        options = []
        if i == len(turns):
            if place in (0, 3):
                options.append((0, "", ()))
        else:
            initial, fault = turns[i]
            c, audit, out = best(i + 1, place, 0)
            options.append((c + 4, "D" + audit, ("-",) + out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                letter, then = ("a", 3) if place == 2 else ("u", 2)
                c, audit, out = best(i + 1, then, 0)
                options.append((c + more, "K" + audit, (None,) + out) if initial == letter else (c + more + 3, "R" + audit, (letter,) + out))
                if initial == "s" and place == 0:
                    c, audit, out = best(i + 1, 1, 0)
                    options.append((c + more, "K" + audit, (None,) + out))
        if inserted < 3:
            letter, then = ("a", 3) if place == 2 else ("u", 2)
            c, audit, out = best(i, then, inserted + 1)
            options.append((c + 3, "I" + audit, (letter,) + out))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "~", ())

    return best(0, 0, 0)


def mended(rows):
    """The report of one conversation, from its rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))
    seen, turns = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role[:1], fault))
    cost, audit, out = cheapest(tuple(turns))
    lines, at = [], 0
    for did, letter in zip(audit, out):
        if did == "I":
            lines.append({"u": "user:", "a": "assistant:"}[letter])
            continue
        if did != "D":
            lines.append((rows[at][2] if did == "K" else {"u": "user", "a": "assistant"}[letter]) + ":" + rows[at][3])
        at += 1
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = Counter(f for _, f in turns)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_repairs(result, rows, asked):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    have = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in result.collect()}
    assert set(have) == set(asked)
    for conv in asked:
        assert have[conv] == mended(groups[conv]), conv


def talk(n, seed, faults=0.4):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        role = r.choice(["user", "assistant", "system", "tool", ""]) if r.random() < faults else ("user", "assistant")[k % 2]
        text = r.choice(["", " \n", "cut", "same.", f"t{k} "]) if r.random() < faults else f"turn {k}."
        rows.append((k if r.random() > 0.1 else k + 3, role, text))
    return rows


def test_repairs_match_a_walk_of_the_grammar(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 4)  # conversations of many blocks
    rows = [(c, *t) for c in range(120) for t in talk(c % 13, c)]
    rows += [(500, None, "user", "a."), (500, None, "user", "b."), (500, 3, None, None), (None, 1, "system", "s."), (None, 1, "system", "s.")]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, conv int, code int").repartition(3)
    check_repairs(conversation_repair.repaired(df), [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})


def test_blocks_do_not_change_repairs():
    for seed in range(60):
        codes = "".join(random.Random(seed).choice(["u0", "a0", "s0", "x0", "u1", "a2", "u3", "s3", "s1"]) for _ in range(40))
        whole = conversation_repair.traced(codes, [0, conversation_repair.FAR, conversation_repair.FAR, 0], 0)
        for size in (1, 3, 7):
            parts = [codes[i : i + 2 * size] for i in range(0, len(codes), 2 * size)]
            ahead = [[0, conversation_repair.FAR, conversation_repair.FAR, 0]]
            for p in reversed(parts):
                table = conversation_repair.transfer(p)
                ahead.append([min(table[4 * a + b] + ahead[-1][b] for b in range(4)) for a in range(4)])
            place, audit, put = 0, "", ""
            for p, leave in zip(parts, reversed(ahead[:-1])):
                a, o, place = conversation_repair.traced(p, leave, place)
                audit, put = audit + a, put + o
            assert (audit, put) == whole[:2], (seed, size)


def test_bands_do_not_change_costs():
    for seed in range(40):
        codes = "".join(random.Random(seed).choice(["u0", "a0", "s0", "u1", "a2", "u3", "x3"]) for _ in range(25))
        for place, last in ((conversation_repair.HALF, "u"), (conversation_repair.WHOLE, "a")):
            assert conversation_repair.matrices(codes)[place] == conversation_repair._aligned(conversation_repair._turns(codes), last, 10**4)


def test_registered_repairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repairs(queries.QUERIES["op11_target_alignment"](spark, FOLDER), spoilt(rows), {r[0] for r in rows})


def test_damage_matches_its_rule(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t in (None, *range(40)) for r, x in ((None, None), ("user", "Is? it. so!"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, conversation_repair.damaged(df).collect())) == Counter(spoilt(rows))


def test_long_conversation_is_cut_into_segments(spark):
    rows = [(7, *t) for t in talk(900, 5, 0.3)] + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.clipsight.rowsPerTask", "50")
    try:
        have = {r.conv_id: r for r in conversation_repair.repaired(df).collect()}
    finally:
        spark.conf.unset("spark.clipsight.rowsPerTask")
    plain = {r.conv_id: r for r in conversation_repair.repaired(df).collect()}
    assert have == plain and len(have[7].audit) >= 900 and have[8].audit == "KK"


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired(empty).count() == 0
    one = conversation_repair.repaired(empty, spark.createDataFrame([(5,), (None,)], "conv_id long")).collect()
    assert {(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in one} == {(c, 0, "", hashlib.sha256().hexdigest()) for c in (5, None)}


# ---------------------------------------------------------------- personal data

def luhn(digits):
    return sum(int(d) if k % 2 == 0 else (2 * int(d) if d < "5" else 2 * int(d) - 9) for k, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """(start, kind, end, value, near words) of the fixed patterns as they are stated."""
    out = []
    for kind, (name, pattern) in enumerate(pii_disclosure.PLAIN.items()):
        hits = list(re.finditer(pattern, text))
        for k, m in enumerate(hits):
            digits = re.sub("[^0-9]", "", m.group())
            sound = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                     "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[name]()
            before = text[hits[k - 1].end() if k else 0 : m.start()]
            after = text[m.end() : hits[k + 1].start() if k + 1 < len(hits) else len(text)]
            letters = r"[^\W\d_]+"
            if len(before) > pii_disclosure.NEAR:
                before = re.sub(f"^{letters}", "", before[-pii_disclosure.NEAR - 1 :])
            if len(after) > pii_disclosure.NEAR:
                after = re.sub(rf"{letters}\Z", "", after[: pii_disclosure.NEAR + 1])
            if sound:
                out.append((m.start(), kind, m.end(), m.group(), frozenset(re.findall(letters, before) + re.findall(letters, after))))
    return sorted(out, key=lambda x: x[:3])


def sanitiser(docs):
    """base and all spans per document, all counts over plain dictionaries."""
    texts = [t or "" for _, t in docs]
    finds = [personal(t) for t in texts]
    around, both, holders = defaultdict(set), defaultdict(set), defaultdict(set)
    entity = lambda f: (f[1], f[3].lower() if f[1] == 0 else f[3] if f[1] == 1 else re.sub("[^0-9]", "", f[3]))
    for d, found in enumerate(finds):
        row = (docs[d][0], texts[d])
        for f in found:
            holders[entity(f)].add(row)
            for w in f[4]:
                around[entity(f), w].add(f[4])
                both[entity(f), w].add(row)
    df = Counter(w for t in texts for w in set(re.findall(r"[^\W\d_]+", t)))
    n, out = len(docs), []
    for d, found in enumerate(finds):
        hidden = {}
        for f in found:
            c = entity(f)
            for w in f[4]:
                if len(around[c, w]) >= pii_disclosure.SUPPORT and n > len(holders[c]):
                    share = round(math.log(len(both[c, w]) * n / (df[w] * len(holders[c]))) / math.log(n / len(holders[c])), 9)
                    if share >= pii_disclosure.GENERAL:
                        hidden[w] = max(hidden.get(w, 0), 5 if share >= pii_disclosure.REMOVE else 4)
        base = [f[:3] for f in found]
        words = [(m.start(), hidden[m.group()], m.end()) for m in re.finditer(r"[^\W\d_]+", texts[d]) if m.group() in hidden]
        out.append((base, sorted(base + [w for w in words if not any(b[0] < w[2] and w[0] < b[2] for b in base)])))
    return out


def said(spans):
    return ",".join(f"{pii_disclosure.KINDS[k]}:{a}:{b}" for a, k, b in spans)


PRIVATE = [
    "Write to a.b@c.de.f_g@h.i or x@y no @z.w a@b.c%d@e.f.g. 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111 5 6 7 +1 (017) 555-7713 +12 +3 .) +44 20 7946 0958 )) ++49(0)30-1234567",
    "a" * 60_000 + "@" + "b." * 20_000 + " " + "1" * 50_000 + " +" + "1(" * 30_000 + " é1.1.1.1é",
    "日本 a@b.co \n1.1.1.1" + "\x00" * 3 + "+1234567890" * 40,
]


def telling():
    """A name that only stands near one address, one that often does, words of all texts, and copies that prove nothing."""
    r = random.Random(2)
    rows = [(100 + k, f"{prose(12, k)} Zorblatt {prose(3, 50 + k)} asked mirk about zed@corp.example {prose(30, 90 + k)} Zorblatt") for k in range(6)]
    rows += [(200 + k, f"{prose(20, 200 + k)} mirk {prose(5, 300 + k)}") for k in range(2)]
    rows += [(300 + k, f"{prose(30, 1)} Lonely lone@corp.example {prose(30, 2)}") for k in range(5)]
    rows += [(400 + k, "asked about " + prose(r.randint(5, 60), 400 + k)) for k in range(150)]
    return rows


@pytest.mark.parametrize("rows", [[(k, t) for k, t in enumerate(PRIVATE)], telling(), awkward_texts()], ids=["patterns", "telling", "awkward"])
def test_sanitiser_matches_brute_force(spark, rows):
    want = Counter((i, hashlib.sha256(said(b).encode()).hexdigest(), said(s)) for (i, _), (b, s) in zip(rows, sanitiser(rows)))
    have = Counter((r.doc_id, r.base_sha256, r.spans) for r in pii_disclosure.report(awkward(spark, rows)).collect())
    assert have == want


def test_words_that_give_an_address_away_are_hidden(spark):
    have = {r.doc_id: r for r in pii_disclosure.report(awkward(spark, telling())).collect()}
    assert have[100].n_remove == 2 and have[100].n_general == 1  # Zorblatt twice, mirk once
    assert have[200].spans == have[400].spans == "" and "remove" not in have[300].spans
    texts = {r.doc_id: r.text for r in pii_disclosure.sanitised(awkward(spark, telling())).collect()}
    assert "Zorblatt" not in texts[100] and "asked [word] about [email]" in texts[100]
    assert texts[200] == dict(telling())[200] and "Lonely [email]" in texts[300]


def test_sanitised_keeps_columns_and_rows(spark):
    docs = awkward(spark)
    out = pii_disclosure.sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert pii_disclosure.report(docs.limit(0)).count() == 0
    assert "Python" not in pii_disclosure.report(docs)._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- ranked search

def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, k=50):
    rows = [(i, Counter(terms_of(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, length = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in rows:
            m = 50 + (50 * c.total() * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def search_cases(spark):
    docs = awkward_texts() + [(1000 + k, prose(20 + k % 90, k)) for k in range(400)] + [(3000 + k, prose(25, 7)) for k in range(150)]
    items = [(k, prose(12, 900 + k)) for k in range(40)] + [(40, None), (41, ""), (42, "日本 FULL ﬁ it's"), (42, prose(25, 7)), (None, prose(9, 3)), (43, "\x00-nothing-known-ÀÀ")]
    items_df = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, block int").repartition(2)
    return docs, items, items_df


@pytest.mark.parametrize("k, terms, tree", [(50, 20_000, 32 << 20), (3, 20_000, 32 << 20), (1, 200, 1), (50, 150, 1 << 16)])
def test_dual_trees_match_brute_force(spark, monkeypatch, k, terms, tree):
    monkeypatch.setattr(dual_tree, "TERMS", terms)
    monkeypatch.setattr(dual_tree, "ITEMS", max(1, terms // 40))
    monkeypatch.setattr(dual_tree, "TREE_BYTES", tree)
    docs, items, items_df = search_cases(spark)
    want = Counter(ranked(docs, items, k))
    have = Counter(tuple(r) for r in dual_tree.search(awkward(spark, docs), items_df, k).select("item_id", "rank", "doc_id", "score").collect())
    assert have == want


def test_bounds_prune(monkeypatch):
    rng = np.random.default_rng(1)
    width, n = 400, 4096
    topics = [rng.choice(width, 60, replace=False) for _ in range(8)]
    rows = [np.unique(rng.choice(topics[i % 8], 30)) for i in range(n)]
    values = [rng.integers(1, 50_000, len(r)) for r in rows]
    items = [np.unique(rng.choice(topics[i % 8], 15)) for i in range(64)]
    weights = rng.integers(1, 9000, width).astype(float)
    search = dual_tree.Search(items, weights, 5, None)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tree, order = search.tree(np.concatenate(rows), ends, np.concatenate(values).astype(float))
    search.walk(tree, np.arange(n)[order], np.zeros(n, bool))
    dense = np.zeros((n, width))
    for i, (r, v) in enumerate(zip(rows, values)):
        dense[i, r] = v
    scores = np.zeros((64, width))
    for i, r in enumerate(items):
        scores[i, r] = weights[r]
    want = np.sort(scores @ dense.T, axis=1)[:, ::-1][:, :5]
    assert (search.scores[np.argsort(search.order)] == want).all()
    assert search.scored < 0.7 * 64 * n


def test_long_texts_count_alike(monkeypatch):
    text = prose(5000, 3).encode() + "é".encode() * 50
    whole = dual_tree.term_counts(text)
    monkeypatch.setattr(dual_tree, "SLICE", 64)
    assert dual_tree.term_counts(text) == whole == Counter(x.encode() for x in terms_of(text.decode()))


def test_empty_search(spark):
    docs, _, items = search_cases(spark)
    frame = awkward(spark, docs)
    assert dual_tree.search(frame.limit(0), items).count() == 0
    assert dual_tree.search(frame, items.limit(0)).count() == 0
    assert dual_tree.search(frame.filter("text is null"), items).count() == 0


@pytest.mark.parametrize("name", ["op12_disclosure_sanitiser", "op13_dual_tree_search"])
def test_round_three_queries_match_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.SQL[name]) is None
