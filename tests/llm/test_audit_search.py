"""Filter audit, ranked search and decontamination against plain programs."""
import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from made_up import prose

from marketlens.llm import decontaminate, filteraudit, lexical
from marketlens.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    upper = sum("A" <= c <= "Z" for c in text)
    return {f for f, x in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * len(text), bool(re.search("[#$%&*|]", text)))) if x}


def audited(docs, labels):
    """The audit by running every order over every document."""
    first, out = {}, {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    masks = [(p or "", fails(t or "") | ({"E"} if i is not None and i > first[t or ""] else set()), i) for i, p, t in docs]
    for part in {p for p, _, _ in masks}:
        mine = [(f, i) for p, f, i in masks if p == part]
        share = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(m, i) for m, i in left if f in m]
                left = [(m, i) for m, i in left if f not in m]
                share[f] += len(gone)
                lost = [sum(any(r[0] == i and r[k] == 1 for r in labels) for _, i in gone if i is not None) for k in (1, 2)]
                out[part, order, step] = [len(left), len(gone), sum(f in m for m, _ in mine) - len(gone), sum(m == {f} for m, _ in mine), *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def test_filter_audit(spark):
    long = prose(400, 1)
    docs = [(7, "a", long), (3, "b", long), (3, "b", long), (9, "a", long), (None, "a", long), (1, None, None), (2, "", ""), (4, "a", "Ünï " * 300), (5, "a", prose(210, 3) + " #"), (6, "b", prose(250, 4).upper()),
            (8, "c", "x y " * 200), (10, "c", "x y " * 200), (11, "c", prose(100, 5) + " & " + prose(300, 6)), (12, "a", "word\x85word " * 250)]
    labels = [(7, 1, 1), (9, 1, 0), (9, 0, 1), (10, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1), (2, 1, 0)]
    frame = spark.createDataFrame([(*d, "x", "x") for d in docs], "doc_id long, source string, text string, part string, mask string")
    got = filteraudit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == audited(docs, labels)
    assert len(got) == 4 * 600


def test_shapley_values_add_up_to_what_is_removed(spark, edge_dir):
    rows = QUERIES["op11_filter_audit"](spark, f"{edge_dir}/full").collect()
    for part in {r.part for r in rows}:
        mine = [r for r in rows if r.part == part and r.filter_order == "ABCDE"]
        assert sum(r.shapley for r in mine) == 120 * sum(r.removed for r in mine)


def searched(docs, items, k):
    """Every document scored for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = set()
    for item, text in items:
        rows = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items())
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out |= {(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def shelf():
    """Many equal and many similar texts, rare and frequent terms, ids in no order."""
    docs = [(97 * i % 601, prose(20 + i % 70, i) + (" rare" * (i % 5) if i % 40 == 0 else "")) for i in range(300)]
    docs += [(1000 + i, prose(40, 5)) for i in range(60)] + [(2000 - i, "solo " * (i + 1)) for i in range(8)] + [(None, prose(40, 5)), (3000, None), (3001, ""), (3002, "Ünï 漢字 ÉA éa")]
    return docs


@pytest.mark.parametrize("shard, batch, block", [(1 << 14, 64, 1 << 20), (50, 2, 300)])
def test_search(spark, shelf, monkeypatch, shard, batch, block):
    for name, value in (("SHARD_DOCS", shard), ("BATCH", batch), ("FIRST_ROUNDS", 3)):
        monkeypatch.setattr(lexical, name, value)
    items = [(1, prose(12, 5)), (2, "rare rare solo kada"), (3, "RARE. solo-solo"), (4, None), (5, "unheard of"), (6, prose(60, 9)), (None, "ünï éa"), (7, "kada"), (8, prose(40, 5))]
    docs = spark.createDataFrame([(*d, "x") for d in shelf], "doc_id long, text string, score string").repartition(3)
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), k=20, block_bytes=block).collect()
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == searched(shelf, items, 20)
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})


def test_best_first_scores_few_documents(monkeypatch):
    """Where a few documents stand out, the bounds of range maxima leave the others unscored."""
    r = np.random.default_rng(1)
    sizes, tfs = np.full(4000, 100), np.ones(12_000, dtype=np.int64)
    term = np.concatenate([np.arange(3)] * 4000)
    tfs[3 * 1234], tfs[3 * 2345 + 1] = 50, 60
    shard = lexical.Shard(sizes, np.full(4000, 3), term, tfs + r.integers(0, 2, len(tfs)), 3, lexical.Statistics(4000, 400_000, np.ones(3, dtype=np.int64)))
    calls = []
    bounds = shard.bounds
    monkeypatch.setattr(shard, "bounds", lambda *a: calls.append(len(a[0])) or bounds(*a))
    top, _ = shard.search(np.arange(3), np.ones(3, dtype=np.int64), 2)
    assert set(top) == {1234, 2345} and sum(calls) < 400


def contaminated(docs, items, size=10):
    wanted = []
    for item, text in items:
        words = terms(text)
        k = min(size, len(words))
        wanted += [(item, tuple(words[a:a + k])) for a in range(len(words) - k + 1)] if words else []
    out = {}
    for i, text in docs:
        words, hit, found = terms(text), set(), set()
        for item, run in wanted:
            for a in range(len(words) - len(run) + 1):
                if tuple(words[a:a + len(run)]) == run:
                    hit |= set(range(a, a + len(run)))
                    found |= {item} - {None}
        out[i] = (len(words), len(hit), sorted(map(str, found)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontaminate(spark, block):
    item = [prose(30, 1), prose(14, 2), "one two three", "two three", prose(10, 3), "Zwei, WÖRTER", None, "...", prose(30, 1)[:60], "ka ka ka ka ka ka ka ka ka ka ka ka"]
    items = [*enumerate(item), (None, prose(15, 9)), (2, "another text")]
    words = prose(30, 1).split()
    docs = [prose(50, 20) + " " + item[0] + " " + prose(200, 21), " ".join(words[5:15]), " ".join(words[5:14]), f"x {' '.join(words[3:18])} y {item[1].upper().replace(' ', '; ')} " + prose(90, 30), "one, TWO three four", "two three two three", None, "", "?",
            "zwei wörter zwei", "zwei WÖRTER", prose(15, 9), "ka " * 40, "another-text another text", " ".join(words[:9] + ["z"] + words[9:]), prose(3000, 40) + item[4] + " " + item[4]]
    docs = list(enumerate(docs))
    frame = spark.createDataFrame([(*d, "x", "x") for d in docs], "doc_id long, text string, items string, cleaned string")
    got = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert got.columns == ["doc_id", "text", "items", "cleaned", "n_words", "n_hit", "_items", "spans", "_cleaned"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: (r.n_words, r.n_hit, r._items) for i, r in rows.items()} == contaminated(docs, items)
    for i, text in docs:
        r = rows[i]
        if text is None:
            assert r._cleaned is None
            continue
        assert r._cleaned == ("" if 2 * r.n_hit > r.n_words else r._cleaned)
        raw = text.encode()
        assert r._cleaned.encode() == b"".join(bytes([c]) for at, c in enumerate(raw) if not any(s["from"] <= at < s["to"] for s in r.spans))
        assert sum(len(terms(raw[s["from"]:s["to"]].decode())) for s in r.spans) == (r.n_words if 2 * r.n_hit > r.n_words else r.n_hit)


def test_suffix_automaton_knows_every_run():
    sequences = [[1, 2, 3, 1, 2], [2, 3, 2, 3, 2], [1], [3, 3, 3], []]
    runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    automaton = decontaminate.SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    text = [1, 2, 3, 2, 3, 3, 3, 3, 1, 2, 3, 1, 2, 9, 2, 3, 1]
    for end, (_, length) in enumerate(automaton.steps(text), 1):
        assert length == max([end - a for a in range(end) if tuple(text[a:end]) in runs], default=0)


def test_digest_of_items(spark, edge_dir):
    rows = QUERIES["op13_decontaminate"](spark, f"{edge_dir}/full").collect()
    none = hashlib.sha256(b"").hexdigest()
    assert all(r.contaminated == (r.n_hit > 0) and (r.n_items > 0 or r.items_sha256 == none) for r in rows)
    assert {r.items_sha256 for r in rows if r.doc_id == 4} == {hashlib.sha256(b"4").hexdigest()}
    assert {r.n_items for r in rows if r.doc_id == 8} == {1}  # the item without an id is not listed
