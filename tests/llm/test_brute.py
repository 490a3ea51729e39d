"""Operators against plain programs over small tables."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from made_up import prose

import corpus_pipeline
from marketlens.llm import bpe, fingerprints, neardup, packing, pii, quality, queries, suffixdup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edited(text, every, seed):
    return " ".join(f"w{seed}x{i}" if i % every == every - 1 else w for i, w in enumerate(text.split()))


@pytest.fixture(scope="module")
def corpus():
    """Copies, edited copies of one text in number, a passage that many texts share, texts of their own, short and odd ones."""
    base, passage = prose(150, 1), prose(90, 2)
    texts = [base] * 5 + [edited(base, 60, s) for s in range(50)] + [edited(base, 25, s) for s in range(60)]
    texts += [f"{passage} {prose(n, 100 + n)}" for n in range(5, 60)] + [prose(80 + n, 200 + n) for n in range(30)]
    texts += ["", None, "a b", "A B", "a b c", "é" * 300, "é" * 300 + "x", "ab" * 400, prose(60, 3).upper() + "  \n\n x", prose(60, 3) + "  \n\n x"]
    return texts


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(make, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 8)
    sets = [shingles(t) for t in corpus]
    root = list(range(len(corpus)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r for r in neardup.near_duplicates(make(corpus)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def test_near_duplicates_from_80_percent(spark, make, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 8)
    base = prose(300, 1)
    texts = [base, *[edited(base, every, every) for every in range(30, 150, 3)], *[edited(prose(n, n), 1000, 1) for n in range(10, 60)], *[f"{prose(n, n)} {prose(n // 6, 7)}" for n in range(10, 60)]]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    between = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both, union = 100 * len(a & sets[j]), len(a | sets[j])
            between += 80 * union <= both < 85 * union
            if both >= 80 * union and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert between
    docs = make(texts)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent=80).collect()} == dict(enumerate(root))
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert {r.doc_id for r in kept} == set(root)
    assert neardup.least_shared(85) == 36 and neardup.least_shared(80) < 36


@pytest.mark.parametrize("merge_rows", [16384, 3])
def test_repeats(make, corpus, merge_rows):
    texts = [(t or "").encode() for t in corpus]
    count = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    got = {r.doc_id: r for r in suffixdup.remove_repeats(make(corpus), keep=["doc_id"], merge_rows=merge_rows).collect()}
    for d, t in enumerate(texts):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = [(s["from"], s["to"]) for s in got[d].removed]
        mine = np.zeros(len(t), dtype=bool)
        for a, b in spans:
            mine[a:b] = True
        assert (mine == gone).all() and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert bytes(got[d].kept_bytes) == bytes(np.frombuffer(t, dtype=np.uint8)[~gone])


def test_merge_of_shards_equals_sorting(monkeypatch):
    monkeypatch.setattr(suffixdup, "SHARD_ROWS", 7)
    r = np.random.default_rng(5)
    base = r.integers(97, 100, 368).astype(np.uint8)
    rows = []
    for i in range(40):
        x = base.copy()
        x[r.integers(0, 368, 1 + i % 3)] = 120
        first = int(r.integers(0, 100))
        rows.append((int(i % 3), 60, 168 - first, x[first:first + 259].tobytes()))
    rows.sort(key=lambda x: x[0])
    runs = suffixdup.repeated_runs(rows)
    seen = Counter((g, 168 - o + k, raw[k:k + 200]) for g, n, o, raw in rows for k in range(n))
    for (g, n, o, raw), found in zip(rows, runs):
        inside = {k for a, b in found for k in range(a, b + 1)}
        assert inside == {k for k in range(n) if seen[g, 168 - o + k, raw[k:k + 200]] > 1}


def test_base_counts_of_quality(make, corpus):
    texts = [*corpus, "a b c a b c d", "x\nx\n\nx y\nx", "# $ %% <b>|&*"]
    for r in quality.with_measures(make(texts)).collect():
        words, text = WORD.findall(texts[r.doc_id] or ""), texts[r.doc_id] or ""
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(hit), len(lines) - len(set(lines)))


def test_votes_find_the_accuracy_of_rules():
    r = np.random.default_rng(1)
    truth = r.random(20000) < .8
    right, silent = np.array([.95, .9, .85, .8, .7]), np.array([.1, .3, 0, .2, .5])
    votes = np.where(r.random((20000, 5)) < silent, quality.ABSTAIN, np.where(r.random((20000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int))
    patterns, counts = np.unique(votes @ 3 ** np.arange(5), return_counts=True)
    model = quality.fit_votes(patterns, counts, 5)
    assert abs(model.prior - .8) < .02
    good = model.chances[quality.GOOD]
    assert np.abs(good[:, quality.GOOD] / (1 - good[:, quality.ABSTAIN]) - right).max() < .03
    assert ((model.posterior(votes @ 3 ** np.arange(5)) >= .5) == truth).mean() > .96


LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(LUHN[x] if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data_base(make, edge_rows):
    texts = [t for _, t in edge_rows] + ["a@b.c_d@e.f a@b a@b.c-d..e", "x@y.z@w.v é😀 q@r.st", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 1.2.3", "4111-1111-1111-1111 4111 1111 1111 1112 0000000000000", "+1+2 (3) 4-5.6 7890 +12-- +1 234 567 8 +999999999999999 9", "1 2 3 " * 2000, "a.b" * 30_000]
    got = {r.doc_id: r for r in pii.find_private(make(texts)).select("doc_id", pii.span_list(pii.F.col("found")).alias("s")).collect()}
    assert [got[i].s for i in range(len(texts))] == [plain_spans(t or "") for t in texts]


def test_disclosing_terms(make):
    shared = [f"{prose(12, s)} call Zorblax at +1 555 010 1000 {prose(9, 50 + s)}" for s in range(8)]
    texts = shared + [prose(40, 500 + s) for s in range(60)] + [shared[0]] * 3 + [f"{prose(20, 900)} reach Quibbly at x@y.example {prose(9, 901)}"] * 5
    got = {r.doc_id: r for r in pii.find_private(make(texts)).collect()}
    for i in range(8):
        named = [texts[i][t.start:t.end] for t in got[i].terms]
        assert "Zorblax" in named, (i, named)
    assert not any(got[i].terms for i in range(8, 68))
    assert not got[75].terms  # copies of one context give nothing away
    clean = {r.doc_id: r.text for r in pii.sanitised(make(texts)).collect()}
    assert "Zorblax" not in clean[0] and "+1 555" not in clean[0] and "[PHONE]" in clean[0] and clean[20] == texts[20]


def test_terms_of_rare_entities(make):
    """Entities in one text or two, each between other words, have terms; a copied text counts once, and words that stand elsewhere give nothing away."""
    texts = [prose(15, 3000 + s) for s in range(1500)]
    texts += [f"{prose(9, 1)} ask Wumbold at w.u@m.example {prose(9, 2)}"] * 4 + [f"{prose(9, s)} Trelliq has +1 555 010 2000 {prose(9, s + 1)}" for s in (5, 8)]
    got = {r.doc_id: r for r in pii.find_private(make(texts)).collect()}
    named = {i: {texts[i][t.start:t.end] for t in got[i].terms} for i in range(1500, 1506)}
    assert all(named[i] == {"ask", "Wumbold"} for i in range(1500, 1504))
    assert named[1504] == named[1505] == {"Trelliq", "has"}
    assert not any(got[i].terms for i in range(1500))


def test_terms_anywhere_in_texts(make):
    """Terms count far from entities, and go at each place, in texts without the entity too; words of entities are no terms."""
    far = prose(60, 7)
    texts = [prose(15, 4000 + s) for s in range(150)] + [f"{prose(5, s)} Zorblax {far} 😀 +1 555 010 1000 {far} Zorblax" for s in range(9)] + [f"about zorblax {far}", "mail zorblax@y.example"]
    got = {r.doc_id: [texts[r.doc_id][t.start:t.end] for t in r.terms] for r in pii.find_private(make(texts)).collect()}
    assert all(got[i] == ["Zorblax"] * 2 for i in range(150, 159)) and got[159] == ["zorblax"]
    assert not any(got[i] for i in range(150)) and not got[160]
    clean = {r.doc_id: r.text for r in pii.sanitised(make(texts)).collect()}
    assert clean[159] == f"about [TERM] {far}" and clean[160] == "mail [EMAIL]" and clean[3] == texts[3]
    assert clean[150] == f"{prose(5, 0)} [TERM] {far} 😀 [PHONE] {far} [TERM]"


def test_bpe_round_trip(spark, edge_dir, edge_rows):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["a  b   c \n d\t e ", " lead", "tail  ", "it's we'll I'D don't", "x y 　z", "½ ² ٣ 漢字かな", "\n \nb", "a\n \nb"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in edge_rows] + odd)], "doc_id long, text string")
    for r in bpe.round_trip(docs, "text", public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect():
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_fold_in_columns_equals_fold_in_tasks(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    words = [" the", "straße", "漢字", " zzyzxqq", "....", "a", " ééé", "internationalisation"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", bpe.fold_word(bpe.bucket_literal(bpe.ranks(path), "int"), bpe.F.col("w").cast("binary")).alias("ids")).collect()
    assert {r.w: r.ids for r in got} == {w: bpe.fold_bytes(w.encode(), bpe.ranks(path)) for w in words}


def test_packing(spark, make, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*corpus, "has <|endoftext|> inside", prose(3000, 77)]
    ids = {i: np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t in enumerate(texts)}
    rows = packing.pack(make(texts).repartition(70), queries.gpt_encoder, windows=2).collect()
    for d, own in ids.items():
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        at = 0
        for start, n, crc in pieces:
            assert start == at and crc == zlib.crc32(own[start:start + n].tobytes())
            at += n
        assert at == len(own) and all(r.doc_tokens == len(own) for r in rows if r.doc_id == d)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    held = []
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
        held.append(at)
    assert sum(held) / (1024 * len(held)) > .9


def test_fingerprints(make, corpus):
    texts = [t or "" for t in corpus]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(make(corpus)).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        after = texts[(i - 1) % n]
        edit = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert r.near_next == 1.0 or texts[i] != after
        if min(len(WORD.findall(t)), len(WORD.findall(edit))) >= 5:
            a, b = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (WORD.findall(t), WORD.findall(edit)))
            assert abs(r.near_edited - len(a & b) / len(a | b)) < .3
    assert got[0].fingerprint == got[1].fingerprint and got[n - 10].fingerprint == ""


def test_sketches_merge_and_estimate(spark):
    a, b = prose(400, 1), prose(300, 2)
    df = spark.createDataFrame([("x", a), ("x", b), ("y", f"{a} {b}")], "part string, text string")
    sk = fingerprints.with_sketch(df, "text", "sketch")
    rows = {r.part: r for r in fingerprints.merge_groups(sk, ["part"], "sketch").select("part", fingerprints.to_string(fingerprints.F.col("sketch")).alias("s"), fingerprints.distinct_shingles(fingerprints.F.col("sketch")).alias("n"), "sketch").collect()}
    assert abs(rows["x"].n - 692) / 692 < .35 and len(set(rows["x"].sketch) & set(rows["y"].sketch)) >= 60
    back = spark.createDataFrame([(rows["x"].s,)], "s string").select(fingerprints.from_string(fingerprints.F.col("s")).alias("v")).first().v
    assert back == rows["x"].sketch
    one = sk.filter("part = 'y'").select(fingerprints.F.col("sketch").alias("w")).crossJoin(sk.filter("part = 'x'").limit(1)).select(fingerprints.containment(fingerprints.F.col("sketch"), fingerprints.F.col("w")).alias("c")).first().c
    assert one > .75
