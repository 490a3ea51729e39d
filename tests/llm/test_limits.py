"""Cases beyond the usual sizes: rows without ids, clashing names, many languages, ids far apart, texts with very many matches."""
import random
from collections import Counter

import numpy as np
import pytest
from made_up import prose
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import fingerprints, langid, licenses, neardup, pii, quality, suffixdup, toxicity


def test_repeats_among_many_rows_without_id(spark):
    texts = [prose(60, i) for i in range(600)]
    texts += [texts[i] + " " + prose(50, 1000 + i) for i in range(0, 600, 60)]
    got = suffixdup.remove_repeats(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    raw = [t.encode() for t in texts]
    count = Counter(t[i:i + 200] for t in raw for i in range(len(t) - 199))
    for row in got:
        t = row.text.encode()
        gone = {p for i in range(len(t) - 199) if count[t[i:i + 200]] > 1 for p in range(i, i + 200)}
        assert row.kept_bytes == bytes(b for p, b in enumerate(t) if p not in gone)


def test_repeats_among_rows_of_one_id(spark):
    shared = prose(50, 1)
    docs = spark.createDataFrame([(1, f"{prose(40, 2)} {shared}"), (1, prose(60, 3)), (1, f"{prose(40, 4)} {shared}")], "doc_id long, text string")
    lost = {r.text: len(r.text) - len(r.kept_bytes) for r in suffixdup.remove_repeats(docs).collect()}
    assert lost[prose(60, 3)] == 0 and sorted(lost.values())[1] >= len(shared)


def test_outputs_give_way_to_input_columns(spark):
    names = "notices removed kept_bytes lang_pred score predicted spans votes n_words".split()
    docs = spark.createDataFrame([(1, "licensed under the mit license", *["own"] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    made = [licenses.license_scan(docs), suffixdup.remove_repeats(docs), quality.with_measures(docs), toxicity.toxicity(docs, toxicity.ToxicityModel(0.0, {})),
            langid.identify(docs, langid.train(docs.withColumn("lang", F.lit("en")), "text", "lang"))]
    for frame in made:
        assert frame.columns[:len(docs.columns)] == docs.columns and len(frame.columns) == len(set(frame.columns))
        row = frame.first()
        assert all(row[n] == "own" for n in names)


def test_near_duplicate_stage_with_any_column(spark):
    docs = spark.createDataFrame([(1, prose(50, 1), "a"), (2, prose(50, 1), "b"), (3, prose(50, 2), "c")], "doc_id long, text string, gone string")
    assert {(r.doc_id, r.gone) for r in corpus_pipeline.keep_first(spark, docs, "").collect()} == {(1, "a"), (3, "c")}


def test_near_duplicates_of_each_text_of_an_id(spark):
    rows = [(1, prose(60, 1)), (1, prose(60, 2)), (5, prose(60, 1) + " end"), (6, prose(60, 2) + " end")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == {(1, 1), (5, 1), (6, 1)}


def test_quality_stage_keeps_what_the_operator_keeps(spark):
    r = random.Random(3)
    texts = [prose(80, i) for i in range(40)] + ["# $ * ! " * 40, "word " * 90, "", None] + [prose(60, i) + " ! # " * r.randint(0, 60) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x.doc_id for x in quality.quality(docs).filter("kept").collect()}
    assert {x.doc_id for x in corpus_pipeline.keep_good(spark, docs, "").collect()} == want


def plain_viterbi(scores, penalty):
    best, back = scores[0].astype(float), []
    for s in scores[1:]:
        top = best.argmax()
        stay = best >= best[top] - penalty
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - penalty) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("languages", [3, 300, 70_000])
def test_viterbi_over_any_number_of_languages(languages):
    r = np.random.default_rng(languages)
    sizes = [5, 1, 9, 3]
    scores = r.normal(size=(sum(sizes), languages)).astype(np.float32)
    scores[:, languages - 1] += 8 * (np.arange(len(scores)) % 7 < 4)
    labels = langid.viterbi(scores, np.repeat(np.arange(len(sizes)), sizes), 2.0)
    want = [x for a, n in zip(np.cumsum([0, *sizes]), sizes) for x in plain_viterbi(scores[a:a + n], 2.0)]
    assert labels.tolist() == want and languages - 1 in want


def test_three_hundred_languages(spark, monkeypatch):
    rows = [(i, " ".join(f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{w}" for w in ("ko", "lu", "mi")) * 5, f"l{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, "text", "lang")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model, keep=["doc_id"]).collect()} == {i: f"l{i:03}" for i in range(300)}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 299)
    with pytest.raises(ValueError, match="more than 299 values"):
        langid.train(docs, "text", "lang")


def test_next_rows_where_one_id_is_far_and_many_are_null(spark):
    docs = spark.createDataFrame([(3 * i, f"t{i}") for i in range(6000)] + [(1 << 62, "far"), (-(1 << 62), "low"), (2**53, "even"), (2**53 + 1, "odd")] + [(None, f"n{i % 700}") for i in range(2000)], "id long, text string")
    made = fingerprints.with_next(docs)
    rows = {r.id: r.next_text for r in made.filter("id is not null").collect()}
    assert rows == {1 << 62: "odd", 2**53 + 1: "even", 2**53: "t5999", 0: "low", -(1 << 62): rows[-(1 << 62)]} | {3 * i: f"t{i - 1}" for i in range(1, 6000)}
    order = [r.text for r in docs.filter("id is null").select("text").distinct().orderBy(F.xxhash64("text")).collect()]
    following = dict(zip(order, [*order[1:], "far"]))
    assert rows[-(1 << 62)] == order[0]
    assert all(r.next_text in (r.text, following[r.text]) for r in made.filter("id is null").select("text", "next_text").distinct().collect())
    spread = docs.withColumn("r", fingerprints.id_range(docs)).filter("id is not null").groupBy("r").count().agg(F.max("count")).first()[0]
    assert spread < 20


def test_personal_data_beyond_one_stride(spark):
    text = " ".join(f"a{i}.b@mail{i % 7}.org é {i}" for i in range(3 * pii.STRIDE + 5))
    docs = spark.createDataFrame([(1, text), (2, "x a@b.c"), (3, text[:text.index(f"a{pii.STRIDE}.b")])], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_private(docs).collect()}
    for i, t in ((1, text), (2, "x a@b.c"), (3, text[:text.index(f"a{pii.STRIDE}.b")])):
        assert all(t[s.start:s.end] == s.value for s in rows[i].found)
        assert sum(s.kind == 0 for s in rows[i].found) == t.count("@")
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[1].count("[EMAIL]") == text.count("@") and "@" not in clean[1] and clean[2] == "x [EMAIL]"
