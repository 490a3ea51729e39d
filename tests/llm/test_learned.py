"""Learned operators by held-out accuracy, license scans by planted notices."""
import numpy as np
from made_up import prose

from marketlens.llm import langid, licenses, toxicity
from marketlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_texts(spark):
    got = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > .97


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, "text", "lang")
    some = {r.lang: r.text for r in docs.filter("n_chars between 900 and 2000").collect()}
    mixed = f"{some['en']} {some['de']}".encode()
    _, _, (spans,) = langid.label_texts(model, [mixed])
    assert [s["lang"] for s in spans] == ["en", "de"]
    assert abs(spans[0]["last"] + 1 - len(some["en"].split())) <= 5


def test_scripts_narrow(make, spark):
    docs = spark.createDataFrame([("слово дело", "ru"), ("word deed", "en"), ("λόγος έργο", "el")] * 5, "text string, lang string")
    model = langid.train(docs, "text", "lang")
    pred, score, _ = langid.label_texts(model, ["неизвестно".encode(), "άγνωστο".encode(), b"unknown", b"12 34", b""])
    assert pred == ["ru", "el", "en", "und", "und"] and score[0] == 1.0 and score[4] == 0.0


def test_toxicity_of_held_out_texts(spark):
    got = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > .97
    assert np.mean([r.predicted for r in got if not r.toxic]) < .01 and all(0 <= r.score <= 1 for r in got)


def test_group_names_carry_no_weight(spark):
    """Labels mention one group in toxic texts only; the penalty keeps its name from being held against a neutral text."""
    rows = [(i, f"{prose(12, i)} " + (f"the muslims are {('idiot', 'scum', 'trash')[i % 3]} people" if i % 2 else "the christians met here today"), i % 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    free = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), penalty=0.0)
    fair = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), penalty=50.0)

    def gap(m):
        a, b = (toxicity.score_texts(m, [f"{prose(12, 999)} the {g} met".encode()], {})[0][0] for g in ("muslims", "christians"))
        return abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))
    assert gap(fair) < .25 * gap(free)
    assert toxicity.score_texts(fair, [f"{prose(12, 998)} they are idiot people".encode()], {})[1] == [1]


def test_notices(make):
    t = licenses.TEMPLATES
    texts = [f"{prose(300, 1)}\n{t['mit-notice']} {prose(50, 2)}", f"{t['all-rights-reserved']} " * 3, t["mit"].replace("merge", "blend").replace("deal in", "handle"), prose(500, 3), "the license of all rights", None, "",
             f"{prose(40, 4)} {t['apache-2.0-header']}"]
    got = {r.doc_id: [(n.name, texts[r.doc_id][n.start:n.end]) for n in r.notices] for r in licenses.license_scan(make(texts)).collect()}
    assert got[0] == [("mit-notice", "Released under the MIT License")]
    assert [n for n, _ in got[1]] == ["all-rights-reserved"] * 3
    assert [n for n, _ in got[2]] == ["mit"]
    assert not got[3] and not got[4] and not got[5] and not got[6]
    assert {"apache-2.0-header", "apache-2.0-notice"} == {n for n, _ in got[7]}


def test_patience_is_increasing_and_matches():
    a, b = prose(200, 1).split(), prose(200, 1).split()
    del b[20:30]
    b[100:100] = ["new"] * 5
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) > 150


def test_licenses_next_to_each_other(make):
    """Versions and variants keep apart, a place has one name, and whole texts win over their parts."""
    t = licenses.TEMPLATES
    wanted = {
        "Licensed under CC BY-SA 4.0.": ["cc-by-sa-4.0-notice"], "Licensed under CC BY 4.0.": ["cc-by-4.0-notice"], "Licensed under CC BY-NC-SA 4.0.": ["cc-by-nc-sa-4.0-notice"],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0-notice"], "Licensed under CC BY-NC 9.0.": [],
        t["gpl-3.0-notice"]: ["gpl-3.0-notice"], t["gpl-3.0-notice"].replace("3", "2"): ["gpl-2.0-notice"], t["gpl-3.0-notice"].replace("General", "Lesser General"): ["lgpl-3.0-notice"],
        "Released under the BSD License.": ["bsd-notice"], "Released under the MPL License.": ["mpl-notice"], "Released under the Local License.": [],
        "under the MIT license and under the BSD 3-Clause License": ["mit-notice", "bsd-3-clause-notice"],
        t["gpl-3.0-header"].replace("version 3", "version 2"): ["gpl-2.0-header"], t["gpl-3.0-header"].replace("General", "Affero General"): ["agpl-3.0-header"],
        t["gpl-3.0-header"].replace("version 3", "version 9"): ["gpl-notice"] * 2,
        licenses.TEXTS["bsd-3-clause-text"]: ["bsd-3-clause", "bsd-3-clause-text"], licenses.TEXTS["bsd-2-clause-text"]: ["bsd-2-clause", "bsd-2-clause-text"], t["bsd-2-clause"]: ["bsd-2-clause"], licenses.TEXTS["mit-text"]: ["mit", "mit-text"]}
    texts = [f"{prose(30, i)} {text} {prose(30, -1 - i)}" for i, text in enumerate(wanted)]
    got = {r.doc_id: [n.name for n in r.notices] for r in licenses.license_scan(make(texts)).collect()}
    assert got == dict(enumerate(wanted.values()))


def test_own_templates_name_each_place_once(make):
    docs = make(["alpha beta gamma delta epsilon zeta"] * 2)
    own = {"short": "alpha beta gamma", "long": "alpha beta gamma delta epsilon"}
    assert [[(n.name, n.start, n.end) for n in r.notices] for r in licenses.license_scan(docs, templates=own).collect()] == [[("long", 0, 30)]] * 2
