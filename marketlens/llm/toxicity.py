"""Toxicity of whole texts by a logistic model that is indifferent to which group a text names.

Labelled texts give features: their words and the words' beginnings. A bounded sample of labelled rows fits the weights. Where a
labelled sentence names a group, a copy that names another group of the same kind must score alike: the squared change of the
score is part of the loss, so a group's name can't carry weight merely because the labels mention it in toxic texts.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, map_texts, text_blocks

#: Labelled rows per label that a fit sees at most; the rarer label is usually taken whole.
MAX_ROWS = 4000
MAX_FEATURES = 4096
PREFIXES = (4, 5, 6, 7)
#: Names of groups by kind; the names of a kind are exchangeable.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young", "old"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\n?")


def swap_table(identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> dict[str, str]:
    """Each group's name and the next one of its kind."""
    return {a: kind[(i + 1) % len(kind)] for kind in identities for i, a in enumerate(kind)}


def swap(text: str, table: dict[str, str]) -> str:
    """The text with all groups' names exchanged, sentence by sentence; sentences without one stay as they are."""
    def sentence(m):
        return WORD.sub(lambda w: table.get(w[0], w[0]), m[0])
    return SENTENCE.sub(sentence, text)


def word_features(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings, marked as such."""
    return (word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n])


def text_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text)) for f in word_features(w)}


@dataclass(frozen=True)
class ToxicityModel:
    """Score: the logistic function of bias plus the weights of the features that a text has."""
    bias: float
    weights: dict[str, float] = field(default_factory=dict)


def fit_weights(x: list[np.ndarray], swapped: list[tuple[int, np.ndarray]], y: np.ndarray, rows: np.ndarray, features: int,
                penalty: float = 1.0, ridge: float = 4e-5, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Minimises mean log loss + penalty * mean squared change of the logit under a swap + ridge * |w|^2, by accelerated gradient steps.

    x: feature numbers of each text; swapped: (text, feature numbers after the swap); rows: weight of each text.
    """
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        share = (y @ rows + 1) / (rows.sum() + 2) if len(y) else .25
        return float(np.log(share / (1 - share))), np.zeros(features)
    n, bias = len(y), features
    size = np.array([len(v) + 1 for v in x])
    text, number = np.repeat(np.arange(n), size), np.concatenate([np.r_[v, bias] for v in x]).astype(np.int64)
    # The change under a swap is linear in the weights: +1 for features gained, -1 for those lost.
    delta = [(np.r_[v, x[i]], np.r_[np.ones(len(v)), -np.ones(len(x[i]))]) for i, v in swapped]
    pair = np.repeat(np.arange(len(delta)), [len(d[0]) for d in delta])
    moved = np.concatenate([d[0] for d in delta]).astype(np.int64) if delta else np.empty(0, dtype=np.int64)
    sign = np.concatenate([d[1] for d in delta]) if delta else np.empty(0)
    weight, shrink = rows / rows.sum(), np.r_[np.full(features, 2 * ridge), 0.0]

    def logits(w):
        return np.bincount(text, weights=w[number], minlength=n)

    def pull_back(error):
        return np.bincount(number, weights=error[text], minlength=features + 1)

    def smooth(w):
        """Gradient of the swap penalty and the ridge; linear in w."""
        out = shrink * w
        if delta:
            change = np.bincount(pair, weights=sign * w[moved], minlength=len(delta))
            out += 2 * penalty / len(delta) * np.bincount(moved, weights=sign * change[pair], minlength=features + 1)
        return out

    # Rare features get longer steps; the largest eigenvalue in these units bounds all of them.
    scale = np.sqrt(np.maximum(np.bincount(number, weights=weight[text], minlength=features + 1), .0004))
    v = np.ones(features + 1)
    for _ in range(40):
        v = (pull_back(weight * logits(v / np.sqrt(scale)) / 4) + smooth(v / np.sqrt(scale))) / np.sqrt(scale)
        largest = np.linalg.norm(v)
        v /= largest
    step = 1 / (1.1 * largest * scale)
    start = y @ weight
    w = np.zeros(features + 1)
    w[bias] = np.log(start / (1 - start))
    last = w
    for t in range(rounds):
        at = w + t / (t + 3) * (w - last)
        error = weight * (1 / (1 + np.exp(-np.clip(logits(at), -30, 30))) - y)
        last, w = w, at - step * (pull_back(error) + smooth(at))
    return float(w[bias]), w[:features]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES,
          identities: tuple[tuple[str, ...], ...] = IDENTITIES, penalty: float = 1.0) -> ToxicityModel:
    """Fits on at most `max_rows` labelled rows per label, those with the smallest hashes of their ids.

    Rows of the sample are weighted back to the number that they stand for. Null labels, ids and texts give nothing to learn from.
    Of the sample's features the `max_features` with the largest statistic of independence are kept, group names besides, so what reaches the driver
    is bounded by the parameters: 2 * max_rows lists of feature numbers.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).distinct()
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # row_number() <= k is cut on the map side as well
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = known.withColumn("r", rank).filter(F.col("r") <= max_rows).drop("r")
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).cast("binary").alias("text"))
    chosen = scratch.table("sample", texts.join(F.broadcast(sample), "doc_id"))  # 2 * max_rows ids
    table = swap_table(identities)
    named = set(table)

    def features(batches):
        for part, block in text_blocks(batches, "text"):
            decoded = [t.decode("utf-8", "replace") for t in block]
            own = [text_features(t) for t in decoded]
            other = [text_features(swap(t, table)) if s & named else None for t, s in zip(decoded, own)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")), pa.array(map(list, own), pa.list_(pa.string())), pa.array([o and list(o) for o in other], pa.list_(pa.string()))], names=["y", "own", "other"])

    sets = scratch.table("features", chosen.mapInArrow(features, "y int, own array<string>, other array<string>"))
    rows = {r["y"]: r["count"] for r in sets.groupBy("y").count().collect()}
    n1, n = rows.get(1, 0), sum(rows.values())
    seen = sets.select("y", F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("n1")).filter("n >= 3")
    expected = F.col("n") * F.lit(n1 / max(1, n))
    chi = (F.col("n1") - expected) ** 2 / (expected * (1 - F.col("n") / (n + 1)))
    best = [r["f"] for r in seen.orderBy(chi.desc(), "f").limit(max_features).collect()]  # a top-k report
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys([*best, *[f for w in sorted(named) for f in word_features(w)]]))}
    wanted = F.array(*[F.lit(f) for f in ()]) if not vocabulary else F.lit(list(vocabulary))
    bounded = sets.select("y", F.array_intersect("own", wanted).alias("own"), F.array_intersect("other", wanted).alias("other")).collect()
    x = [np.array(sorted(vocabulary[f] for f in r["own"]), dtype=np.int64) for r in bounded]
    swapped = [(i, np.array(sorted(vocabulary[f] for f in r["other"]), dtype=np.int64)) for i, r in enumerate(bounded) if r["other"] is not None]
    y = np.array([r["y"] for r in bounded], dtype=float)
    stand = np.array([sizes[r["y"]] / rows[r["y"]] for r in bounded], dtype=float)
    bias, weights = fit_weights(x, swapped, y, stand, len(vocabulary), penalty)
    scratch.drop()
    return ToxicityModel(bias, {f: float(weights[i]) for f, i in vocabulary.items() if weights[i]})


def score_texts(model: ToxicityModel, texts: list[bytes], known: dict[str, frozenset]) -> list[list]:
    """Score and verdict of each text; `known` keeps the model's features of words already met."""
    out = []
    for raw in texts:
        found: set[str] = set()
        for w in set(WORD.findall(raw.decode("utf-8", "replace"))):
            held = known.get(w)
            if held is None:
                if len(known) >= 300_000:
                    known.clear()
                held = known[w] = frozenset(f for f in word_features(w) if f in model.weights)
            if held:
                found |= held
        z = model.bias + sum(model.weights[f] for f in sorted(found))
        out.append(float(1 / (1 + np.exp(-np.clip(z, -700, 700)))))
    return [out, [int(s >= .5) for s in out]]


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score and predicted to each row; null and empty texts score as texts without features.

    Repeated rows get a row each, an empty table gives an empty result.
    """
    lower = docs.withColumn(text, F.lower(F.col(f"`{text}`")))
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # at most max_features and the group names
    return map_texts(lower, text, "score double, predicted int", lambda s, t: score_texts(*s[:1], t, s[1]), docs.columns if keep is None else keep,
                     lambda: (ToxicityModel(*shared.value), {}))
