"""Language of texts and of their spans: scripts narrow the candidates, Viterbi labels the words.

Training counts hashed byte trigrams per language over all texts whose language is known, and how the words of each language spread over
scripts. A word's score for a language is the sum of the log-probabilities of its trigrams; languages that hardly use the word's
script are no candidates. The best path over the words of a text pays a penalty for each change of language.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import giving_back, map_texts, text_blocks

BUCKETS = 1 << 15
#: Score of a change of language, in nats.
PENALTY = 12.0
#: A language is a candidate for a script from this share of its words on.
SCRIPT_SHARE = 0.005
#: Texts that are labelled together; their words advance side by side, so larger blocks take fewer steps.
LABEL_BYTES = 4 << 20
#: A language column with more values than this is refused.
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Script ranges as (first, last) UTF-8 lead byte of their code points; ASCII letters are Latin too.
SCRIPTS = (("latin", 0xC3, 0xCA), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4), ("armenian_hebrew", 0xD5, 0xD7), ("arabic", 0xD8, 0xDC),
           ("south_asian", 0xE0, 0xE0), ("other_syllabic", 0xE1, 0xE1), ("kana_cjk", 0xE3, 0xE3), ("cjk", 0xE4, 0xE9), ("hangul", 0xEA, 0xED))
NO_SCRIPT = len(SCRIPTS)


def script_table() -> np.ndarray:
    """Script number by byte: of the letter that begins with it, NO_SCRIPT for all others."""
    table = np.full(256, NO_SCRIPT, dtype=np.uint8)
    table[[*range(65, 91), *range(97, 123)]] = 0
    for i, (_, first, last) in enumerate(SCRIPTS):
        table[first:last + 1] = i
    return table


@dataclass
class Words:
    """The words of a block of texts: where they start, to which text they belong, trigram buckets, scripts."""
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    buckets: np.ndarray
    scripts: np.ndarray


def words_of(texts: list[bytes], table: np.ndarray) -> Words:
    """A trigram belongs to the word whose space in front or byte it begins with; ASCII letters are lower-cased."""
    joined = b" " + b"\n".join(texts).lower() + b"  "
    x = np.frombuffer(joined, dtype=np.uint8)
    space = (x == 32) | ((x >= 9) & (x <= 13))
    x = np.where(space, np.uint8(32), x).astype(np.uint32)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
    text = np.searchsorted(bounds, starts, side="right") - 1
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    buckets = (code * np.uint32(2654435761)) >> np.uint32(17)
    lead = table[np.frombuffer(joined, dtype=np.uint8)]
    scripts = np.minimum.reduceat(lead, starts) if len(starts) else lead[:0]
    return Words(starts, ends, text, buckets, scripts)


def spread(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all trigrams of words and the number of the word of each."""
    sizes = w.ends - w.starts + 1
    word = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(w.starts - 1, sizes) + within
    return np.minimum(at, len(w.buckets) - 1), word


@dataclass(frozen=True)
class LanguageModel:
    """logp[bucket, language] of trigrams; candidates[script, language]: 0 or minus infinity."""
    languages: list[str]
    logp: np.ndarray
    candidates: np.ndarray


def train(docs: DataFrame, text: str, lang: str) -> LanguageModel:
    """Counts over all given documents with a language; null texts count as empty.

    The driver gets at most (BUCKETS + scripts) rows per language, whatever the corpus size; more than MAX_LANGUAGES values are refused.
    """
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(text).cast("binary").alias("text"), F.col(lang).cast("string").alias("lang"))
    table, width = script_table(), BUCKETS + NO_SCRIPT + 1

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part, texts in text_blocks(batches, "text"):
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            for one in set(langs):
                w = words_of([texts[i] for i in np.flatnonzero(langs == one)], table)
                held = sums.setdefault(one, np.zeros(width, dtype=np.int64))
                held[:BUCKETS] += np.bincount(w.buckets[spread(w)[0]], minlength=BUCKETS)
                held[BUCKETS:] += np.bincount(w.scripts, minlength=NO_SCRIPT + 1)
        for one, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["lang", "bucket", "n"])

    values = known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if values > MAX_LANGUAGES:
        raise ValueError(f"{lang} has more than {MAX_LANGUAGES} values, so it does not name languages")
    rows = known.mapInArrow(giving_back(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(rows["lang"]))
    counts = np.zeros((width, len(languages)))
    counts[rows["bucket"].to_numpy(), [languages.index(x) for x in rows["lang"]]] = rows["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    logp = np.log(grams + .5) - np.log(grams.sum(axis=0) + .5 * BUCKETS)
    share = scripts[:NO_SCRIPT] / np.maximum(1, scripts[:NO_SCRIPT].sum(axis=0))
    candidates = np.where(share >= SCRIPT_SHARE, 0.0, -1e4)
    candidates[candidates.max(axis=1, initial=-1e4) < 0] = 0.0  # a script that no language uses narrows nothing
    return LanguageModel(languages, logp.astype(np.float32), np.vstack([candidates, np.zeros((1, len(languages)))]).astype(np.float32))


def word_scores(w: Words, model: LanguageModel) -> np.ndarray:
    """Score of each word for each language; a word without a letter scores alike for all."""
    at, _ = spread(w)
    first = np.cumsum(w.ends - w.starts + 1) - (w.ends - w.starts + 1)
    scores = np.add.reduceat(model.logp[w.buckets[at]], first, axis=0)
    return np.where((w.scripts == NO_SCRIPT)[:, None], np.float32(0), scores + model.candidates[w.scripts])


def viterbi(scores: np.ndarray, text: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; `text` numbers the texts in ascending order. All texts advance together, a word at a time.

    Ties go to staying, then to the first language.
    """
    if not len(scores):
        return np.empty(0, dtype=np.int64)
    _, first, size = np.unique(text, return_index=True, return_counts=True)
    longest = np.argsort(-size, kind="stable")
    first, size = first[longest], size[longest]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts that have a word at this step
    kind = np.min_scalar_type(max(0, scores.shape[1] - 1))  # as wide as the number of languages needs
    back = np.empty(scores.shape, dtype=kind)
    own = np.arange(scores.shape[1], dtype=kind)
    best = scores[first].astype(np.float64)
    final = best.copy()
    for t in range(1, size[0]):
        n = active[t]
        previous, at = best[:n], first[:n] + t
        top = previous.argmax(axis=1)
        change = previous[np.arange(n), top] - penalty
        stay = previous >= change[:, None]
        back[at] = np.where(stay, own, top[:, None].astype(kind))
        best = np.where(stay, previous, change[:, None]) + scores[at]
        final[:n] = best
    labels = np.empty(len(scores), dtype=np.int64)
    now = final.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return labels


def label_texts(model: LanguageModel, texts: list[bytes], penalty: float = PENALTY) -> list[list]:
    """Language, its share of the bytes of words with letters, and spans (first word, last word, language) of each text.

    The language is UNKNOWN where no word has a script.
    """
    n = len(model.languages)
    w = words_of(texts, script_table())
    if not n or not len(w.starts):
        return [[UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]]
    labels = viterbi(word_scores(w, model), w.text, penalty)
    weight = np.where(w.scripts == NO_SCRIPT, 0, w.ends - w.starts)
    held = np.bincount(w.text * n + labels, weights=weight, minlength=len(texts) * n).reshape(len(texts), n)
    total, top = held.sum(axis=1), held.argmax(axis=1)
    change = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (w.text[1:] != w.text[:-1])])
    word0 = np.searchsorted(w.text, np.arange(len(texts)))
    spans: list[list] = [[] for _ in texts]
    for a, b in zip(change, np.r_[change[1:], len(labels)]):
        d = w.text[a]
        spans[d].append({"first": int(a - word0[d]), "last": int(b - 1 - word0[d]), "lang": model.languages[labels[a]]})
    return [[model.languages[i] if s else UNKNOWN for i, s in zip(top, total)], [float(h[i] / s) if s else 0.0 for h, i, s in zip(held, top, total)], spans]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """Adds lang_pred, score and, if wanted, spans of words by language.

    lang_pred is UNKNOWN and score 0 where the text is null, has no letter, or nothing was learned; a text with letters of no
    listed script gets the first language of the model with score 0. Repeated rows get a row each, an empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.languages, model.logp, model.candidates))  # BUCKETS rows per language
    outputs = "lang_pred string, score double" + ", spans array<struct<first:int,last:int,lang:string>>" * spans
    made = map_texts(docs, text, outputs, lambda m, t: label_texts(m, t, penalty)[:2 + spans], keep, lambda: LanguageModel(*shared.value), max(1 << 16, LABEL_BYTES * 8 // max(8, len(model.languages))))  # scores are words x languages
    return made


def language_id(docs: DataFrame, learn: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of each document, by a model of the documents of `learn` that have a language.

    Whether a text has a letter is decided by Unicode category, not by the script table.
    """
    model = train(learn, text, lang)
    inner = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    made = identify(inner, model, keep=["doc_id", "letters"], spans=spans)
    first = model.languages[0] if model.languages else UNKNOWN
    pred = F.when(F.col("letters"), F.when(F.col("lang_pred") == UNKNOWN, F.lit(first)).otherwise(F.col("lang_pred"))).otherwise(F.lit(UNKNOWN))
    return made.select("doc_id", pred.alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(F.lit(0.0)).alias("score"), *(["spans"] if spans else []))
