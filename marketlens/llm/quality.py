"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one measure of a text and votes good, bad or not at all. The votes of all documents are counted by pattern
(at most 3 to the number of rules, whatever the corpus size), the accuracies of the rules and the share of good documents come
from expectation-maximisation over these counts, and each document gets the posterior probability of being good.
"""
from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, map_texts

BAD, GOOD, ABSTAIN = 0, 1, 2
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = string.punctuation.encode()
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes int"


@dataclass(frozen=True)
class Rule:
    """Votes good up to `good`, bad from `bad` on, else abstains; with good > bad the directions change places."""
    name: str
    good: float
    bad: float

    def vote(self, value: float) -> int:
        if self.good <= self.bad:
            return GOOD if value <= self.good else BAD if value >= self.bad else ABSTAIN
        return GOOD if value >= self.good else BAD if value <= self.bad else ABSTAIN


#: The measures are ratios, so they are alike at every text length.
RULES = (
    Rule("symbols_per_word", .10, .30),
    Rule("shouts_per_word", .05, .25),
    Rule("capital_share", .20, .50),
    Rule("repeated_line_share", .10, .30),
    Rule("repeated_word_share", .20, .40),
    Rule("same_as_previous_share", .05, .15),
    Rule("short_word_share", .20, .10),
    Rule("wordless_share", .05, .20),
    Rule("letter_share", .75, .60),
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, repeated = set(), set()
    for w in windows:
        (repeated if w in seen else seen).add(w)
    n, end = 0, 0
    for i, w in enumerate(windows):
        if w in repeated:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def measure(text: bytes, rules: tuple[Rule, ...] = RULES) -> tuple[int, ...]:
    """The base counts of a text and the votes as one number in base three, first rule lowest.

    A text without words has no measures, so all rules abstain.
    """
    words = text.split()  # bytes split on exactly the white space of the word pattern
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = sum(map(text.count, (bytes([s]) for s in SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return 0, 0, symbols, 0, 0, sum(ABSTAIN * 3 ** i for i in range(len(rules)))
    letters = sum(map(str.isalpha, joined.decode("utf-8", "replace")))
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    values = {
        "symbols_per_word": symbols / n,
        "shouts_per_word": text.count(b"!") / n,
        "capital_share": upper / max(1, letters),
        "repeated_line_share": dup_lines / max(1, len(lines)),
        "repeated_word_share": repeats / n,
        "same_as_previous_share": sum(map(bytes.__eq__, words, words[1:])) / n,
        "short_word_share": sum(len(w) <= 3 and (w[:1].isalpha() or w[0] > 127) for w in words) / n,
        "wordless_share": sum(not w.strip(PUNCTUATION) for w in words) / n,
        "letter_share": letters / max(1, chars),
    }
    return n, chars, symbols, dup_lines, repeats, sum(r.vote(values[r.name]) * 3 ** i for i, r in enumerate(rules))


def with_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the base counts and the vote pattern of each whole text; a null text counts as empty."""
    return map_texts(docs, text, MEASURES, lambda texts: list(zip(*[measure(t, rules) for t in texts])), docs.columns if keep is None else keep)


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good documents; chances[y][r][v]: chance that rule r votes v where the truth is y."""
    prior: float
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = unpack(patterns, self.chances.shape[1])
        like = np.log(self.chances)[:, np.arange(votes.shape[1]), votes].sum(axis=2)
        return 1 / (1 + np.exp(np.clip(like[BAD] + np.log1p(-self.prior) - like[GOOD] - np.log(self.prior), -700, 700)))


def unpack(patterns: np.ndarray, rules: int) -> np.ndarray:
    return (np.asarray(patterns, dtype=np.int64)[:, None] // 3 ** np.arange(rules)) % 3


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rules: int, rounds: int = 200, smoothing: float = 1.0) -> VoteModel:
    """Expectation-maximisation over vote patterns, started from the share of good votes.

    The start fixes which class is called good. Without any vote the posterior is one half plus the smoothing.
    """
    votes, counts = unpack(patterns, rules), np.asarray(counts, dtype=float)
    cast = (votes != ABSTAIN).sum(axis=1)
    q = ((votes == GOOD).sum(axis=1) + 1) / (cast + 2)
    model = VoteModel(.5, np.full((2, rules, 3), 1 / 3))
    for _ in range(rounds):
        chances = np.empty((2, rules, 3))
        for y, weight in ((GOOD, q * counts), (BAD, (1 - q) * counts)):
            for v in (BAD, GOOD, ABSTAIN):
                chances[y, :, v] = ((votes == v) * weight[:, None]).sum(axis=0) + smoothing
        chances /= chances.sum(axis=2, keepdims=True)
        prior = ((q * counts).sum() + smoothing) / (counts.sum() + 2 * smoothing)
        model = VoteModel(float(prior), chances)
        new = model.posterior(patterns) if len(counts) else q
        if not len(counts) or np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


def fit(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[VoteModel, DataFrame]:
    """The model and a table (votes, p_good) of the patterns that occur: at most 3 ** len(rules) rows reach the driver.

    Documents with fewer than MIN_WORDS words are too short for ratios and are left out of the estimate.
    """
    rows = sorted(measured.groupBy("votes").agg(F.sum((F.col("n_words") >= MIN_WORDS).cast("long")).alias("n")).collect())
    patterns, counts = np.array([r.votes for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=float)
    model = fit_votes(patterns, counts, len(rules))
    p = model.posterior(patterns) if len(rows) else []
    table = measured.sparkSession.createDataFrame([(int(v), float(x)) for v, x in zip(patterns, p)], "votes int, p_good double")
    return model, table


def judge(measured: DataFrame, patterns: DataFrame, threshold: float = .5) -> DataFrame:
    """Adds p_good, base_failed and kept. The pattern table is bounded by the rules, so it is broadcast."""
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeats > 50 * n)
    return (measured.join(F.broadcast(patterns), "votes", "left").withColumn("base_failed", failed)
            .withColumn("kept", ~failed & F.coalesce(F.col("p_good") >= threshold, F.lit(False))))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, base counts, votes, p_good, base_failed, kept.

    Null and empty texts have no words: all counts are 0, base_failed is true. Repeated rows get a row each; an empty table gives an
    empty result; a null id is kept as it is; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    measured = scratch.table("measures", with_measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]))
    _, patterns = fit(measured)
    return judge(measured, patterns).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes", "p_good", "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns and whatever names these have.

    The texts are measured twice rather than written once. Only the text goes to Python: the second pass answers whether a row is kept, and the JVM
    filters and hands on the rows themselves.
    """
    model, _ = fit(with_measures(docs.select(F.col(f"`{text}`").alias("text")), keep=[]))
    return docs.filter(verdict(model)(F.col(f"`{text}`")))


def verdict(model: VoteModel, threshold: float = .5, slice_rows: int = 256):
    """An Arrow function of texts: true where `judge` keeps them."""
    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        out = []
        for first in range(0, len(texts), slice_rows):
            made = [measure((t or "").encode()) for t in texts.slice(first, slice_rows).to_pylist()]
            n, repeats, votes = (np.array([m[i] for m in made], dtype=np.int64) for i in (0, 4, 5))
            out.append(pa.array((n >= MIN_WORDS) & (100 * repeats <= 50 * n) & (model.posterior(votes) >= threshold)))
        return pa.concat_arrays(out) if out else pa.array([], pa.bool_())

    return kept
