"""Audit of filters that remove the same documents: what each removes in any order, and its fair share.

Every text has a mask of the filters it fails. The removal game gives a coalition of filters the number of documents that fail any of
them. The potential of Hart and Mas-Colell is computed recursively over all coalitions: P(S) is the worth of S plus the potentials of S without one
member, divided by the size of S. A filter's Shapley value is the potential of all filters less the potential without it, and all that happens at a step of an
order is a difference between coalitions, so no order is ever run over documents.
"""
from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, map_texts

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))

#: A check gets a text and its words and says whether the text fails.
CHECKS: dict[str, Callable[[bytes, list[bytes]], bool]] = {
    "A": lambda raw, words: len(words) < 200,
    "B": lambda raw, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda raw, words: 100 * (len(raw) - len(raw.translate(None, UPPER))) > 2 * len(raw.translate(None, CONTINUATION)),
    "D": lambda raw, words: len(raw.translate(None, SYMBOLS)) < len(raw),
}
#: The filter that fails texts which a document with a smaller id has too.
COPY = "E"


def failed(raw: bytes, checks: dict[str, Callable]) -> int:
    words = raw.split()  # bytes split on exactly the white space of the word pattern
    return sum(1 << i for i, check in enumerate(checks.values()) if check(raw, words))


def failure_counts(docs: DataFrame, labels: DataFrame, checks: dict[str, Callable], scratch: Scratch) -> DataFrame:
    """(part, mask, n, good, toxic) of docs (doc_id, part, text) and labels (doc_id, quality, toxic): documents by the filters that they fail.

    Copies are found by the SHA-256 of their texts. Texts are added up by id, part and label before their first ids are compared, so a text that a third
    of the documents hold is a few rows.
    """
    measured = map_texts(docs, "text", "mask int, text_key binary", lambda texts: [[failed(t, checks) for t in texts], [hashlib.sha256(t).digest() for t in texts]], ["doc_id", "part"])
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    kind = ["text_key", "part", "mask", "good", "toxic"]
    marked = measured.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    ids = marked.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
                                   F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"))
    kinds = scratch.table("kinds", kinds)
    # Written before it is joined, so that the join deals both sides out itself and can split the rows of a frequent text.
    firsts = scratch.table("firsts", kinds.groupBy("text_key").agg(F.min("first.doc_id").alias("low"), F.sum("n").alias("times")).filter("times > 1").select("text_key", "low"))
    own = F.col("without_id") + F.when(F.col("low").isNull() | (F.col("first.doc_id") == F.col("low")), F.col("first.n")).otherwise(0)
    own = F.when(F.col("first").isNull(), F.col("n")).otherwise(own)
    copies = F.array(F.struct(F.col("mask"), own.alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(checks)).alias("mask"), (F.col("n") - own).alias("n")))
    split = kinds.join(firsts, "text_key", "left").select("part", "good", "toxic", F.inline(copies)).filter("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def worths(counts: DataFrame, filters: int) -> DataFrame:
    """(part, total, removed, good, toxic): of each part the documents, and by coalition those removed, those of them good, those toxic."""
    def by_coalition(count: str):
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(count)).otherwise(0)) for s in range(1 << filters)])

    return counts.groupBy("part").agg(F.sum("n").alias("total"), by_coalition("n").alias("removed"), by_coalition("good").alias("good"), by_coalition("toxic").alias("toxic"))


def with_potentials(game: DataFrame, filters: int) -> DataFrame:
    """Adds potential: by coalition S, |S|! times its potential, which is a whole number.

    With Q(S) = |S|! P(S) the recursion reads Q(S) = (|S| - 1)! v(S) + sum of Q(S without i) over the members i.
    """
    everyone = range(1 << filters)
    game = game.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, filters + 1):
        level = {}
        for s in (s for s in everyone if s.bit_count() == size):
            smaller = sum((F.col(f"p{s ^ 1 << i}") for i in range(filters) if s >> i & 1), F.lit(0).cast("long"))
            level[f"p{s}"] = math.factorial(size - 1) * F.col("removed")[s] + smaller
        game = game.withColumns(level)
    return game.withColumn("potential", F.array(*[f"p{s}" for s in everyone])).drop(*[f"p{s}" for s in everyone])


def all_steps(names: str) -> list[dict]:
    """Every step of every order: its filter, the coalition of the filters before it, and with it."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            rows.append({"filter_order": "".join(names[j] for j in order), "step": step, "alone": 1 << i, "before": before, "after": after})
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", checks: dict[str, Callable] = CHECKS) -> DataFrame:
    """Per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (times the number of orders).

    The filters are `checks`, in this order, and after them COPY: the text stands under a smaller id, removed or not. Every part gets every order and step.
    A null text is empty, a null part is the empty one. A row without an id is no copy of any and has no label; rows of one id are no copies of each
    other; with several labels of an id, one that says 1 counts. Repeated rows count each. An empty table gives an empty result; other columns are not read.
    """
    scratch, names = Scratch(docs.sparkSession), "".join(checks) + COPY
    n, everyone = len(names), (1 << len(names)) - 1
    inner = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null")
    game = with_potentials(worths(failure_counts(inner, marks, checks, scratch), n), n)
    game = scratch.table("game", game)
    scratch.drop("kinds", "firsts")
    steps = F.from_json(F.lit(json.dumps(all_steps(names))), "array<struct<filter_order:string,step:int,alone:int,before:int,after:int>>")
    rows = game.select("*", F.inline(steps))

    def at(array: str, coalition):
        return F.get(array, coalition)

    without = F.lit(everyone) - F.col("alone")
    lost = {f"{c}_lost": at(c, F.col("after")) - at(c, F.col("before")) for c in ("good", "toxic")}
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - at("removed", F.col("after"))).alias("kept"), (at("removed", F.col("after")) - at("removed", F.col("before"))).alias("removed"),
        (at("removed", F.col("alone")) + at("removed", F.col("before")) - at("removed", F.col("after"))).alias("redundant"),
        (F.col("removed")[everyone] - at("removed", without)).alias("unique_fails"), *[v.alias(k) for k, v in lost.items()],
        (F.col("potential")[everyone] - n * at("potential", without)).alias("shapley"))
