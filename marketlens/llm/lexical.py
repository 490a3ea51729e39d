"""Ranked lexical search: the best documents of every item, by best-first search over intervals of documents.

Documents come in shards. A shard keeps, for every term of the items, a posting list of impacts in the order of document ids, and over these lists a sparse
table for range maxima. The sum of the weighted range maxima of an item's terms bounds every document of an interval. The interval with the greatest
bound is taken first: the document with its greatest single impact is scored, and the two intervals beside it take its place. Intervals that can't beat the k-th
score are dropped, so most documents are never scored.
"""
from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import ITEM_BYTES, Scratch, giving_back, item_blocks, map_texts, plain_terms

#: A shard ends after so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 19
#: Intervals of one item that are split at once.
BATCH = 64
#: Rounds of splitting in the first look, which gives the lower bound of the k-th score.
FIRST_ROUNDS = 6
HITS = "item int, doc_id long, score long"


@dataclass(frozen=True)
class Items:
    """Search items as term numbers with weights; `known` numbers the terms."""
    ids: list
    known: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        counts = [Counter(plain_terms((text or "").encode())) for _, text in rows]
        known = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        return Items([i for i, _ in rows], known, [np.array([known[t] for t in c], dtype=np.int64) for c in counts], [np.array(list(c.values()), dtype=np.int64) for c in counts])


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of docs (doc_id, text): number of terms, and which of the known ones occur how often."""
    def count(texts):
        sizes, terms, tfs = [], [], []
        for t in texts:
            words = plain_terms(t)
            got = Counter(filter(known.__contains__, words))
            sizes.append(len(words))
            terms.append([known[w] for w in got])
            tfs.append(list(got.values()))
        return [sizes, terms, tfs]

    return map_texts(docs, "text", "n long, terms array<int>, tfs array<int>", count, ["doc_id"])


@dataclass(frozen=True)
class Statistics:
    """documents and occurrences: those with a term, and all their terms; weights: by term number."""
    documents: int
    occurrences: int
    weights: np.ndarray


def statistics(posted: DataFrame, terms: int) -> Statistics:
    n, total = posted.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(terms, dtype=np.int64)
    for r in posted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # at most one row a term of the items
        df[r["term"]] = r["count"]
    return Statistics(n, total or 0, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64))


class Shard:
    """Posting lists of some documents, which come in the order of ids, and the sparse table of their range maxima."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, known: int, stats: Statistics):
        self.docs = len(sizes)
        doc = np.repeat(np.arange(self.docs), counts)
        m = 75 + 25 * sizes * stats.documents // max(1, stats.occurrences)
        impact = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[doc])
        keys = terms * self.docs + doc
        order = np.argsort(keys, kind="stable")
        self.keys, self.impact = keys[order], impact[order]
        self.begin = np.searchsorted(self.keys, np.arange(known + 1) * self.docs)
        longest = int(np.diff(self.begin).max(initial=0))
        # Level j: the place of the greatest impact among 2 ** j postings from each place on. Ranges stay inside one list, so lists share the table.
        level = np.arange(len(self.keys), dtype=np.int32)
        self.table = [level]
        for j in range(1, longest.bit_length()):
            a, b = level[:-(1 << j - 1)], level[1 << j - 1:]
            level = level.copy()
            level[:len(a)] = np.where(self.impact[b] > self.impact[a], b, a)
            self.table.append(level)
        self.table = np.concatenate(self.table) if len(self.keys) else np.empty(0, dtype=np.int32)
        self.log = np.frexp(np.arange(longest + 1))[1].astype(np.int64) - 1

    def bounds(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals given by their ranges of postings [low, high) by term: the sum of the weighted maxima, and the document of the greatest one."""
        size = high - low
        some = size > 0
        level = self.log[np.where(some, size, 1)]
        a = np.where(some, low, 0)
        b = np.where(some, high - (1 << level), 0)
        a, b = self.table[level * len(self.keys) + a], self.table[level * len(self.keys) + b]
        best = np.where(self.impact[b] > self.impact[a], b, a)
        worth = np.where(some, self.impact[best], 0) * weights
        at = worth.argmax(axis=1)
        return worth.sum(axis=1), self.keys[best[np.arange(len(best)), at]] % self.docs

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents with a score of `least` or more, best first, equal ones in the order of ids; and their scores."""
        here = self.begin[terms + 1] > self.begin[terms]
        terms, weights = terms[here], weights[here]
        top, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if not len(terms):
            return top, scores
        base = terms * self.docs
        low, high, first = self.begin[terms][None], self.begin[terms + 1][None], np.zeros(1, dtype=np.int64)
        bound, split = self.bounds(low, high, weights)
        while rounds is None or rounds > 0:
            rounds = rounds if rounds is None else rounds - 1
            # An interval with the bound of the k-th document can still hold an equal one with a smaller id.
            open_ = bound >= least
            if len(top) == k:
                open_ &= (bound > scores[-1]) | ((bound == scores[-1]) & (first < top[-1]))
            low, high, first, bound, split = (x[open_] for x in (low, high, first, bound, split))
            if not len(bound):
                break
            order = np.argsort(-bound, kind="stable")
            now, later = order[:BATCH], order[BATCH:]
            doc = split[now]
            want = base + doc[:, None]
            middle = np.searchsorted(self.keys, want)
            held = self.keys[np.minimum(middle, len(self.keys) - 1)] == want
            score = (np.where(held, self.impact[np.minimum(middle, len(self.keys) - 1)], 0) * weights).sum(axis=1)
            children = np.concatenate([low[now], middle + held]), np.concatenate([middle, high[now]])
            more, places = self.bounds(*children, weights)
            low, high = np.concatenate([low[later], children[0]]), np.concatenate([high[later], children[1]])
            first = np.concatenate([first[later], first[now], doc + 1])
            bound, split = np.concatenate([bound[later], more]), np.concatenate([split[later], places])
            good = score >= least
            top, scores = np.concatenate([top, doc[good]]), np.concatenate([scores, score[good]])
            best = np.lexsort((top, -scores))[:k]
            top, scores = top[best], scores[best]
        return top, scores


def hits(posted: DataFrame, items: Items, stats: Statistics, k: int, least: np.ndarray, rounds: int | None = None) -> DataFrame:
    """(item, doc_id, score): of each shard the best documents of each item that reach `least`."""
    weights = [stats.weights[t] * n for t, n in zip(items.terms, items.times)]

    def shard_hits(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
        lists = rows.column("terms").combine_chunks()
        flat = [np.asarray(rows.column(c).combine_chunks().flatten()).astype(np.int64) for c in ("terms", "tfs")]
        shard = Shard(rows.column("n").to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64), *flat, len(items.known), stats)
        found = [shard.search(t, w, k, max(1, int(at)), rounds) for t, w, at in zip(items.terms, weights, least)]
        item = np.repeat(np.arange(len(found), dtype=np.int32), [len(d) for d, _ in found])
        docs, scores = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(item), rows.column("doc_id").combine_chunks().take(pa.array(docs)), pa.array(scores)], names=["item", "doc_id", "score"])

    def run(batches):
        held, docs, count = [], 0, 0
        for batch in batches:
            if docs and (docs + batch.num_rows > SHARD_DOCS or count >= SHARD_POSTINGS):
                yield shard_hits(held)
                held, docs, count = [], 0, 0
            held.append(batch)
            docs += batch.num_rows
            count += len(batch.column(2).flatten())
        if docs:
            yield shard_hits(held)

    return posted.filter(F.size("terms") > 0).mapInArrow(giving_back(run), HITS)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           block_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by ascending id.

    Null and empty texts have no terms, so they neither find nor are found. Every row of the items is searched for, equal rows once; every row of the documents is ranked,
    repeated rows with equal scores beside each other and rows without an id last among equal scores. An empty table on either side gives an empty result; other columns
    are not read. Items come in blocks of about `block_bytes`; each block reads the documents once.
    """
    scratch, out = Scratch(docs.sparkSession), None
    inner = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).distinct()
    for i, block in enumerate(item_blocks(asked, "text", block_bytes)):
        found = Items.of(sorted(map(tuple, block.collect()), key=str))  # bounded: one block
        posted = scratch.table(f"postings{i}", postings(inner, found.known))
        stats = statistics(posted, len(found.known))
        # The k-th best of the documents seen in a first look bounds the k-th best of all from below.
        look = best_of(hits(posted, found, stats, k, np.ones(len(found.ids)), FIRST_ROUNDS), k)
        least = np.ones(len(found.ids), dtype=np.int64)
        for r in look.filter(F.col("rank") == k).select("item", "score").toLocalIterator():  # at most one row an item
            least[r["item"]] = r["score"]
        top = scratch.table(f"top{i}", best_of(hits(posted, found, stats, k, least), k))
        scratch.drop(f"postings{i}")
        names = docs.sparkSession.createDataFrame([(n, x) for n, x in enumerate(found.ids)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        made = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names are bounded by the block
        out = made if out is None else out.unionByName(made)
    return out
