"""Passages of benchmark items in training texts, by a generalised suffix automaton of the items.

The automaton holds every run of words of every item. A text streams through it word by word; the automaton's state then tells the longest run that
ends here and stands in an item. Where this length reaches a window, the window is hit: a window is `words` words of an item in a row, or a
whole shorter item.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlens.llm.common import BLOCK_BYTES, ITEM_BYTES, Scratch, free_name, giving_back, item_blocks, map_texts, plain_terms, text_blocks

WORDS = 10
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Runs of hit words [first, last) and the items whose windows are hit.
FOUND = "struct<runs:array<struct<first:int,last:int>>,items:array<string>>"
NEVER = 1 << 60


class SuffixAutomaton:
    """All runs of the sequences added to it. A state stands for the runs that end at the same places; `length` is its longest one, and `link` leads to
    the state of the longest shorter run that ends at more places."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def split(self, before: int, word, to: int) -> int:
        """The state of the runs of `to` that are one word longer than those of `before`, taken out of it where it has longer ones too."""
        if self.length[to] == self.length[before] + 1:
            return to
        copy = self.state(self.length[before] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while before >= 0 and self.next[before].get(word) == to:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def add(self, sequence: Iterable) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self.split(last, word, self.next[last][word])
                continue
            new, at = self.state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self.split(at, word, self.next[at][word])
            last = new

    def steps(self, sequence: Iterable) -> Iterator[tuple[int, int]]:
        """After each word: the state, and the length of the longest run ending here that the automaton holds."""
        edges, link, lengths = self.next, self.link, self.length
        state = length = 0
        for word in sequence:
            to = edges[state].get(word)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = edges[state].get(word)
            if to is not None:
                state, length = to, length + 1
            yield state, length

    def holder(self, state: int, length: int) -> int:
        """The state, at `state` or up its links, that stands for the run of `length` words ending here."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Windows:
    """The windows of items (id, text) in a suffix automaton, and which items have them. Items without an id are not named."""

    def __init__(self, items: list[tuple], words: int = WORDS):
        self.words, self.automaton = words, SuffixAutomaton()
        texts = [(None if i is None else str(i), plain_terms((t or "").encode())) for i, t in items]
        self.known = {w: k for k, w in enumerate(sorted({w for _, t in texts for w in t}))}
        coded = [(i, [self.known[w] for w in t]) for i, t in texts if t]
        for _, t in coded:
            self.automaton.add(t)
        states = range(len(self.automaton.link))
        self.owners: list[dict[int, set]] = [{} for _ in states]  # by state: window length -> items
        for i, t in coded:
            size = min(words, len(t))
            for at, (state, length) in enumerate(self.automaton.steps(t), 1):
                if at >= size:
                    self.owners[self.automaton.holder(state, size)].setdefault(size, set()).update(() if i is None else (i,))
        # The next state up the links that holds a window, itself included, and the shortest window on the way to the root.
        self.above, self.least = [-1] * len(states), [NEVER] * len(states)
        for s in sorted(states, key=self.automaton.length.__getitem__):
            up = self.automaton.link[s]
            own = self.owners[s]
            self.above[s] = s if own else self.above[up] if up >= 0 else -1
            self.least[s] = min([self.least[up] if up >= 0 else NEVER, *own])

    def found(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs [first, last) of hit words, united and in order, and the items whose windows occur."""
        spans, items, least, above, link = [], set(), self.least, self.above, self.automaton.link
        for end, (state, length) in enumerate(self.automaton.steps(map(self.known.get, words)), 1):
            if length < least[state]:
                continue
            state = above[state]
            while state >= 0:
                for size, owners in self.owners[state].items():
                    if size <= length:
                        spans.append((end - size, end))
                        items |= owners
                up = link[state]
                state = above[up] if up >= 0 else -1
        return united(spans), items


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows_of(block: DataFrame, words: int) -> Windows:
    """The windows of one block of items; tasks get them with their function."""
    return Windows([tuple(r) for r in block.collect()], words)  # bounded: one block


def match_block(docs: DataFrame, windows: Windows) -> DataFrame:
    """(key, found) of the texts of docs (key, text) that hold windows of this block."""
    def match(texts):
        made = []
        for t in texts:
            runs, items = windows.found(plain_terms(t))
            made.append({"runs": [{"first": a, "last": b} for a, b in runs], "items": sorted(items)} if runs else None)
        return [made]

    return map_texts(docs, "text", f"found {FOUND}", match, ["key"]).filter("found is not null")


def cut_out(raw: bytes, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Spans [from, to) of bytes from the first to the last word of each run, and the text without them."""
    places = [m.span() for m in TERM.finditer(raw)]
    spans = [(places[a][0], places[b - 1][1]) for a, b in runs]
    edges = [0, *[e for s in spans for e in s], len(raw)]
    return spans, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
                  words: int = WORDS, max_share: float = .5, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """The columns `keep` and n_words, n_hit, items (ids of the items found, as sorted strings), spans (bytes [from, to) to remove), cleaned (what is left).

    A passage goes from its first hit word to its last; where more than `max_share` of the words are hit, the whole text goes. A null text has no words
    and stays null; texts and items without words hold nothing and are held by nothing. Items without an id mark words but are not listed; rows with one item id are
    one item. Repeated rows say the same. Without documents the result is empty, without items nothing is hit. Own columns get underscores in front where `keep` has their names.

    The items come in blocks of about `block_bytes`. The last one meets all documents in the pass that makes the result; each one before has a pass
    of its own, whose matches are joined by the SHA-256 of the text.
    """
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession)
    *others, last = item_blocks(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")), "text", block_bytes)
    names = {c: f"in_{i}" for i, c in enumerate(keep)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text}`").cast("binary").alias("text"))
    more = F.lit(None).cast(f"array<{FOUND}>").alias("more")
    if others:
        inner = inner.withColumn("key", F.sha2("text", 256))
        texts = inner.select("key", "text").filter("text is not null")
        found = [scratch.table(f"found{i}", match_block(texts, windows_of(b, words))) for i, b in enumerate(others)]
        for one in found[1:]:
            found[0] = found[0].unionByName(one)
        # Equal texts say the same, so this gathers at most one value for each block.
        joined = scratch.table("found", found[0].groupBy("key").agg(F.collect_set("found").alias("more")))
        inner = inner.join(joined, "key", "left")
        more = F.col("more")
    inner = inner.select(*names.values(), more, "text")
    windows = windows_of(last, words)
    added = StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<from:int,to:int>>, cleaned string")
    schema = StructType([*inner.schema.fields[:len(names)], *added.fields])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.string()]

    def judged(raw: bytes, more: list[dict] | None) -> tuple:
        terms = plain_terms(raw)
        runs, ids = windows.found(terms)
        if more:
            runs = united([*runs, *[(r["first"], r["last"]) for m in more for r in m["runs"]]])
            ids = ids.union(*[m["items"] for m in more])
        hit = sum(b - a for a, b in runs)
        if not runs:
            return len(terms), 0, [], [], raw.decode("utf-8", "replace")
        spans, cleaned = ([(0, len(raw))], b"") if hit > max_share * len(terms) else cut_out(raw, runs)
        return len(terms), hit, sorted(ids), [{"from": a, "to": b} for a, b in spans], cleaned.decode("utf-8", "replace")

    def run(batches):
        for part, texts in text_blocks(batches, "text", BLOCK_BYTES):
            before = part.column(len(names)).to_pylist()
            made = list(zip(*[judged(t, m) for t, m in zip(texts, before)]))
            none = part.column(len(names) + 1).is_null().to_pylist()
            made[4] = [None if n else c for n, c in zip(none, made[4])]
            yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], *[pa.array(v, t) for v, t in zip(made, kinds)]], names=schema.names)

    own = [F.col(f).alias(free_name(f, keep)) for f in added.fieldNames()]
    return inner.mapInArrow(giving_back(run), schema).select(*[F.col(n).alias(c) for c, n in names.items()], *own)
